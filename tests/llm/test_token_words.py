"""Word by word ids equal the tokenizer's for every letter of Unicode."""

import unicodedata

import numpy as np

from trustframe.llm import tokens


def test_every_letter_before_signs():
    ids = tokens.word_ids(tokens.default_tokenizer())
    letters = [chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    # letters whose lower case or normal form holds something else come with many signs, the others with one
    odd = [c for c in letters if not all(x.isalpha() for x in unicodedata.normalize("NFC", c).lower())]
    odd += [chr(c) for c in range(128, 0x30000) if unicodedata.combining(chr(c))]
    words = [w for c in odd for w in (f"{c}.", f"b{c}!", f"{c}b>", f"{c}{c}\"", f"b{c}.{c}", f"{c}", f"A{c}'s")]
    words += [f"b{c}." for c in letters[::7]] + ["\u0130.", "\u0130>", "b\u0130!", "\u0130stanbul.", "K\u0130\u0130."]
    assert "\u0130" in odd
    got = ids.of({w.encode() for w in words})
    want = ids.tokenizer.encode_batch(words, add_special_tokens=False)
    assert [w for w, e in zip(words, want) if got[w.encode()] != np.array(e.ids, ids.kind).tobytes()] == []
