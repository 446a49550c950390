"""Exact dedup, spelling variants and alignment against brute force; large ids beside NULL, string ids."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import TEXTS
from pyspark.sql import functions as F

from trustframe.llm import alignment, exact, spelling
from trustframe.llm.common import table

BIG = 2**60


def exact_brute(rows):
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()) for _, t in rows]
    out = []
    for t in sorted(set(low)):
        ids = [rows[k][0] for k in range(len(rows)) if low[k] == t]
        top = max([i for i in ids if i is not None], default=None)
        stays = False
        for i in sorted(ids, key=lambda i: (i != top, str(i))):
            out.append((i, top, len(ids), i == top and not stays, hashlib.sha256(t).hexdigest()))
            stays = stays or i == top
    return sorted(out, key=str)


def exact_rows(kind):
    rows = [(BIG + k, t) for k, t in enumerate(TEXTS)] + [(BIG + 100 + k, "A copy") for k in range(50)]
    rows += [(BIG + 149, "a Copy"), (BIG + 149, "A copy"), (None, "A COPY"), (None, "only null"), (None, "ONLY null"), (BIG + 300, "É"), (BIG + 301, "é")]
    return [(None if i is None else kind(i), t) for i, t in rows]


@pytest.mark.parametrize("places", [exact.MAX_PLACES, 64, 1024])
@pytest.mark.parametrize("kind", [int, str])
def test_exact_dedup(spark, monkeypatch, places, kind):
    monkeypatch.setattr(exact, "SLICE_BYTES", 16)
    rows = exact_rows(kind)
    docs = spark.createDataFrame(rows, f"doc_id {'long' if kind is int else 'string'}, text string").repartition(5)
    got = exact.decide(docs, max_places=places).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=str) == exact_brute(rows)


def test_exact_hot_groups_and_columns(spark, monkeypatch):
    rows = [(k, "hot", "x", 1) for k in range(1500)] + [(5000 + k, f"t{k // 2}", None, 2) for k in range(300)] + [(9000, "one", "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _digest string, _mark int").repartition(7)
    got = exact.decide(docs).groupBy("group_size").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1), (2, 300, 150), (1500, 1500, 1)]
    kept = exact.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([1499, 9000, *range(5001, 5300, 2)])


def test_bloom_has_no_false_negatives(spark):
    r = np.random.default_rng(0)
    one = [r.bytes(32) for _ in range(3000)]
    twice = one[:200]
    df = spark.createDataFrame([(bytearray(x),) for x in one + twice], "digest binary").repartition(6)
    for places in (1 << 10, 1 << 16):
        bits = exact.repeated_places(df, 3200, places)
        assert 8 * len(bits) == places
        test = exact.maybe_repeated(spark, bits)
        flagged = {bytes(x.digest) for x in df.where(test("digest")).collect()}
        assert flagged >= set(twice)
    assert len(flagged) < 500


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_brute(words, ratio=10):
    out, form = [], {}
    for w, n in words:
        near = [(m, v) for v, m in words if is_near(w, v)]
        best = min(near, key=lambda x: (-x[0], x[1]), default=None)
        has = best is not None and best[0] >= ratio * n
        form[w] = best[1] if has else None
        out.append([w, n, len(near), best[1] if has else None, best[0] if has else None])
    for row in out:
        at = row[0]
        while form[at]:
            at = form[at]
        row.append(at)
    return sorted(map(tuple, out))


@pytest.mark.parametrize("limits", [{}, {"block_words": 3}, {"pieces": 1}, {"pieces": 4}, {"block_cells": 30}])
def test_variants_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(spelling, "PAIRS", 50)
    monkeypatch.setattr(spelling, "MATRIX_CELLS", 400)
    if "block_words" in limits:
        monkeypatch.setattr(spelling, "BROADCAST_ROWS", 0)
    r = np.random.default_rng(5)
    words = {"".join(r.choice(list("abé"), r.integers(1, 9))): 1 for _ in range(250)}
    words |= {"x" * 300 + "y": 1, "x" * 300: 1, "x" * 301: 1, "𝒳bcdefgh": 1, "Ωbcdefgh": 1, "ab": 1}
    words = [(w, int(10 ** r.integers(0, 4))) for w in words]
    got = spelling.variants(spark.createDataFrame(words, "word string, n long").repartition(5), **limits)
    assert sorted((x.word, x.n, x.n_near, x.form, x.form_n, x.root) for x in got.collect()) == variants_brute(words)


def test_word_counts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    rows = [(BIG + k, "Überraschung straßenbahn ×abcdefg ABCDEFGH abcdefgh\U0001d4b3abcdefgh short ÀÉÎ " + "z" * 40_000) for k in range(70)] + [(None, "abcdefgh"), (1, None), (2, "")]
    got = {r.word: r.n for r in spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = Counter()
    for i, t in rows:
        for run in spelling.re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] += 1
    assert got == want


def tokens_of(text, a, b):
    if not text:
        return None
    ta, tb = a.encode([text])[0], b.encode([text])[0]
    if any(b"".join(s.pieces[i] for i in ids) != b" " + text.encode() for s, ids in ((a, ta), (b, tb))):
        return None
    return ta, tb


def align_brute(texts, a, b):
    """(n_a, n_b, groups, links) per text by walking both lists token by token."""
    out = []
    for text in texts:
        got = tokens_of(text, a, b)
        if got is None:
            out.append((0, 0, [], []))
            continue
        ends = [np.cumsum([len(s.pieces[i]) for i in ids]).tolist() for s, ids in zip((a, b), got)]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups = [tuple([i for i, e in zip(ids, en) if lo < e <= hi] for ids, en in zip(got, ends)) for lo, hi in zip([0, *both], both)]
        links = [(ga[-1], gb[-1]) for ga, gb in groups]
        out.append((len(got[0]), len(got[1]), groups, links))
    return out


ODD = ["<|endoftext|>", "<s>x</s> <unk>", "▁a ▁", "  two  blanks\n\n\ttab ", "naïve café 𝒳𝒴 日本語テキスト", "a\u0000b", "﻿bom", "don't DON'T 123456 ....", "é é ﬁ ²", "<0x41>", " ", "　wide space", "x" * 5000, "\r\n\x0b\x85"]


@pytest.mark.parametrize("pairs", [alignment.BROADCAST_PAIRS, 3])
@pytest.mark.parametrize("kind", [int, str])
def test_alignment(spark, monkeypatch, pairs, kind):
    texts = [t if t is None or len(t) < 9000 else t[:9000] for t in TEXTS] + ODD
    rows = [(BIG + k, t) for k, t in enumerate(texts)] + [(None, "some copy"), (None, "some copy")]
    rows = [(None if i is None else kind(i), t) for i, t in rows]
    docs = spark.createDataFrame(rows, f"doc_id {'long' if kind is int else 'string'}, text string").repartition(3)
    paths = alignment.default_tokenizers()
    got = alignment.aligned_documents(docs, *paths, broadcast_pairs=pairs).collect()
    brute = align_brute([t for _, t in rows], *alignment.sides(*paths))
    n = Counter(link for x in brute for link in x[3])
    top = {}
    for (_, b), m in n.items():
        top[b] = max(top.get(b, 0), m)
    want = []
    for (i, _), (na, nb, groups, links) in zip(rows, brute):
        line = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        sha = hashlib.sha256(line.encode()).hexdigest() if groups else ""
        want.append((i, na, nb, len(groups), len(links), sum(n[x] == top[x[1]] for x in links), sum(n[x] for x in links), sha))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == sorted(want, key=str)
    assert sum(x[1] == 0 for x in want) >= 3  # texts that a tokenizer does not give back


@pytest.mark.parametrize("lane", [1, 2, 7, 1000])
def test_lockstep_lanes(lane):
    a, b = alignment.sides(*alignment.default_tokenizers())
    texts = [t[:3000] for t in TEXTS if t] + ODD
    assert str(alignment.align_part(texts, a, b, lane)) == str(alignment.align_part(texts, a, b))


def test_parts_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 500)
    monkeypatch.setattr(alignment, "LONG_PART", 5)
    r = np.random.default_rng(6)
    signs = [*"abcdeAB019'.,!<>_-", *" " * 12, *"\n\t\r\x0b\x0c\x1c\x1f\x85\xa0", *"éßİıñ²½١日本ก\u0301\u200b\u3000\u2028\u180e\ufeff▁𝒳\U0001f600", "'s", "'LL", " the", "ing", "  ", "<s>"]
    texts = ["".join(r.choice(signs, r.integers(1, 30))) for _ in range(4000)] + ODD
    for side in alignment.sides(*alignment.default_tokenizers()):
        assert side.splits
        want = side.encode(texts)
        for k in range(0, len(texts), 700):
            some = texts[k : k + 700]
            parts = [alignment.SPLIT.split(t) for t in some]
            assert all(alignment.UNEVEN.search(t) or p == t.split(" ") for t, p in zip(some, parts))
            for t, ids, w in zip(some, side.ids_of(some, parts), want[k : k + 700]):
                same = b"".join(side.pieces[i] for i in w) == b" " + t.encode()
                assert (ids is not None) == same and (not same or ids.tolist() == w), repr(t)


def test_edge_table(spark, edge):
    docs = table(spark, edge, "documents")
    assert spelling.op12_spelling(spark, edge).where("n_near < 0").count() == 0
    assert alignment.op13_alignment(spark, edge).count() == docs.count()
