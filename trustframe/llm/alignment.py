"""Cross-tokenizer alignment: lockstep vectorised merging.

A text's tokens under two tokenizers are two rising lists of byte offsets, their ends.  One NumPy state vector
holds a pair of pointers for every document of a batch (long ones take several lanes); each step compares the
two ends of all lanes, emits a link and a cut where they are equal, moves the pointer behind, and drops lanes
that are done.  Cuts part the tokens into groups.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, up_to

PART_BYTES = 500_000
LANE_TOKENS = 256
# A blank behind a word (and not at the end) starts a new part, whose first blank is dropped.
SPLIT, UNEVEN = re.compile(r"(?<=\S) (?!\Z)"), re.compile(r"\s |\A | \Z")
WORD = re.compile(r"\S+").fullmatch
REMEMBERED, LONG_PART, TOGETHER = 500_000, 64, 64
# Pairs that one broadcast table may hold (24 bytes each); more are joined.
BROADCAST_PAIRS = 1_000_000
SALTS = 16


def byte_alphabet() -> dict[str, int]:
    """Byte by character of byte-level vocabularies: printable Latin-1 is itself, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """A tokenizer: ``encode`` gives the ids of texts, ``pieces`` the bytes of each id.

    ``splits`` says that no token reaches over a blank behind a word, so that a text's ids are those of its
    parts in a row.  Ids of parts are remembered, up to about ``REMEMBERED`` of them.
    """

    def __init__(self, pieces: list[bytes], splits: bool):
        if not all(pieces):
            raise ValueError("a token without bytes has no place in a text")
        self.pieces = pieces
        self.size = np.array([len(p) for p in pieces], np.int64)
        digits = [str(i).encode() for i in range(len(pieces))]
        self.wide = max(map(len, digits), default=1)
        self.digits = np.array(digits, f"S{self.wide + 1}").view(np.uint8).reshape(len(digits), -1)
        self.n_digits = np.array([len(d) for d in digits], np.int64)
        self.splits, self.known, self.odd = splits, {}, set()

    def encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def text_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        """Packed ids of new parts.  Plain words are encoded many at a time and cut where their bytes end."""
        out, single = {}, []
        words = [p for p in parts if WORD(p)] if self.splits else []
        single = [p for p in parts if not WORD(p)] if self.splits else parts
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        for group, ids in zip(groups, self.encode([" ".join(g) for g in groups])):
            if self.text_bytes(ids) != b" " + " ".join(group).encode():
                single += group
                continue
            packed = np.array(ids, np.int32)
            stops = np.cumsum([len(p.encode()) + 1 for p in group])
            ends = np.searchsorted(np.cumsum(self.size[packed]), stops) + 1
            raw, at = packed.tobytes(), 0
            for p, end in zip(group, (4 * ends).tolist()):
                out[p] = raw[at:end]
                at = end
        for p, ids in zip(single, self.encode(single)):
            out[p] = np.array(ids, np.int32).tobytes()
            if self.text_bytes(ids) != b" " + p.encode():
                self.odd.add(p)
        return out

    def ids_of(self, texts: list[str], parts: list[list[str]]) -> list[np.ndarray | None]:
        """Ids of each text, given as its parts too; None where their bytes are not a blank and the text."""
        parts = parts if self.splits else [[t] for t in texts]
        words = set().union(*parts)
        fresh = self.learn(list(words.difference(self.known)))
        self.known.update(fresh)
        look, out = self.known.__getitem__, []
        for t, ps in zip(texts, parts):
            ids = np.frombuffer(b"".join(map(look, ps)), np.int32)
            fits = self.odd.isdisjoint(ps) or self.text_bytes(ids.tolist()) == b" " + t.encode()
            out.append(ids if fits else None)
        full = len(self.known) - len(fresh) >= REMEMBERED  # frequent parts come early
        for p in fresh if full else [p for p in fresh if len(p) > LONG_PART]:
            del self.known[p]
            self.odd.discard(p)
        return out


class ByteLevel(Side):
    """Byte-level BPE of a tokenizers file, over a blank and the text; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        of, vocab = byte_alphabet(), self.model.get_vocab()
        names = {i: t for t, i in vocab.items()}
        form = json.loads(self.model.to_str())
        cut = form["pre_tokenizer"] or {}
        # the byte-level rule ends a token before any white space, and only one blank may lead the next one
        splits = form["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
        super().__init__([bytes(map(of.__getitem__, names[i])) if i in names else b"\0" for i in range(max(names) + 1)], splits)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces(Side):
    """A sentencepiece model, which sets a blank before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        # merges stay inside pieces of the vocabulary: none may hold a blank behind something else
        splits = not any("▁" in p.lstrip("▁") for i, p in enumerate(names) if not m.is_control(i))
        super().__init__([bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)], splits)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    """Both tokenizers, loaded once in a Python worker."""
    return ByteLevel(a_path), Pieces(b_path)


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_from: np.ndarray, b_from: np.ndarray, a_to: np.ndarray, b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of equal ends, lane k merging a[a_from:a_to] with b[b_from:b_to]; in rising order."""
    pa_, pb_ = a_from.copy(), b_from.copy()
    links_a, links_b = [], []
    while True:
        going = (pa_ < a_to) & (pb_ < b_to)
        if not going.all():  # finished lanes leave the state vector
            pa_, pb_, a_to, b_to = pa_[going], pb_[going], a_to[going], b_to[going]
        if not len(pa_):
            break
        ea, eb = a_end[pa_], b_end[pb_]
        same = ea == eb
        links_a.append(pa_[same])
        links_b.append(pb_[same])
        pa_ += ea <= eb
        pb_ += eb <= ea
    a, b = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (links_a, links_b))
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def lanes(first: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """Positions at which lanes start: each document's first token and every ``size``-th one after it."""
    n = -(-count // size)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first, n) + k * size


def group_text(a: Side, b: Side, a_ids: np.ndarray, b_ids: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``a1,a2|b1;...`` for all tokens and the number of bytes up to each group's end (its ';' included)."""
    na, nb = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)  # tokens of the groups
    # each token's place in the output: the groups' a tokens, then their b tokens
    at_a = np.arange(len(a_ids)) + np.repeat(np.cumsum(nb) - nb, na)
    at_b = np.arange(len(b_ids)) + np.repeat(np.cumsum(na), nb)
    wide = max(a.wide, b.wide) + 1
    cells = np.zeros((len(a_ids) + len(b_ids), wide), np.uint8)
    used = np.zeros(len(cells), np.int64)
    for side, ids, at, cut, last in ((a, a_ids, at_a, cut_a, b"|"), (b, b_ids, at_b, cut_b, b";")):
        sign = np.full(len(ids), ord(","), np.uint8)
        sign[cut] = ord(last)
        cells[at, : side.wide] = side.digits[ids, : side.wide]
        cells[at, side.n_digits[ids]] = sign
        used[at] = side.n_digits[ids] + 1
    flat = cells[np.arange(wide) < used[:, None]]
    return flat, np.cumsum(used)[at_b[cut_b]] if len(cut_b) else np.empty(0, np.int64)


def align_part(texts: list[str | None], a: Side, b: Side, lane_tokens: int = LANE_TOKENS) -> dict[str, list]:
    """Columns n_a, n_b, n_groups, sha, pairs, times for a list of texts; the last two list each text's distinct linked ids."""
    n = len(texts)
    out = {"n_a": [0] * n, "n_b": [0] * n, "n_groups": [0] * n, "sha": [""] * n, "pairs": [[]] * n, "times": [[]] * n}
    some = [k for k, t in enumerate(texts) if t]
    if not some:
        return out
    whole = [texts[k] for k in some]
    parts = [SPLIT.split(t) if UNEVEN.search(t) else t.split(" ") for t in whole]
    all_a, all_b = (s.ids_of(whole, parts) for s in (a, b))
    good = [k for k in range(len(some)) if all_a[k] is not None and all_b[k] is not None]
    if not good:
        return out
    na, nb = (np.array([len(x[k]) for k in good], np.int64) for x in (all_a, all_b))
    a_ids, b_ids = (np.concatenate([x[k] for k in good]).astype(np.int64) for x in (all_a, all_b))
    a_end, b_end = np.cumsum(a.size[a_ids]), np.cumsum(b.size[b_ids])  # offsets in the joined texts; each text ends both lists
    stop_a, stop_b = np.cumsum(na), np.cumsum(nb)
    a_from = lanes(stop_a - na, na, lane_tokens)
    a_to = np.append(a_from[1:], len(a_ids))
    b_to = np.searchsorted(b_end, a_end[a_to - 1], "right")  # b tokens that end with the lane or before
    b_from = np.concatenate([[0], b_to[:-1]])
    at_a, at_b = lockstep(a_end, b_end, a_from, b_from, a_to, b_to)
    text, upto = group_text(a, b, a_ids, b_ids, at_a, at_b)
    group_stop = np.searchsorted(at_a, stop_a, "left")  # groups up to the text's end
    raw, last = text.tobytes(), 0
    doc = np.repeat(np.arange(len(good)), np.diff(group_stop, prepend=0))
    width = len(b.pieces)
    span = len(a.pieces) * width
    keys, times = np.unique(doc * span + a_ids[at_a] * width + b_ids[at_b], return_counts=True)
    stops = np.searchsorted(keys, (np.arange(len(good)) + 1) * span, "left")
    lo = 0
    for i, k in enumerate(good):
        row, end, hi = some[k], int(upto[group_stop[i] - 1]), int(stops[i])
        out["n_a"][row], out["n_b"][row], out["n_groups"][row] = int(na[i]), int(nb[i]), int(group_stop[i] - (group_stop[i - 1] if i else 0))
        out["sha"][row] = hashlib.sha256(raw[last : end - 1]).hexdigest()
        out["pairs"][row], out["times"][row] = keys[lo:hi] - i * span, times[lo:hi]
        last, lo = end, hi
    return out


ALIGNED = "n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups_sha256, pairs, times`` for every row of ``docs``.

    ``pairs`` lists a text's distinct linked ids (a id times the size of b's vocabulary plus b id), ``times`` how
    often.  Texts that are NULL or empty, or whose tokens' bytes are not a blank and the text, have no tokens:
    zeros, an empty hash and no pairs.  Repeated rows and NULL ids keep their rows, other columns are ignored, an
    empty table gives no row.  Ids of any type pass untouched.  Memory follows the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(a_path, b_path)
        for batch in batches:
            texts = batch.column(1)
            part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // PART_BYTES
            starts = np.unique(part, return_index=True)[1].tolist()
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
                got = align_part(texts.slice(lo, hi - lo).to_pylist(), a, b)
                kinds = [pa.int64()] * 3 + [pa.string()] + [pa.list_(pa.int64())] * 2
                cols = [batch.column(0).slice(lo, hi - lo), *[pa.array(got[c], k) for c, k in zip(got, kinds)]]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ident = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {ident}, {ALIGNED}")


def flat_pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, times, end of each row's entries) of a batch's list columns."""
    pairs, times = batch.column("pairs"), batch.column("times")
    return pairs.flatten().to_numpy(), times.flatten().to_numpy(), np.cumsum(pc.list_value_length(pairs).to_numpy(zero_copy_only=False).astype(np.int64))


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """``pair, n, best``: links that hold the pair in the corpus; ``best`` says that no pair of its b id has more."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times, _ = flat_pairs(batch)
            keys, at = np.unique(pairs, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, times)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(total)], ["pair", "n"])

    n = aligned.select("pairs", "times").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    n = stored(n.withColumn("b", F.pmod("pair", F.lit(width)).cast("int")), "align-pairs")
    top = n.groupBy("b").agg(F.max("n").alias("top"))  # one row per id of b's vocabulary
    return n.join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def link_counts(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` in place of its lists.

    A table of at most ``broadcast_pairs`` pairs goes to all tasks; a larger one is joined, rows of a pair salted.
    """
    kept = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    spark, schema = aligned.sparkSession, aligned.schema
    if up_to(counts, broadcast_pairs):
        t = counts.orderBy("pair").toArrow()
        known = spark.sparkContext.broadcast([t[c].to_numpy() for c in ("pair", "n", "best")])

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, n, best = known.value
            for batch in batches:
                pairs, times, ends = flat_pairs(batch)
                at = np.searchsorted(keys, pairs)
                sums = []
                for value in (times * best[at], times * n[at]) if len(keys) else (times, times):
                    upto = np.concatenate([[0], np.cumsum(value)])[ends]
                    sums.append(pa.array(np.diff(upto, prepend=0).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *sums], [*kept, "n_best", "count_sum"])

        types = ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in kept)
        return aligned.mapInArrow(look_up, f"{types}, n_best long, count_sum long")
    rows = aligned.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("rid", F.col("p.pairs").alias("pair"), "p.times")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    j = rows.join(salted, ["pair", "salt"])
    sums = j.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return aligned.join(sums, "rid", "left").select(*kept, *zero)


def aligned_documents(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row; rules as in ``align``.

    A link is an occurrence of an a and a b token that end together, so there is one in every group.  ``n_best``
    counts the links whose pair no other a id beats for this b id in the corpus (ties count), ``count_sum`` adds
    the corpus-wide counts of the links' pairs.  The texts are read and encoded once.
    """
    aligned = stored(align(docs, a_path, b_path, doc_id, text).withColumn("rid", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(aligned, len(sides(a_path, b_path)[1].pieces)), "align-counts")
    out = link_counts(aligned, counts, broadcast_pairs)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(table(spark, sf_dir, "documents"), *default_tokenizers())
