"""Spelling variants: dense prefix-suffix tiling.

Two words differ by one inserted, deleted or replaced code point exactly when their common prefix and common
suffix together reach the longer length minus one.  Words are padded into code-point matrices, and blocks of
rows are compared with each other column by column.  Only blocks that can hold such pairs meet: the edit lies
in one of ``PIECES`` pieces of the shorter word, and everything outside this piece is equal.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lookup import spread
from .common import stored, table, up_to

RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
NOISE = 31
HELD_WORDS = 300_000
PIECES = 2
# Words of a block, cells (words x length) of a block and of a matrix, pairs compared at once.
BLOCK_WORDS, BLOCK_CELLS, MATRIX_CELLS, PAIRS = 4096, 2_000_000, 2_000_000, 200_000
BROADCAST_ROWS = 200_000
TILE = ["short", "piece", "bucket", "i", "j"]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, noise: int = NOISE) -> DataFrame:
    """``word, n`` over all texts: maximal letter runs, A-Z in lower case, of at least ``min_chars`` code points.

    A run whose crc32 (with its document's id) ``noise`` divides loses one code point first; 0 leaves all runs
    as they are.  NULL and empty texts have no runs; a NULL id is written as nothing.  Repeated rows count each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            some = [(w, n) for w, n in total.items() if n]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["word", "n"])

        for batch in batches:
            for ident, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not raw.is_valid:
                    continue
                runs = [r for r in RUN.findall(raw.as_py().translate(LOWER).decode("utf-8", "replace")) if len(r) >= min_chars]
                total.update(runs)
                head = zlib.crc32(f"{ident or ''}:".encode())
                for run in set(runs) if noise else ():
                    h = zlib.crc32(run.encode(), head)
                    if h % noise == 0:
                        n, at = runs.count(run), h % len(run)
                        total[run] -= n
                        if len(run) > min_chars:
                            total[run[:at] + run[at + 1 :]] += n
                if len(total) >= HELD_WORDS:
                    yield flush()
        if total:
            yield flush()

    d = docs.select(F.col(doc_id).cast("string").alias("ident"), F.col(text).cast("binary").alias("raw"))
    return d.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bucketed(words: DataFrame, pieces: int) -> DataFrame:
    """Rows (short, piece, bucket, word, n): a word under the lengths and pieces in which it can meet another one.

    ``short`` is the shorter word's length: a word stands under its own and the next smaller one.
    """
    size, short, piece = F.length("word"), F.col("short"), F.col("piece")
    start, end = (F.floor((piece + k) * short / pieces).cast("int") for k in (0, 1))
    own = F.concat_ws("\u0001", F.substr("word", F.lit(1), start), F.substr("word", size - (short - end) + 1, short - end))
    d = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("short")).where("short > 0")
    d = d.select("*", F.explode(F.array(*[F.lit(k) for k in range(pieces)])).alias("piece"))
    return d.select("short", "piece", F.xxhash64(own).alias("bucket"), "word", "n")


def tiles(rows: DataFrame, block_words: int = BLOCK_WORDS, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """``rows`` with i, j and their own block: large buckets are cut into blocks and every pair of blocks is a tile."""
    key = TILE[:3]
    most = F.least(F.lit(block_words), F.greatest(F.lit(2), F.floor(F.lit(block_cells) / F.col("short"))))
    blocks = F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks")
    large = stored(rows.groupBy(*key).agg(blocks).where("blocks > 1"), "spelling-large")
    large = F.broadcast(large) if up_to(large, BROADCAST_ROWS) else large
    d = rows.join(large, key, "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("word"), F.col("blocks")), F.lit(0)).cast("int"))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    d = d.withColumn("other", F.explode(others))
    return d.select(*key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "word", "n")


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points from the left, from the right, lengths), padded with 0."""
    left = np.array(words)
    left = left.view(np.uint32).reshape(len(words), -1)
    if left.max(initial=0) < 256:
        left = left.astype(np.uint8)
    size = (left != 0).sum(1)
    back = size[:, None] - 1 - np.arange(left.shape[1])
    right = np.where(back >= 0, np.take_along_axis(left, np.maximum(back, 0), 1), 0).astype(left.dtype)
    return left, right, size


def common(m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Columns before the first difference of rows ``a`` and ``b``."""
    return (m[a] != m[b]).argmax(1)


def near_pairs(words: list[str], tile: np.ndarray, own: np.ndarray, short: np.ndarray, piece: np.ndarray, pieces: int, split: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of near words among rows sorted by ``tile``; each pair in the first piece that shows it.

    ``split`` marks tiles of two blocks, in which only rows of different blocks are compared.
    """
    left, right, size = matrices(words)
    n = len(words)
    last = np.searchsorted(tile, tile, "right")  # end of the row's tile
    todo = last - np.arange(n) - 1
    upto = np.cumsum(todo)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
        some = todo[lo:hi]
        a = np.repeat(np.arange(lo, hi), some)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(some) - some, some)
        lo = hi
        fits = (np.minimum(size[a], size[b]) == short[a]) & (~split[a] | (own[a] != own[b]))
        a, b = a[fits], b[fits]
        head, tail = common(left, a, b), common(right, a, b)
        near = head + tail >= np.maximum(size[a], size[b]) - 1
        a, b, head, tail = a[near], b[near], head[near], tail[near]
        first = np.ones(len(a), bool)
        for k in range(pieces - 1):  # the same pair meets again in every other piece that leaves the rest equal
            s = short[a]
            first &= ~((piece[a] > k) & (head >= k * s // pieces) & (tail >= s - (k + 1) * s // pieces))
        yield a[first], b[first]


def partners(tiled: DataFrame, pieces: int) -> DataFrame:
    """(word, n_near, best): near words found per word, ``best`` = (-n, word) of the most frequent one; summed up per matrix."""

    def neighbours(rows: pa.Table) -> pa.RecordBatch:
        words, n = rows["word"].to_pylist(), rows["n"].to_numpy()
        key = np.stack([rows[c].to_numpy() for c in TILE])
        tile = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(0))])
        found = list(near_pairs(words, tile, rows["own"].to_numpy(), key[0], key[1], pieces, key[3] != key[4]))
        a, b = (np.concatenate([f[k] for f in found] + [np.empty(0, np.int64)]).astype(np.int64) for k in (0, 1))
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.array(words, object)
        rank = np.empty(len(words), np.int64)
        used = np.unique(b)
        rank[used] = np.argsort(np.argsort(order[used], kind="stable"), kind="stable")  # Python compares by code point
        by = np.lexsort((rank[b], -n[b], a))
        a, b = a[by], b[by]
        who, at, times = np.unique(a, return_index=True, return_counts=True)
        best = b[at]
        cols = [pa.array(order[who], pa.string()), pa.array(times, pa.int64()), pa.array(-n[best], pa.int64()), pa.array(order[best], pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["word", "k", "neg", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = np.stack([held[c].to_numpy() for c in TILE])
            ends = np.nonzero((key[:, 1:] != key[:, :-1]).any(0))[0] + 1  # a tile that may go on is held back
            lo = 0
            while len(ends) and lo < ends[-1]:
                # whole tiles whose padded matrix stays in bounds; rows are sorted by length
                fits = ends[(ends > lo) & ((ends - lo) * (key[0][ends - 1] + 1) <= MATRIX_CELLS)]
                hi = int(fits[-1] if len(fits) else ends[ends > lo][0])
                yield neighbours(held.slice(lo, hi - lo))
                lo = hi
            held = held.slice(lo)
        if held is not None and held.num_rows:
            yield neighbours(held)

    d = spread(tiled, *TILE).sortWithinPartitions(*TILE)
    got = d.mapInArrow(run, "word string, k long, neg long, near string")
    return got.groupBy("word").agg(F.sum("k").alias("n_near"), F.min(F.struct("neg", "near")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the end of the chain word -> form -> ..., by pointer jumping.

    A form is at least ``ratio`` times as frequent as its word, so chains are short and have no cycles.
    """
    chain = stored(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "spelling-chain")
    while True:
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(chain.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-chain")
        chain = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return chain


def variants(words: DataFrame, ratio: int = RATIO, pieces: int = PIECES, block_words: int = BLOCK_WORDS, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every row of ``words`` (word, n), words distinct.

    Near words differ by exactly one inserted, deleted or replaced code point.  The form is the near word of
    largest n (ties: the smallest in code-point order) if that is at least ``ratio`` times the word's n, else
    NULL.  NULL and empty words have no near words.  Words must not hold U+0000.  Empty tables give no row.
    """
    words = stored(words.select("word", "n"), "spelling-words")
    d = tiles(bucketed(words.where(F.length("word") > 0), pieces), block_words, block_cells)
    near = partners(d, pieces)
    j = words.join(near, "word", "left")
    has = -F.col("best.neg") >= ratio * F.col("n")
    out = j.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.neg")).alias("form_n"))
    out = stored(out, "spelling-forms")
    return out.join(roots(out), "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_spellings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, noise: int = NOISE) -> DataFrame:
    """``variants`` of the words of whole texts that occur at least ``min_count`` times; see ``word_counts``."""
    return variants(word_counts(docs, doc_id, text, min_chars, noise).where(F.col("n") >= min_count), ratio)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents"))


SQL = r"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
occ AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, r, count(*) AS k FROM run WHERE length(r) >= 7 GROUP BY ALL),
byt AS (SELECT r, k, flatten(list_transform(string_split(d || ':' || r, ''), lambda c:
  CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b FROM occ),
crc AS (SELECT r, k, xor(list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM byt, tab),
wrd AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, k FROM crc),
w AS (SELECT word, sum(k)::BIGINT AS n FROM wrd WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
del AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS g FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, a.n, b.word AS x, b.n AS m FROM del a JOIN del b USING (i, g) WHERE a.word <> b.word
  UNION SELECT del.word, del.n, w.word, w.n FROM del JOIN w ON del.g = w.word UNION SELECT w.word, w.n, del.word, del.n FROM del JOIN w ON del.g = w.word),
top AS (SELECT word, count(*) AS n_near, max(m) AS best FROM near GROUP BY word),
frm AS (SELECT near.word, min(x) AS form, m AS form_n FROM near JOIN top USING (word) WHERE m = best AND m >= 10 * n GROUP BY near.word, m),
fol AS (SELECT word, form AS root FROM frm UNION ALL SELECT fol.word, frm.form FROM fol JOIN frm ON fol.root = frm.word),
fin AS (SELECT word, root FROM fol WHERE root NOT IN (SELECT word FROM frm))
SELECT word, n, coalesce(n_near, 0) AS n_near, form, form_n, coalesce(root, word) AS root FROM w LEFT JOIN top USING (word) LEFT JOIN frm USING (word) LEFT JOIN fin USING (word)"""
