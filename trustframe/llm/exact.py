"""Exact dedup: two-pass Bloom filtering.

Pass one reads the texts once, keeps a narrow row (id, digest) of each, and marks in a Bloom filter of two
bits a place which places were hit once and which twice or more.  Equal digests hit equal places, so a digest
with a place hit once only has no copy.  Pass two lets these rows straight through; only the others, possibly
repeated, are shuffled and counted by their digest.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, row_key, stored, table, whole

PLACES_PER_ROW, PROBES = 16, 4  # about 0.3 % of the rows without a copy are shuffled all the same
# Bound of the broadcast (an eighth of it in bytes).  Beyond, more rows are shuffled; the result stays the same.
MAX_PLACES = 1 << 30
SLICE_BYTES = 1 << 16
BUILD_TASKS = 256
HOT_SHARE = 20_000  # groups above 1 / HOT_SHARE of the rows, at most so many, are broadcast


def digest(text: str | Column = "text") -> Column:
    """SHA-256 of the text with A-Z in lower case; NULL is empty."""
    return F.unhex(F.sha2(ascii_lower(whole(text)), 256))


def probes(digests: list[bytes], places: int) -> np.ndarray:
    """(digests, PROBES) places; ``places`` is a power of two."""
    words = np.frombuffer(b"".join(digests), np.uint64).reshape(len(digests), 4)
    step = words[:, 1:2] | np.uint64(1)
    with np.errstate(over="ignore"):
        at = words[:, :1] + np.arange(PROBES, dtype=np.uint64) * step
    return (at & np.uint64(places - 1)).astype(np.int64)


def set_bits(bits: np.ndarray, places: np.ndarray) -> None:
    """Set the bits at sorted distinct ``places``."""
    if len(places):
        byte, starts = np.unique(places >> 3, return_index=True)
        bits[byte] |= np.bitwise_or.reduceat((1 << (places & 7)).astype(np.uint8), starts)


def places_for(rows: int, most: int = MAX_PLACES) -> int:
    """Filter size: a power of two, at least a slice, at most ``most``."""
    return min(max(1 << (max(rows, 1) * PLACES_PER_ROW - 1).bit_length(), 8 * SLICE_BYTES), most)


def repeated_places(digests: DataFrame, rows: int, most: int = MAX_PLACES) -> np.ndarray:
    """Bitmap of the places that the ``digest`` column hits twice or more, summed up by tasks slice by slice."""
    places = places_for(rows, most)
    part = min(SLICE_BYTES, places // 8)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros(places // 8, np.uint8) for _ in range(2))
        for batch in batches:
            # a digest's own places differ, as the step is odd and their number a power of two
            at, n = np.unique(probes(batch.column(0).to_pylist(), places), return_counts=True)
            fresh = np.zeros_like(once)
            set_bits(fresh, at)
            twice |= once & fresh
            set_bits(twice, at[n > 1])
            once |= fresh
        for k in np.nonzero(once.reshape(-1, part).any(1))[0].tolist():
            both = [zlib.compress(x[k * part : (k + 1) * part].tobytes(), 1) for x in (once, twice)]
            yield pa.RecordBatch.from_pydict({"slice": [k], "once": both[:1], "twice": both[1:]}, pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"slice": [now], "twice": [zlib.compress(twice.tobytes(), 1)]}, pa.schema([("slice", pa.int32()), ("twice", pa.binary())]))

        for batch in batches:
            for k, a, b in zip(*(batch.column(c).to_pylist() for c in range(3))):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if k != now:
                    if now is not None and twice.any():
                        yield done()
                    now, once, twice = k, a.copy(), b.copy()
                else:
                    twice |= b | once & a
                    once |= a
        if now is not None and twice.any():
            yield done()

    slices = digests.select("digest").coalesce(BUILD_TASKS).mapInArrow(mark, "slice int, once binary, twice binary")
    merged = slices.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, twice binary")
    out = np.zeros(places // 8, np.uint8)
    for r in merged.toLocalIterator():  # the filter, slice by slice: at most ``most`` / 8 bytes
        out[r["slice"] * part : (r["slice"] + 1) * part] = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
    return out


def maybe_repeated(spark: SparkSession, bitmap: np.ndarray) -> Callable[[Column], Column]:
    """Tests digests against the broadcast bitmap; false says that a digest occurs once."""
    known, places = spark.sparkContext.broadcast(bitmap), 8 * len(bitmap)

    @F.pandas_udf("boolean")
    def test(digests: pd.Series) -> pd.Series:
        at = probes(list(digests), places)
        return pd.Series((known.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(1) if len(at) else np.zeros(0, bool))

    return test


def groups_of(rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(frequent, other) groups of ``rows`` (digest, ident, mark): digest, top (largest ident, then mark), size.

    Sums are formed in the tasks first.  Frequent groups are bounded in number by ``HOT_SHARE``.
    """
    g = rows.groupBy("digest").agg(F.max(F.struct("ident", "mark")).alias("top"), F.count(F.lit(1)).alias("size"))
    g = stored(g, "exact-groups")
    hot = F.col("size") > max(1000, total // HOT_SHARE)
    return g.where(hot), g.where(~hot)


def with_groups(rows: DataFrame, frequent: DataFrame, other: DataFrame) -> DataFrame:
    """``rows`` with their group's facts; rows of frequent groups stay where they are."""
    few = F.broadcast(frequent)
    return rows.join(few, "digest").unionByName(rows.join(few.select("digest"), "digest", "left_anti").join(other, "digest"))


def decide(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_places: int = MAX_PLACES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    NULL text counts as empty.  Of equal texts the row with the largest id stays; NULL ids are smaller than
    any other, and of rows that repeat the largest id one stays (``keep_id`` is NULL where all ids are).  Every
    row counts in ``group_size``.  Ids may be of any ordered type.  Other columns are ignored; an empty table
    gives no row.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).alias("ident"), digest(F.col(text)).alias("digest"), F.monotonically_increasing_id().alias("mark"))
    d = stored(d, "exact-digests")  # narrow: pass two reads no text
    total = d.count()
    test = maybe_repeated(spark, repeated_places(d, total, max_places))
    d = stored(d.withColumn("maybe", test("digest")), "exact-tested")
    alone, rows = d.where(~F.col("maybe")), d.where("maybe")
    rows = with_groups(rows, *groups_of(rows, total))
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    one = F.lit(1).cast("long").alias("group_size")
    alone = alone.select(F.col("ident").alias("doc_id"), F.col("ident").alias("keep_id"), one, F.lit(True).alias("kept"), sha)
    stays = (F.col("mark") == F.col("top.mark")).alias("kept")
    return alone.union(rows.select(F.col("ident").alias("doc_id"), F.col("top.ident").alias("keep_id"), F.col("size").alias("group_size"), stays, sha))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_places: int = MAX_PLACES) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged; rules as in ``decide``.

    Rows without a copy are not shuffled.  Of rows that share the largest id but differ in case the one with
    the largest text digest stays; of rows equal in id and text one stays, whatever their other columns hold.
    """
    spark = docs.sparkSession
    d_name, maybe_name, mark_name = (free_name(docs, c) for c in ("_digest", "_maybe", "_mark"))
    narrow = docs.select(F.col(doc_id).alias("ident"), digest(F.col(text)).alias("digest"), row_key(doc_id, text).alias("mark"))
    narrow = stored(narrow, "exact-digests")
    total = narrow.count()
    test = maybe_repeated(spark, repeated_places(narrow, total, max_places))
    frequent, other = groups_of(narrow.where(test("digest")), total)
    chosen = frequent.union(other).select(F.col("top.mark").alias(mark_name))
    d = docs.withColumn(d_name, digest(F.col(text))).withColumn(maybe_name, test(F.col(d_name))).drop(d_name)
    rows = d.where(F.col(maybe_name)).withColumn(mark_name, row_key(doc_id, text))
    rows = rows.join(chosen, mark_name, "left_semi").dropDuplicates([mark_name])
    return d.where(~F.col(maybe_name)).drop(maybe_name).unionByName(rows.drop(maybe_name, mark_name))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "documents"))


SQL = """WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)"""
