"""Line dedup: levelled sorted runs of line hashes.

A run holds (h1, h2, n, last): a 128-bit line hash, the number of documents with the line and the largest
id among them.  Runs are bucketed and sorted by hash, so merging two of them and anti-joining a batch with
one needs no shuffle of the run.  A level that holds ``fan_in`` runs is merged into one run of the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, scratch, stored, table, up_to, whole

STRIP = "\t\n\x0b\f\r "
MIN_CHARS, MIN_DOCS = 20, 3
BATCHES, FAN_IN = 4, 2
BROADCAST_KEYS = 500_000
KEY = ["h1", "h2"]


def line_hash(line: Column) -> Column:
    """Hash pair of a line's key, NULL for keys that are too short to count."""
    key = ascii_lower(F.btrim(line, F.lit(STRIP)))
    pair = F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))
    return F.when(F.length(key) >= MIN_CHARS, pair)


def doc_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, th, h1, h2) per document row and distinct counted key; ``th`` hashes the text."""
    keys = F.array_compact(F.array_distinct(F.transform(F.split(whole(text), "\n", -1), line_hash)))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.explode(keys).alias("k"))
    return d.select("doc_id", "th", "k.h1", "k.h2")


class LineRuns:
    """The levelled store; ``levels[i]`` lists the runs of level i."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN, buckets: int | None = None):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        out = run.repartition(self.buckets, *KEY)
        out.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", scratch(self.spark, name)).format("parquet").saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def add(self, lines: DataFrame) -> None:
        """Aggregate a batch's lines into a run of level 0 and compact full levels."""
        self._put(0, lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._write(run))
        if len(self.levels[level]) >= self.fan_in:
            names, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merge([self.spark.table(n) for n in names]))
            for n in names:
                self.spark.sql(f"DROP TABLE IF EXISTS {n}")

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            r = r.select(*KEY, F.col("n").alias("n2"), F.col("last").alias("last2"))
            j = out.join(r, KEY, "full")
            n = F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))
            out = j.select(*KEY, n.alias("n"), F.greatest("last", "last2").alias("last"))  # greatest skips NULL
        return out

    def merged(self) -> DataFrame | None:
        runs = self.runs()
        return self._merge(runs) if runs else None

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The lines of a batch that no run holds (merge-anti-join with every run)."""
        for run in self.runs():
            lines = lines.join(run, KEY, "left_anti")
        return lines


def find_repeats(lines: DataFrame, batches: int = BATCHES, min_docs: int = MIN_DOCS) -> DataFrame:
    """Keys of at least ``min_docs`` documents: (h1, h2, last)."""
    runs = LineRuns(lines.sparkSession)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b))
    return runs.merged().where(F.col("n") >= min_docs).select(*KEY, "last")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` (the text that stays) for every row.

    A counted line that at least ``min_docs`` rows hold stays only in the row with the largest id.  NULL or
    empty text is one empty line.  Every row counts as a document: rows with the largest id that repeat all
    keep the line; a NULL id is smaller than any other, and lines found under NULL ids only stay.  Other
    columns are ignored; an empty table gives no row.  Rows with equal id and text share their decisions.
    """
    spark = docs.sparkSession
    path = scratch(spark, "line-keys")
    lines = doc_lines(docs, doc_id, text)
    batch = F.pmod(F.xxhash64("doc_id", "th"), F.lit(batches)).cast("int")
    lines.withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    schema = "doc_id {}, th long, h1 long, h2 long, batch int".format(docs.schema[doc_id].dataType.simpleString())
    lines = spark.read.schema(schema).parquet(path)
    repeats = stored(find_repeats(lines, batches, min_docs), "line-repeats")
    if up_to(repeats, BROADCAST_KEYS):
        repeats = F.broadcast(repeats)
    drop = lines.join(repeats, KEY).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    drop = drop.groupBy("doc_id", "th").agg(F.collect_set("h1").alias("_drop"))  # bounded by the lines of one text
    d = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_th"), whole(text).alias("_text"))
    j = d.join(drop, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_th") == F.col("th")), "left")
    parts = F.split("_text", "\n", -1)
    stays = F.filter(parts, lambda x: ~F.coalesce(F.array_contains("_drop", line_hash(x)["h1"]), F.lit(False)))
    stays = F.when(F.col("_drop").isNull(), parts).otherwise(stays)
    out = j.select(F.col("_id").alias("doc_id"), F.size(parts).cast("long").alias("n_lines"), stays.alias("_stays"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("_stays")).alias("n_dropped"), F.array_join("_stays", "\n").alias("kept"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, i, ls[i] AS line, regexp_replace(regexp_replace(translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS k FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
r AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT rid) >= 3),
m AS (SELECT l.*, r.k IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone FROM l LEFT JOIN r USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY rid, doc_id"""
