"""How the test tables stand in for embeddings, streams, points, frames and tokens.

Each view has a DataFrame form and the same thing as SQL common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranks import rank_in_group

DIM = 64
START = 20
SHIFT = 3.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str | None = None):
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or (c if isinstance(c, str) else None)) if (name or isinstance(c, str)) else out


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").alias("family"), F.col("embedding").cast("array<double>").alias("z"),
        (v % 4).alias("scope"), (v % 5 + 1).alias("severity"), (F.col("label") * 2 + v % 2).alias("corruption"),
    )


EMB = """emb AS (
  SELECT vec_id, label AS family, embedding::DOUBLE[] AS z, vec_id % 4 AS scope, vec_id % 5 + 1 AS severity,
         label * 2 + vec_id % 2 AS corruption
  FROM embeddings)"""
LONG = EMB + """,
long AS (
  SELECT vec_id, family, scope, severity, corruption, unnest(range(0, len(z))) AS dim, unnest(z) AS v FROM emb)"""
# Deltas: the k-th non-clean row (family <> 0) minus clean row k mod n_clean, both by vec_id.
DELTA = LONG + """,
bad AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM emb WHERE family <> 0),
good AS (SELECT vec_id AS clean_id, z AS z_clean, row_number() OVER (ORDER BY vec_id) - 1 AS slot FROM emb WHERE family = 0),
paired AS (
  SELECT bad.*, z_clean, clean_id FROM bad JOIN good ON good.slot = bad.k % (SELECT count(*) FROM good)),
dl AS (
  SELECT vec_id, family, scope, severity, corruption, unnest(range(0, len(z))) AS dim, unnest(z) - unnest(z_clean) AS v
  FROM paired)"""


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.deltas import cyclic_pair

    e = embeddings(spark, sf_dir)
    return cyclic_pair(e.where("family <> 0"), e.where("family = 0"), "vec_id")


def pair_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("scope", F.col("vec_id").alias("pid"), F.col("family").cast("string").alias("family"), "z")


# All i<j pairs inside a scope with both distances.
PAIRS = EMB + """,
pr AS (
  SELECT a.scope AS scope, a.vec_id AS a_id, b.vec_id AS b_id, a.family AS a_family, b.family AS b_family,
         a.family = b.family AS same,
         list_distance(a.z, b.z) AS d_l2, list_cosine_distance(a.z, b.z) AS d_cos
  FROM emb a JOIN emb b ON a.scope = b.scope AND a.vec_id < b.vec_id),
sym AS (
  SELECT scope, a_id AS pid, a_family AS family, b_id AS oid, b_family AS ofam, d_l2, d_cos FROM pr
  UNION ALL SELECT scope, b_id, b_family, a_id, a_family, d_l2, d_cos FROM pr)"""


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as one-dimensional signals with a shifted span per user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    order = [F.col("ts"), F.col("event_id")]
    t = rank_in_group(e, ["user_id"], order, "t")
    u = F.col("user_id") % 3
    length = F.when(u == 0, 12).when(u == 1, 20).otherwise(28)
    out = t.select(
        F.col("user_id").alias("stream_id"), F.col("t").cast("int").alias("t"), "ts", "value", length.alias("corruption_length")
    )
    out = out.withColumn("corrupt_start", F.lit(START)).withColumn("corrupt_end", F.lit(START) + F.col("corruption_length"))
    out = out.withColumn("is_corrupt", (F.col("t") >= F.col("corrupt_start")) & (F.col("t") < F.col("corrupt_end")))
    signal = F.log1p("value") + F.when(F.col("is_corrupt"), SHIFT).otherwise(0.0)
    return out.withColumn("s", signal).withColumn("z", F.array("s"))


STREAM = """ev AS (
  SELECT user_id AS stream_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS t, ts, value,
         CASE user_id % 3 WHEN 0 THEN 12 WHEN 1 THEN 20 ELSE 28 END AS corruption_length
  FROM events),
st AS (
  SELECT *, 20 AS corrupt_start, 20 + corruption_length AS corrupt_end, t >= 20 AND t < 20 + corruption_length AS is_corrupt,
         ln(1 + value) + CASE WHEN t >= 20 AND t < 20 + corruption_length THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS s
  FROM ev)"""

# Alarm threshold on the raw value for stateless traces, and the reliability it implies.
ALARM_VALUE = 30.0


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateless trace: alarm = value above a threshold, reliability falls with the signal."""
    s = streams(spark, sf_dir)
    return s.select(
        F.col("stream_id").alias("episode_id"), "t", (F.col("value") > ALARM_VALUE).alias("alarm"),
        F.when(F.col("value") > ALARM_VALUE, "persistent").otherwise("clean").alias("mode"),
        (1.0 / (1.0 + F.col("s"))).alias("reliability"), (1.0 / (1.0 + F.col("value"))).alias("r_a"), (1.0 / (2.0 + F.col("s"))).alias("r_b"),
        "is_corrupt", "corrupt_start", "corrupt_end", "corruption_length",
        (F.col("stream_id") % 5 + 1).alias("severity"),
    )


TRACE = STREAM + """,
tr AS (
  SELECT stream_id AS episode_id, t, value > 30.0 AS alarm, CASE WHEN value > 30.0 THEN 'persistent' ELSE 'clean' END AS mode,
         1.0::DOUBLE / (1.0 + s) AS reliability, 1.0::DOUBLE / (1.0 + value) AS r_a, 1.0::DOUBLE / (2.0 + s) AS r_b,
         is_corrupt, corrupt_start, corrupt_end, corruption_length, stream_id % 5 + 1 AS severity
  FROM st)"""


def points(spark: SparkSession, sf_dir: str, ordered: bool = True, total: str | None = None) -> DataFrame:
    """Line items as point clouds: one frame per supplier, point order by all columns; ``total`` adds the frame's size."""
    l = table(spark, sf_dir, "lineitem")
    if ordered:
        order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")]
        l = rank_in_group(l.select("l_suppkey", *order), ["l_suppkey"], order, "point_idx", total=total)
    cols = [F.col(c) for c in ("point_idx", total) if ordered and c]
    return l.select(
        F.col("l_suppkey").alias("frame_id"), *cols, (F.col("l_quantity") / 7.0).alias("x"), (F.col("l_extendedprice") / 977.0).alias("y"),
        (F.col("l_discount") * 10 / 3.0).alias("z"), F.col("l_tax").alias("w"),
    )


POINTS = """pt AS (
  SELECT l_suppkey AS frame_id,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS point_idx,
         l_quantity / 7.0::DOUBLE AS x, l_extendedprice / 977.0::DOUBLE AS y, l_discount * 10 / 3.0::DOUBLE AS z, l_tax AS w
  FROM lineitem)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an 8 x 8 grey frame in [0, 1]; four episodes by vec_id mod 4."""
    e = embeddings(spark, sf_dir)
    return e.select(
        F.col("scope").alias("episode_id"), F.floor(F.col("vec_id") / 4).cast("int").alias("timestep"), "vec_id", F.lit(8).alias("h"), F.lit(8).alias("w"),
        F.lit(1).alias("channels"), F.transform("z", lambda v: (v + 1) / 2).alias("pixels"),
    )


IMAGES = """img AS (
  SELECT vec_id % 4 AS episode_id, CAST(vec_id // 4 AS INTEGER) AS timestep, vec_id,
         list_transform(embedding::DOUBLE[], lambda v: (v + 1) / 2) AS pixels
  FROM embeddings),
px AS (SELECT episode_id, timestep, vec_id, unnest(range(0, 64)) AS i, unnest(pixels) AS p FROM img)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        F.col("l_orderkey").alias("item_id"),
        F.array(F.col("l_quantity") / 7.0, F.col("l_extendedprice") / 977.0, F.col("l_discount")).alias("vec"),
        (F.col("l_returnflag") != "R").alias("mask"),
    )


TOKENS = """tk AS (
  SELECT l_orderkey AS item_id, [l_quantity / 7.0::DOUBLE, l_extendedprice / 977.0::DOUBLE, l_discount] AS vec, l_returnflag <> 'R' AS mask
  FROM lineitem)"""


def image_archives(spark: SparkSession, sf_dir: str) -> str:
    """Folder of labelled image archives written from the embeddings: 8 x 8 images, about 500 to an archive.

    ``m<scope>/p<id // 500>/c<corruption>_severity_<severity>.npz``; written by tasks below the shared checkpoint folder.
    """
    import uuid

    import numpy as np
    import pandas as pd

    from ..session import ensure_checkpoint_dir
    from ..sources.archives import place

    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    key = ["scope", "part", "corruption", "severity"]

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        scope, part, corruption, severity = pdf.iloc[0][key]
        pdf = pdf.sort_values("vec_id")
        system, base = place(root)
        folder = f"{base}/m{scope}/p{part}"
        system.create_dir(folder, recursive=True)
        z = np.stack(pdf["z"].to_list())
        with system.open_output_stream(f"{folder}/c{corruption}_severity_{severity}.npz") as f:
            np.savez_compressed(f, images=(np.floor(np.abs(z) * 100) % 256).astype(np.uint8).reshape(len(z), 8, 8), labels=pdf["vec_id"].to_numpy())
        return pd.DataFrame({"n": [len(pdf)]})

    e = embeddings(spark, sf_dir).withColumn("part", F.floor(F.col("vec_id") / 500))
    e.select(*key, "vec_id", "z").groupBy(*key).applyInPandas(write, "n long").agg(F.sum("n")).collect()
    return root
