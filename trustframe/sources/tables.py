"""Model tables, metric and report sinks, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_model(model: DataFrame, path: str) -> None:
    """Persist clean stats, a family model or a registry as a Parquet table."""
    model.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_registry(registry: DataFrame, path: str, metric: str = "cosine", threshold: float = 0.2, metadata: dict[str, str] | None = None) -> None:
    """Few-shot registry with its metric, threshold and metadata on every row."""
    meta = F.create_map(*[F.lit(x) for kv in (metadata or {}).items() for x in kv]) if metadata else F.create_map().cast("map<string,string>")
    registry.withColumn("distance_metric", F.lit(metric)).withColumn("unseen_threshold", F.lit(float(threshold))).withColumn(
        "metadata", meta
    ).write.mode("overwrite").parquet(path)


def write_metrics_csv(df: DataFrame, path: str) -> bool:
    """CSV with header; an empty table writes nothing (returns False)."""
    if not df.limit(1).count():
        return False
    df.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_report_json(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines, NULL fields kept."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def run_report(trace: DataFrame, config: dict[str, str], stream: str = "stream_id", t: str = "t", head: int = 10) -> DataFrame:
    """One report row per stream: config, metrics, mode histogram and the first ``head`` trace rows."""
    hist = trace.groupBy(stream, "mode").agg(F.count(F.lit(1)).alias("n"))
    modes = hist.groupBy(stream).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", "n")))).alias("mode_histogram"))
    means = trace.groupBy(stream).agg(
        F.count(F.lit(1)).alias("episode_len"), F.avg("final").alias("mean_final_reliability"), F.avg(F.col("alarm").cast("double")).alias("alarm_rate")
    )
    first = trace.where(F.col(t) < head).groupBy(stream).agg(
        F.array_sort(F.collect_list(F.struct(t, "mode", "final", "suspicious", "alarm"))).alias("trace_head")
    )
    out = means.join(modes, stream).join(first, stream, "left")
    conf = F.create_map(*[F.lit(str(x)) for kv in config.items() for x in kv]) if config else F.create_map().cast("map<string,string>")
    return out.select(
        stream, "episode_len", conf.alias("config"), F.struct("mean_final_reliability", "alarm_rate", "mode_histogram").alias("metrics"), "trace_head"
    )


def write_embeddings(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """Small documents as JSON rows."""
    df.coalesce(1).write.mode("overwrite").json(path)


def episode_manifest(frames: DataFrame, clean_prefix: int, feature_dim: int, max_points: int, head: int = 5) -> DataFrame:
    """Per stream: frame count, settings and the first ``head`` frame names in order."""
    from pyspark.sql import Window as W

    names = frames.select("stream", "sort_key", "name").distinct()
    w = W.partitionBy("stream").orderBy("sort_key", "name")
    heads = names.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= head)
    first = heads.groupBy("stream").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda s: s["name"]).alias("frame_names_head"))
    counts = names.groupBy("stream").agg(F.count(F.lit(1)).alias("frame_count"))
    return counts.join(first, "stream").select(
        F.col("stream").alias("stream_name"), "frame_count", F.lit(clean_prefix).alias("clean_prefix"),
        F.lit(feature_dim).alias("point_feature_dim"), F.lit(max_points).alias("max_points"), "frame_names_head",
    )


def read_taxonomy_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``family, member, is_representative`` from a JSON document.

    Accepts ``{"families": {name: {"members": [...], "default_representatives": [...]}}}`` and
    the short form ``{name: [members]}``.
    """
    text = spark.read.text(path, wholetext=True).select("value")
    long_form = "struct<families:map<string,struct<members:array<string>,default_representatives:array<string>>>>"
    long = text.select(F.explode(F.from_json("value", long_form)["families"]).alias("family", "f")).select(
        "family", F.explode("f.members").alias("member"), F.col("f.default_representatives").alias("reps")
    )
    long = long.select("family", "member", F.coalesce(F.array_contains("reps", F.col("member")), F.lit(False)).alias("is_representative"))
    short = text.where(F.get_json_object("value", "$.families").isNull()).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("family", "m"))
    short = short.select("family", F.explode("m").alias("member"), F.lit(False).alias("is_representative"))
    return long.unionByName(short)
