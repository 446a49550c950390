"""Episode and run summaries over long trace tables.

A trace has one row per step: ``episode_id, t, alarm (boolean), mode, reliability,
is_corrupt, corrupt_start, corrupt_end, corruption_length``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import BAND_WEIGHTS, band_distance_sq, label_phase, length_bucket
from ..functions.vectors import l2_norm, vec_mean, vec_std_pop
from ..plans.ranks import auroc

METRICS = ("prefix_false_alarm_rate", "corrupt_alarm_rate", "recovery_false_alarm_rate", "time_to_detect", "time_to_recover")


def episode_metrics(trace: DataFrame) -> DataFrame:
    """Per-episode alarm rates by phase, detection and recovery delay (empty phase: 0)."""
    phase = label_phase("t", "corrupt_start", "corrupt_end")
    a = F.col("alarm").cast("double")

    def rate(p):
        return F.coalesce(F.avg(F.when(phase == p, a)), F.lit(0.0))

    def size(p):
        return F.count(F.when(phase == p, 1))

    first_alarm = F.min(F.when((phase == "corrupt") & F.col("alarm"), F.col("t") - F.col("corrupt_start")))
    first_calm = F.min(F.when((phase == "recovery") & ~F.col("alarm"), F.col("t") - F.col("corrupt_end")))
    return trace.groupBy("episode_id").agg(
        F.max("corruption_length").alias("corruption_length"),
        rate("prefix").alias(METRICS[0]),
        rate("corrupt").alias(METRICS[1]),
        rate("recovery").alias(METRICS[2]),
        F.coalesce(first_alarm, size("corrupt")).cast("double").alias(METRICS[3]),
        F.coalesce(first_calm, size("recovery")).cast("double").alias(METRICS[4]),
    )


def summarize_split(trace: DataFrame) -> DataFrame:
    """Means over episodes, overall and per corruption-length bucket, with frame AUROC.

    Empty buckets report zero episodes and NULL metrics.
    """
    per = episode_metrics(trace).withColumn("bucket", length_bucket("corruption_length"))
    means = per.groupingSets([[], ["bucket"]], "bucket").agg(
        F.grouping("bucket").alias("_all"), F.count(F.lit(1)).alias("episode_count"), *[F.avg(m).alias(m) for m in METRICS]
    )
    means = means.withColumn("bucket", F.when(F.col("_all") == 1, "overall").otherwise(F.col("bucket"))).drop("_all")
    frames = trace.withColumn("bucket", F.explode(F.array(F.lit("overall"), length_bucket("corruption_length"))))
    curve = auroc(frames.withColumn("score", 1.0 - F.col("reliability")), ["bucket"], "score", "is_corrupt", "frame_auroc")
    spine = trace.sparkSession.createDataFrame([(b,) for b in ("overall", "shorter", "medium", "longer")], "bucket string")
    out = spine.join(means, "bucket", "left").join(curve, "bucket", "left")
    return out.withColumn("episode_count", F.coalesce("episode_count", F.lit(0)))


def mean_episode_metrics(trace: DataFrame) -> DataFrame:
    per = episode_metrics(trace)
    return per.agg(F.count(F.lit(1)).alias("episode_count"), *[F.avg(m).alias(m) for m in METRICS])


def frame_auroc(trace: DataFrame) -> DataFrame:
    """AUROC of 1 - reliability against is_corrupt over all frames (mid-ranks for ties)."""
    return auroc(trace.withColumn("score", 1.0 - F.col("reliability")), [], "score", "is_corrupt", "frame_auroc")


def batch_means(trace: DataFrame, batch: str, columns: list[str]) -> DataFrame:
    """Mean per batch, then the mean over batches."""
    per = trace.groupBy(batch).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
    return per.agg(*[F.avg(c).alias(c) for c in columns])


def run_summary(trace: DataFrame) -> DataFrame:
    return trace.agg(
        F.count(F.lit(1)).alias("steps"),
        F.avg("reliability").alias("mean_final_reliability"),
        F.avg(F.col("alarm").cast("double")).alias("alarm_rate"),
    )


def mode_histogram(trace: DataFrame) -> DataFrame:
    return trace.groupBy("mode").agg(F.count(F.lit(1)).alias("steps"))


def mode_map(trace: DataFrame) -> DataFrame:
    """One row with ``mode_histogram`` as a map (at most four entries)."""
    return mode_histogram(trace).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", "steps")))).alias("mode_histogram"))


def phase_summary(trace: DataFrame) -> DataFrame:
    """Per episode: mean reliability by phase, whether it recovered, reference-only steps, final mode."""
    phase = label_phase("t", "corrupt_start", "corrupt_end")
    corrupt = F.avg(F.when(phase == "corrupt", F.col("reliability")))
    recover = F.avg(F.when(phase == "recovery", F.col("reliability")))
    return trace.groupBy("episode_id").agg(
        F.avg(F.when(phase == "prefix", F.col("reliability"))).alias("prefix_mean"),
        corrupt.alias("corrupt_mean"),
        recover.alias("recover_mean"),
        (recover > corrupt).alias("recovered"),
        F.count_if(F.col("mode").isin("persistent", "recovering")).alias("b_only_steps"),
        F.max_by("mode", "t").alias("final_mode"),
    )


def assert_recovered(summary: DataFrame) -> DataFrame:
    """Fail on an episode whose recovery mean does not exceed its corrupt mean."""
    stop = F.raise_error(F.concat(F.lit("no recovery in episode "), F.col("episode_id").cast("string"))).cast("boolean")
    return summary.withColumn("recovered", F.when(F.coalesce("recovered", F.lit(False)), F.lit(True)).otherwise(stop))


def band_penalty(df: DataFrame, final: str = "final", a: str = "r_a", b: str = "r_b", low: str = "low", high: str = "high") -> DataFrame:
    """Weighted mean squared distance of the three scores from their target band."""
    parts = [F.avg(band_distance_sq(c, low, high)) for c in (final, a, b)]
    total = sum((w * p for w, p in zip(BAND_WEIGHTS, parts)), F.lit(0.0))
    return df.agg(parts[0].alias("final_penalty"), parts[1].alias("a_penalty"), parts[2].alias("b_penalty"), total.alias("penalty"))


def embedding_stats(df: DataFrame, z: str = "z") -> DataFrame:
    """Global mean / population deviation / extremes of entries and mean / deviation of norms.

    Per-row sums keep this a single scan with one combined aggregate.
    """
    per = df.select(
        F.size(z).alias("d"), F.aggregate(z, F.lit(0.0), lambda s, x: s + x).alias("s"),
        F.aggregate(z, F.lit(0.0), lambda s, x: s + x * x).alias("q"), F.array_min(z).alias("lo"), F.array_max(z).alias("hi"),
        l2_norm(z).alias("norm"),
    )
    n, mean = F.sum("d"), F.sum("s") / F.sum("d")
    return per.agg(
        F.count(F.lit(1)).alias("rows"), mean.alias("mean"),
        F.sqrt(F.greatest(F.sum("q") / n - mean * mean, F.lit(0.0))).alias("std"),
        F.min("lo").alias("min"), F.max("hi").alias("max"), F.avg("norm").alias("norm_mean"), F.stddev_pop("norm").alias("norm_std"),
    )


def embedding_trace(df: DataFrame, t: str, z: str = "z") -> DataFrame:
    """Per frame: norm, mean and population deviation of its vector."""
    return df.select(t, l2_norm(z).alias("norm"), vec_mean(z).alias("mean"), vec_std_pop(z).alias("std"))
