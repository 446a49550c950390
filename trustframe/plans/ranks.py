"""Row numbers, exact quantiles and AUROC that never put a whole group in one task.

A plain ``row_number`` over a hot key sorts that key's rows in one task.  Here
a group is first cut into ordered ranges or buckets; each is numbered or counted
on its own and the offsets are added back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .lookup import same_key_join

MAX_BUCKETS = 1024
# A whole table counted at or below this size is ordered by one plain window or aggregate.
SINGLE_TASK_ROWS = 1_000_000


def is_small(df: DataFrame) -> bool:
    """Count-checked: the table, hence each of its groups, fits one task."""
    return SINGLE_TASK_ROWS > 0 and df.limit(SINGLE_TASK_ROWS + 1).count() <= SINGLE_TASK_ROWS


def bucket_count(df: DataFrame) -> int:
    """A few buckets per shuffle partition, at most ``MAX_BUCKETS``."""
    return max(8, min(MAX_BUCKETS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def quantile_buckets(df: DataFrame, value: Column, name: str = "_b", n: int | None = None) -> DataFrame:
    """Add an order-preserving bucket number from approximate quantiles (n + 1 numbers on the driver)."""
    n = n or bucket_count(df)
    probe = df.select(value.cast("double").alias("_key"))
    cuts = probe.approxQuantile("_key", [i / n for i in range(1, n)], 0.5 / n)
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0))
    cut = Bucketizer(splits=splits, inputCol="_key", outputCol=name, handleInvalid="keep")
    return cut.transform(df.withColumn("_key", value.cast("double"))).drop("_key").withColumn(name, F.col(name).cast("int"))


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn", total: str | None = None) -> DataFrame:
    """Dense 0-based row number within ``keys`` in ``order``; ``total`` also adds the group size.

    Rows go to ranges of (keys, order), so a hot group and rows tied in the leading order value are split too.
    Each range numbers its rows; ranges of a group add the rows before them.  NULL and NaN keep the places
    that ``order`` gives them and NULL keys are one group, as in a plain window.
    """
    keys = list(keys)
    if is_small(df.select(*keys)):
        w = W.partitionBy(*keys)
        out = df.withColumn(name, (F.row_number().over(w.orderBy(*order)) - 1).cast("long"))
        return out.withColumn(total, F.count(F.lit(1)).over(w)) if total else out
    along = [*[F.col(k) for k in keys], *order]
    placed = df.repartitionByRange(*along).sortWithinPartitions(*along).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed).withColumn("_range", F.shiftright("_at", 33))  # the range's number stands in the upper bits
    runs = placed.groupBy(*keys, "_range").agg(F.min("_at").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    walk = W.partitionBy(*keys).orderBy("_range")
    before = F.sum("_n").over(walk) - F.col("_n")
    offsets = runs.select(*keys, "_range", (before - F.col("_lo")).alias("_off"), F.sum("_n").over(W.partitionBy(*keys)).alias("_tot"))
    if not keys:
        offsets = F.broadcast(offsets)  # at most one row per range
    out = same_key_join(placed, offsets, [*keys, "_range"]).withColumn(name, (F.col("_at") + F.col("_off")).cast("long"))
    if total:
        out = out.withColumn(total, F.col("_tot"))
    return out.drop("_at", "_range", "_off", "_tot")


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles per group: columns keys, ``p``, ``value``.

    Bucket counts locate the two order statistics of each quantile; only rows of
    those buckets are shuffled, collapsed to distinct values with counts.
    """
    keys = list(keys)
    if is_small(df.select(value)):
        row = df.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in probs])).alias("_q"))
        pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("p"), F.col("_q").alias("value"))
        return row.where(F.col("_q").isNotNull()).select(*keys, F.inline(pairs))
    d = materialize(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")))  # read four times
    d = quantile_buckets(d, F.col("_v"))
    hist = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    walk = W.partitionBy(*keys).orderBy("_b")
    hist = hist.select(
        *keys,
        "_b",
        "_n",
        (F.sum("_n").over(walk) - F.col("_n")).alias("_off"),
        F.sum("_n").over(W.partitionBy(*keys)).alias("_tot"),
    )
    wanted = (
        hist.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_pos", (F.col("_tot") - 1) * F.col("p"))
        .withColumn("_at", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
        .where((F.col("_at") >= F.col("_off")) & (F.col("_at") < F.col("_off") + F.col("_n")))
        .select(*keys, "_b", "p", "_pos", (F.col("_at") - F.col("_off")).alias("_k"), "_at")
    )
    picked = wanted.select(*keys, "_b").distinct()
    if not keys:
        picked = F.broadcast(picked)  # at most two buckets per requested quantile
        wanted = F.broadcast(wanted)
    values = same_key_join(d, picked, [*keys, "_b"], "left_semi").groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
    run = W.partitionBy(*keys, "_b").orderBy("_v")
    values = values.withColumn("_hi", F.sum("_n").over(run)).withColumn("_lo", F.col("_hi") - F.col("_n"))
    hits = same_key_join(values, wanted, [*keys, "_b"]).where((F.col("_k") >= F.col("_lo")) & (F.col("_k") < F.col("_hi")))
    low, high = F.min_by("_v", "_at"), F.max_by("_v", "_at")
    frac = F.first(F.col("_pos") - F.floor("_pos"))
    return hits.groupBy(*keys, "p").agg((low + (high - low) * frac).alias("value"))


def ordered_counts(df: DataFrame, keys: Sequence[str], order: str, counts: Sequence[str], segment: Column) -> DataFrame:
    """Running totals of ``counts`` along ``order`` as ``cum_<name>``, in two levels over ``segment``."""
    keys = list(keys)
    d = df.withColumn("_s", segment)
    seg = d.groupBy(*keys, "_s").agg(*[F.sum(c).alias(f"_t_{c}") for c in counts])
    walk = W.partitionBy(*keys).orderBy("_s")
    seg = seg.select(*keys, "_s", *[(F.sum(f"_t_{c}").over(walk) - F.col(f"_t_{c}")).alias(f"_o_{c}") for c in counts])
    run = W.partitionBy(*keys, "_s").orderBy(order)
    out = same_key_join(d, seg, [*keys, "_s"])
    for c in counts:
        out = out.withColumn(f"cum_{c}", F.sum(c).over(run) + F.col(f"_o_{c}"))
    return out.drop("_s", *[f"_o_{c}" for c in counts])


def auroc(df: DataFrame, keys: Sequence[str], score: str, positive: str, name: str = "auroc") -> DataFrame:
    """Mid-rank AUROC per group; NULL when a class is missing.

    Ties collapse to one row per distinct score before anything is ordered.
    """
    keys = list(keys)
    flag = F.col(positive).cast("long")
    by_score = df.groupBy(*keys, F.col(score).alias("_score")).agg(
        F.sum(flag).alias("pos"), F.sum(1 - flag).alias("neg")
    )
    if is_small(df.select(score)):
        bucketed = by_score.withColumn("_seg", F.lit(0))
    else:
        bucketed = quantile_buckets(by_score, F.col("_score"), "_seg")
    return auroc_from_counts(bucketed, keys, "_score", F.col("_seg"), name)


def auroc_from_counts(df: DataFrame, keys: Sequence[str], score: str, segment: Column, name: str = "auroc") -> DataFrame:
    """AUROC from (score, pos, neg) counts: a positive beats every lower negative and half of its ties."""
    cum = ordered_counts(df, keys, score, ["neg"], segment)
    wins = F.sum(F.col("pos").cast("double") * (F.col("cum_neg") - F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return cum.groupBy(*keys).agg(F.when(pairs > 0, wins / pairs).alias(name))
