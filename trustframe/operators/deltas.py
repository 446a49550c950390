"""Matching clean and corrupted rows, delta points, sampling and guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import delta
from ..plans.lookup import salted_join
from ..plans.ranks import exact_quantiles, rank_in_group
from .fit import mean_vector

# Corruption families of the two labelled-image layouts.
FAMILY_MAP_COMPACT = {
    "noise": ["gaussian_noise", "impulse_noise"],
    "blur": ["motion_blur", "zoom_blur"],
    "color": ["brightness", "contrast"],
    "digital": ["pixelate"],
}
FAMILY_MAP_WIDE = {
    "digital": ["pixelate", "jpeg_compression"],
    "noise": ["gaussian_noise", "speckle_noise", "impulse_noise", "shot_noise"],
    "blur": ["defocus_blur", "motion_blur", "zoom_blur", "gaussian_blur"],
    "color": ["brightness_up", "brightness_down", "contrast_up", "contrast_down", "saturate"],
    "task-specific": [
        "stain_deposit",
        "bubble",
        "black_corner",
        "characters",
        "gamma_corr_up",
        "gamma_corr_down",
    ],
}

CLEAN_FANOUT = 32


def taxonomy_frame(spark, families: dict[str, list[str]], representatives: dict[str, list[str]] | None = None) -> DataFrame:
    """Dimension table ``family, member, is_representative``."""
    reps = representatives or {}
    rows = [(f, m, m in reps.get(f, [])) for f, ms in families.items() for m in ms]
    return spark.createDataFrame(rows, "family string, member string, is_representative boolean")


def match_clean_corrupt(corrupt: DataFrame, clean: DataFrame, scope: str, sample: str, z: str = "z") -> DataFrame:
    """Corrupt rows with the clean vector of the same sample and ``delta`` = corrupt - clean.

    One clean row serves every corruption and severity of its sample, so the join
    key repeats on the corrupt side; salting keeps a popular sample spread out.
    """
    c = clean.select(scope, sample, F.col(z).alias("z_clean"))
    joined = salted_join(corrupt, c, [scope, sample], [F.col(z)], salts=4)
    return joined.withColumn("delta", delta("z_clean", z))


def cyclic_pair(corrupt: DataFrame, clean: DataFrame, order: str, z: str = "z", keys: Sequence[str] = ()) -> DataFrame:
    """Pair the k-th corrupt row with clean row k mod n_clean (per group); adds ``z_clean`` and ``delta``.

    A short clean list would make few hot join keys, so each clean row is copied
    to ``CLEAN_FANOUT`` sub-keys and corrupt rows rotate over them.
    """
    keys = list(keys)
    bad = rank_in_group(corrupt, keys, [F.col(order)], "k")
    good = rank_in_group(clean.select(*keys, order, z), keys, [F.col(order)], "slot", total="n_clean")
    good = good.select(*keys, "slot", "n_clean", F.col(z).alias("z_clean"))
    sizes = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_clean"))
    if keys:
        bad = salted_join(bad, sizes, keys, ["k"])
    else:
        bad = bad.withColumn("n_clean", sizes.scalar())
    bad = bad.withColumn("slot", F.pmod("k", "n_clean")).withColumn("_turn", F.pmod(F.floor(F.col("k") / F.col("n_clean")), F.lit(CLEAN_FANOUT)).cast("int"))
    good = good.drop("n_clean").withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(CLEAN_FANOUT - 1))))
    return bad.join(good, [*keys, "slot", "_turn"]).withColumn("delta", delta("z_clean", z)).drop("_turn", "n_clean", "slot", "k")


def match_check(corrupt: DataFrame, clean: DataFrame, scope: str, sample: str, label: str, groups: Sequence[str], strict: bool = False) -> DataFrame:
    """Per scope and group: compared rows, mismatched labels, and whether all match.

    Every clean sample must have its corrupt partner in each group that exists in any scope, and every
    corrupt row its clean one; a missing partner fails.  ``strict`` also fails on a label mismatch.
    """
    out = match_counts(corrupt, clean, scope, sample, label, groups)
    name = F.coalesce(F.col(scope).cast("string"), F.lit("NULL"))
    short = F.raise_error(F.concat(F.lit("too few corrupt rows in scope "), name)).cast("long")
    alone = F.raise_error(F.concat(F.lit("corrupt rows without a clean partner in scope "), name)).cast("long")
    count = F.when(F.col("missing_count") > 0, short).when(F.col("unmatched_count") > 0, alone).otherwise(F.col("selected_count"))
    bad = F.raise_error(F.concat(F.lit("label mismatch in scope "), name)).cast("long")
    miss = F.when(F.col("mismatch_count") > 0, bad).otherwise(F.col("mismatch_count")) if strict else F.col("mismatch_count")
    return out.select(scope, *groups, count.alias("selected_count"), "labels_match", miss.alias("mismatch_count"))


def match_counts(corrupt: DataFrame, clean: DataFrame, scope: str, sample: str, label: str, groups: Sequence[str]) -> DataFrame:
    """The match table without the completeness guard, with its missing partners counted.

    ``unmatched_count`` counts corrupt rows without a clean row, ``missing_count`` clean samples without a
    corrupt row.  Every clean scope has a row for each group that exists in any scope.
    """
    c = clean.select(scope, sample, F.col(label).alias("_clean_label"), F.lit(True).alias("_hit"))
    joined = salted_join(corrupt.select(scope, sample, *groups, label), c, [scope, sample], list(groups), "left", salts=4)
    wrong = F.col(label) != F.col("_clean_label")
    found = joined.groupBy(scope, *groups).agg(
        F.count("_hit").alias("selected_count"), F.sum(wrong.cast("long")).alias("mismatch_count"),
        F.count_if(F.col("_hit").isNull()).alias("unmatched_count"),
        (-F.count_distinct(F.when(F.col("_hit"), F.struct(sample)))).alias("missing_count"),
    )
    # what each clean scope needs in every group, less what was found
    need = clean.groupBy(scope).agg(F.count_distinct(F.struct(sample)).alias("missing_count"))
    zero = F.lit(0).cast("long")
    need = need.crossJoin(corrupt.select(*groups).distinct()).select(
        scope, *groups, zero.alias("selected_count"), zero.alias("mismatch_count"), zero.alias("unmatched_count"), "missing_count"
    )
    out = found.unionByName(need).groupBy(scope, *groups).agg(*[F.sum(x).alias(x) for x in ("selected_count", "mismatch_count", "unmatched_count", "missing_count")])
    same = (F.col("mismatch_count") == 0) & (F.col("selected_count") > 0)
    return out.select(scope, *groups, "selected_count", same.alias("labels_match"), "mismatch_count", "unmatched_count", "missing_count")


def attach_family(df: DataFrame, taxonomy: DataFrame, corruption: str = "corruption", unknown: str = "error", max_members: int = 100_000) -> DataFrame:
    """Look up ``family``; unmapped corruptions fail, are skipped, or become their own family.

    The taxonomy is counted before it is broadcast; one corruption in two families fails.
    """
    if unknown not in ("error", "skip", "as_own_family"):
        raise ValueError(f"unknown mode {unknown}")
    dup = taxonomy.groupBy("member").agg(F.count_distinct("family").alias("c")).where("c > 1").limit(1).collect()
    if dup:
        raise ValueError(f"corruption {dup[0]['member']} belongs to more than one family")
    dim = taxonomy.select(F.col("member").alias(corruption), "family").distinct()
    if dim.limit(max_members + 1).count() <= max_members:
        out = df.join(F.broadcast(dim), corruption, "inner" if unknown == "skip" else "left")
    else:
        out = salted_join(df, dim, [corruption], [c for c in df.columns if c != corruption][:1], "inner" if unknown == "skip" else "left")
    if unknown == "as_own_family":
        return out.withColumn("family", F.coalesce("family", F.col(corruption).cast("string")))
    if unknown == "error":
        stop = F.raise_error(F.concat(F.lit("no family mapping for corruption "), F.col(corruption).cast("string")))
        return out.withColumn("family", F.coalesce("family", stop))
    return out


def sample_n(df: DataFrame, keys: Sequence[str], row_id: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows per group without replacement, chosen by md5(seed|id); n <= 0 keeps all."""
    if n <= 0:
        return df
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col(row_id).cast("string")))
    if n <= 1000:
        # The rank filter is applied inside map tasks, so a hot group never shuffles whole.
        w = W.partitionBy(*keys).orderBy("_h", row_id)
        return df.withColumn("_h", h).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_h", "_r")
    d = df.withColumn("_h", h)
    ranked = rank_in_group(d, keys, [F.col("_h"), F.col(row_id)], "_k")
    return ranked.where(F.col("_k") < n).drop("_h", "_k")


def severity_split(df: DataFrame, discovery: Sequence[int], validation: Sequence[int] = (), severity: str = "severity", min_points: int = 3) -> DataFrame:
    """Validation rows: the named severities, or all but the discovery ones; fewer than ``min_points`` fail."""
    if not discovery:
        raise ValueError("discovery severities must not be empty")
    pick = F.col(severity).isin(list(validation)) if validation else ~F.col(severity).isin(list(discovery))
    out = df.where(pick)
    if out.limit(min_points).count() < min_points:
        raise ValueError(f"fewer than {min_points} evaluation points after the severity split")
    return out


def aggregate_delta(df: DataFrame, keys: Sequence[str], mode: str, z: str = "delta", trim: float = 0.1) -> DataFrame:
    """One vector per group by ``mean``, ``median`` or ``trimmed_mean``, as rows ``keys, dim, value``.

    Median and trimmed mean rank every (group, dimension) through ordered buckets, so
    neither a hot group nor a wide vector lands in one task.
    """
    keys = list(keys)
    if mode == "mean":
        return mean_vector(df, keys, z).select(*keys, F.posexplode("mu").alias("dim", "value"))
    long = df.select(*keys, F.posexplode(z).alias("dim", "v"))
    if mode == "median":
        return exact_quantiles(long, "v", [0.5], [*keys, "dim"]).select(*keys, "dim", "value")
    if mode != "trimmed_mean":
        raise ValueError(f"unsupported aggregation {mode}")
    ranked = rank_in_group(long, [*keys, "dim"], [F.col("v")], "r", total="n")
    cut = F.floor(F.col("n") * F.lit(float(trim)))
    inner = ranked.where((F.col("r") >= cut) & (F.col("r") < F.col("n") - cut))
    return inner.groupBy(*keys, "dim").agg(F.avg("v").alias("value"))


def min_support(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Rows of groups with at least ``k`` members; none left fails."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= k).drop("_c")
    if not big.limit(1).count():
        raise ValueError(f"no group has {k} rows")
    return salted_join(df, big, keys, [c for c in df.columns if c not in keys][:1])


def assert_min_count(df: DataFrame, keys: Sequence[str], k: int, what: str) -> DataFrame:
    """Group counts; a group with fewer than ``k`` rows fails."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("n", F.when(F.col("n") < k, F.raise_error(F.lit(f"{what}: fewer than {k} rows")).cast("long")).otherwise(F.col("n")))


def assert_vectors(df: DataFrame, z: str, dim: int) -> DataFrame:
    """Fail on a NULL vector or one of the wrong width."""
    bad = F.col(z).isNull() | (F.size(z) != dim)
    return df.withColumn(z, F.when(bad, F.raise_error(F.lit(f"column {z} must hold vectors of width {dim}")).cast(df.schema[z].dataType)).otherwise(F.col(z)))


def requested_available(available: DataFrame, requested: Sequence[str], scope: str, name: str = "corruption") -> DataFrame:
    """Requested names present in each scope, in request order (``position``)."""
    want = F.array(*[F.lit(r) for r in requested])
    pos = F.array_position(want, F.col(name).cast("string"))
    return available.select(scope, name).distinct().withColumn("position", pos.cast("int")).where("position > 0")


def build_summary(groups: DataFrame, scope: str, done: Column) -> DataFrame:
    """Processed and skipped group counts, and the number of scopes with any processed group."""
    return groups.agg(
        F.count_if(done).alias("groups_processed"),
        F.count_if(~done).alias("groups_skipped"),
        F.count_distinct(F.when(done, F.col(scope))).alias("scopes_processed"),
    )
