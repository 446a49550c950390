"""Attaching per-group facts to rows without a hot task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SALTS = 16
BROADCAST_ROWS = 50_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition for a compute-heavy Python stage.

    A fixed partition count keeps run-time coalescing, which looks at bytes only, from
    packing expensive groups into few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def same_key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL meets NULL, for facts computed by grouping the rows themselves."""
    facts = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(facts, same, how).drop(*[f"_right_{k}" for k in keys])


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], salt_by: Sequence[str | Column], how: str = "inner", salts: int = SALTS, null_keys: bool = False
) -> DataFrame:
    """Equi-join whose left side may have hot keys.

    Left rows spread over ``salts`` sub-keys, right rows (one fact row per key)
    are copied to each.  The copies are never broadcast: packed they look small, but
    the driver would hold ``salts`` rows per key.  With ``null_keys`` NULL meets NULL.
    """
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")
    facts = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    on, salted = [*keys, "_salt"], left.withColumn("_salt", salt)
    return (same_key_join(salted, facts, on, how) if null_keys else salted.join(facts, on, how)).drop("_salt")


def attach_facts(left: DataFrame, facts: DataFrame, keys: Sequence[str], salt_by: Sequence[str | Column], how: str = "inner") -> DataFrame:
    """Attach a table of narrow per-key facts: broadcast when counted small, salted join otherwise."""
    stored = materialize(facts)
    if stored.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(stored), list(keys), how)
    return salted_join(left, stored, keys, salt_by, how)


def with_group_stats(
    df: DataFrame, keys: Sequence[str], aggs: dict[str, Column], salt_by: Sequence[str | Column]
) -> DataFrame:
    """Attach group aggregates: partial aggregation first, then a salted join (no unordered window)."""
    stats = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])
    return salted_join(df, stats, keys, salt_by, null_keys=True)
