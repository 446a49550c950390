"""The permutation test walks all pairs once, from rows that are dealt out, and adds up what each pair alone would."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustframe.operators import pairs
from trustframe.plans import tiles

from test_pairs_exact import cloud


@pytest.mark.parametrize("metric, step", [("l2", "FlatMapGroupsInArrow"), ("cosine", "MapInArrow")])
def test_pairs_are_walked_once(spark, metric, step):
    df, _ = cloud(spark, 60)
    out = pairs.permutation_pvalue(df, metric, 5, 3, scope=["scope"])
    assert step not in out._jdf.queryExecution().optimizedPlan().toString()  # the observed and the shuffled sums share what was stored


def test_numbered_rows_are_dealt_out(spark, monkeypatch):
    df, _ = cloud(spark, 200)
    seen, stats = [], pairs.tile_stats
    monkeypatch.setattr(pairs, "tile_stats", lambda pts, *a, **k: seen.append(pts.rdd.getNumPartitions()) or stats(pts, *a, **k))
    assert pairs.permutation_pvalue(df, "l2", 5, 3).first()["valid"] == 5
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))]


@pytest.mark.parametrize("cells", [4_000_000, 500])
@pytest.mark.parametrize("step", [8, 1024])
def test_label_sums_of_a_tile(monkeypatch, cells, step):
    monkeypatch.setattr(pairs, "LABEL_CELLS", cells)
    rng = np.random.default_rng(4)
    sides = [{"x": rng.normal(size=(n, 5)), "labels": rng.integers(0, 6, (n, 9))} for n in (90, 61)]
    sides[0]["x"][7] = sides[0]["x"][60] = sides[1]["x"][3]  # copies: distance 0
    sides[0]["x"][8] = sides[0]["x"][61] + 1e-9
    sides[0]["x"][9] = 0
    for a, b in ((sides[0], sides[1]), (sides[0], sides[0])):
        d = np.sqrt(((a["x"][:, None] - b["x"][None]) ** 2).sum(axis=2))
        d = np.triu(d) if a is b else d
        want = [(d * (la[:, None] == lb[None])).sum() for la, lb in zip(a["labels"].T, b["labels"].T)]
        np.testing.assert_allclose(pairs.equal_label_sums(a, b, 6, step), want, rtol=1e-12)


def test_copies_of_a_row_do_not_follow_the_partitions(spark):
    df = spark.range(400).select(F.col("id").alias("pid"), F.lit(0).alias("scope"))
    cores = spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 20_000)
        blocks = tiles.with_blocks(df.coalesce(1), ["scope"], "pid", 1, F.max(F.lit(8))).select("_nblk").first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert blocks == int(np.ceil(np.sqrt(4 * max(96, 8 * cores))))
