"""Rank statistics over all pairs are exact at every size, and little leaves the tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustframe.operators import pairs
from trustframe.plans import shuffles, tiles


def cloud(spark, n=90, seed=0, dims=3):
    """Integer vectors (exact distances, many ties, repeated points) in two scopes of unequal size."""
    r = np.random.default_rng(seed)
    rows = [(0 if i < 2 * n // 3 else 1, i, f"f{r.integers(3)}", r.integers(0, 4, dims).astype(float).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "scope int, pid long, family string, z array<double>"), rows


def brute(rows, metric):
    out = {}
    for s in (0, 1):
        mine = [r for r in rows if r[0] == s]
        x = np.array([r[3] for r in mine])
        d = pairs.distances(x, x, metric)
        i, j = np.triu_indices(len(mine), 1)
        same = np.array([mine[a][2] == mine[b][2] for a, b in zip(i, j)])
        v = d[i, j]
        pos, neg = v[same], v[~same]
        auroc = ((pos[:, None] < neg[None, :]).sum() + (pos[:, None] == neg[None, :]).sum() / 2) / (len(pos) * len(neg))
        gain = sum((pos == u).sum() * (pos <= u).sum() / (v <= u).sum() for u in np.unique(pos))
        out[s] = (auroc, gain / len(pos))
    return out


@pytest.mark.parametrize("ties", [True, False])
@pytest.mark.parametrize("limit", [10**9, 300, 20])
def test_ranks_are_exact_in_any_number_of_passes(spark, monkeypatch, limit, ties):
    monkeypatch.setattr(pairs, "PASS_PAIRS", limit)
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 16)
    df, rows = cloud(spark)
    want = brute(rows, "l2")
    ranks = pairs.rank_counts(df, ["scope"], "l2", ties=ties)
    got = {r["scope"]: r["auroc"] for r in pairs.pair_auroc(ranks, ["scope"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s][0]) < 1e-12 for s in want)
    if ties:
        got = {r["scope"]: r["average_precision"] for r in pairs.average_precision(ranks, ["scope"]).collect()}
        assert all(abs(got[s] - want[s][1]) < 1e-12 for s in want)


def test_rows_leaving_the_tiles_do_not_grow_with_the_pairs(spark, monkeypatch):
    def leaving(n):
        r = np.random.default_rng(1)
        df = spark.createDataFrame([(0, i, f"f{i % 2}", r.normal(size=4).tolist()) for i in range(n)], "scope int, pid long, family string, z array<double>")
        return pairs.tile_stats(df, ["scope"], "l2", {"hist"}, shift=pairs.FIRST_SHIFT).count()

    monkeypatch.setattr(tiles, "BLOCK_ROWS", 100_000)  # one tile, so one set of bins
    small, large = leaving(1000), leaving(4000)
    assert large < 1.5 * small < 20_000  # the pairs are 16 times as many


def test_a_pass_returns_at_most_its_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PASS_PAIRS", 200)
    df, _ = cloud(spark, 120)
    seen, stats = [], pairs.tile_stats

    def counting(*args, **kw):
        out = stats(*args, **kw)
        if kw.get("shift") == 0:
            seen.append(out.count())
        return out

    monkeypatch.setattr(pairs, "tile_stats", counting)
    pairs.pair_auroc(pairs.rank_counts(df, ["scope"], "l2"), ["scope"]).collect()
    assert len(seen) > 3 and max(seen) <= 2 * 200  # bins are dealt to passes by hash


def test_neighbours_leave_large_blocks_once(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 20)
    df, rows = cloud(spark, 400, dims=5)
    df = df.withColumn("scope", F.lit(0))
    stats = pairs.tile_stats(df, ["scope"], "l2", {"nn"}, k=3)
    blocks = int(np.ceil(np.sqrt(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    assert stats.count() <= 400 * 3 * blocks < 400 * 3 * 20
    got = {(r["pid"], r["rank"]): r["neighbour"] for r in pairs.nearest_neighbours(stats, df, ["scope"], 3).collect()}
    x = np.array([r[3] for r in rows])
    d = pairs.distances(x, x, "l2")
    np.fill_diagonal(d, np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(400), d.shape), d), axis=1)[:, :3]
    assert got == {(i, k + 1): want[i, k] for i in range(400) for k in range(3)}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_places_are_permutations(n):
    keys = shuffles.round_keys(7, 30)
    got = shuffles.places(np.arange(n), n, keys)
    assert (np.sort(got, axis=0) == np.arange(n)[:, None]).all()
    if n == 1000:  # every place is about equally likely
        first = np.concatenate([shuffles.places(np.array([3]), 10, shuffles.round_keys(s, 500))[0] for s in range(4)])
        assert (abs(np.bincount(first, minlength=10) - 200) < 70).all()
    part = shuffles.places(np.arange(n)[::2], n, keys)  # a row needs no other row
    assert (part == got[::2]).all()


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_scoped_pvalues_equal_those_of_each_scope(spark, metric):
    df, _ = cloud(spark)
    df = df.withColumn("z", F.transform("z", lambda v: v + 1))
    got = {r["scope"]: (r["valid"], r["count_ge"]) for r in pairs.permutation_pvalue(df, metric, 15, 3, scope=["scope"]).collect()}
    for s in (0, 1):
        one = pairs.permutation_pvalue(df.where(F.col("scope") == s), metric, 15, 3).first()
        assert got[s] == (one["valid"], one["count_ge"]) and one["valid"] == 15
    alone = df.withColumn("family", F.lit("same"))
    assert {r["pvalue"] for r in pairs.permutation_pvalue(alone, metric, 5, 3, scope=["scope"]).collect()} == {None}
