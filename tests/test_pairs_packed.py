"""Ordering many pairs takes few passes over them, and packed distances come back whole."""

import numpy as np
import pytest

from trustframe.operators import pairs
from trustframe.plans import tiles

from test_pairs_exact import brute, cloud


@pytest.mark.parametrize("keys", [[5], [0, 0, 0], [1, 2, 2, 9], [7, 7]])
def test_packed_keys_come_back(keys):
    keys = np.array(keys, np.int64) << 50
    u, c = np.unique(keys, return_counts=True)
    data, m = pairs.pack(keys)
    got, counts = pairs.unpack(data, m)
    assert (got == u).all() and ((c == 1).all() if counts is None else (counts == c).all())
    both = pairs.merged([(got, counts), (np.array([3], np.int64), None)])
    assert both[0].tolist() == sorted({3, *u.tolist()}) and both[1].sum() == len(keys) + 1


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_a_pass_holds_many_ranges(spark, monkeypatch, metric):
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 32)
    monkeypatch.setattr(pairs, "RANGE_PAIRS", 50, raising=False)
    df, rows = cloud(spark, 150, dims=6)
    passes, stats = [], pairs.tile_stats
    monkeypatch.setattr(pairs, "tile_stats", lambda *a, **k: passes.append(k.get("shift")) or stats(*a, **k))
    ranks = pairs.rank_counts(df, ["scope"], metric)
    auroc = {r["scope"]: r["auroc"] for r in pairs.pair_auroc(ranks, ["scope"]).collect()}
    ap = {r["scope"]: r["average_precision"] for r in pairs.average_precision(ranks, ["scope"]).collect()}
    want = brute(rows, metric)
    assert all(abs(auroc[s] - want[s][0]) < 1e-12 and abs(ap[s] - want[s][1]) < 1e-12 for s in want)
    assert 2 <= len(passes) <= 8  # bins, their refinements, and one pass of packed distances at each level


def test_label_sums_by_product_equal_those_by_comparison(spark, monkeypatch):
    df, _ = cloud(spark, 60)
    got = []
    for limit in (32, 0):
        monkeypatch.setattr(pairs, "DENSE_LABELS", limit, raising=False)
        got.append(sorted(map(tuple, pairs.permutation_pvalue(df, "l2", 15, 3, scope=["scope"]).collect())))
    assert got[0] == got[1]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_steps_give_each_pair_once(metric):
    x = np.random.default_rng(2).normal(size=(70, 5))
    x[3] = x[40]
    for a, b in ((x, x), (x[:33], x[33:])):
        got, seen = np.full((len(a), len(b)), np.nan), np.zeros((len(a), len(b)), int)
        for r, c, d, used in pairs.pairwise_steps(a, b, metric, 8):
            used = np.ones(d.shape, bool) if used is None else used
            seen[r, c] += used
            got[r, c] = np.where(used, np.sqrt(d) if metric == "l2" else d, got[r, c])
        want = np.triu(np.ones(seen.shape, int), 1) if a is b else np.ones(seen.shape, int)
        assert (seen == want).all()
        assert np.allclose(got[want == 1], pairs.distances(a, b, metric)[want == 1], atol=1e-12)


def test_short_steps_take_four_bytes():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 30, 5000)) + (1 << 60)
    keys[10:13] = keys[10]
    u, c = np.unique(keys, return_counts=True)
    data, m = pairs.pack(keys, 1 << 60)
    got, counts = pairs.unpack(data, m, 1 << 60)
    assert len(data) == 4 * len(keys) and (got == u).all() and (counts == c).all()


@pytest.mark.parametrize("small", [False, True])
def test_more_points_have_larger_passes_and_finer_first_bins(spark, monkeypatch, small):
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 32)
    for name, value in (("PASS_PAIRS", 400), ("RANGE_PAIRS", 4), ("PASS_POINTS", 10), ("HELD_PAIRS", 100), ("SORT_KEYS", 3)):
        monkeypatch.setattr(pairs, name, value, raising=False)
    if small:
        monkeypatch.setattr(pairs, "WINDOW_BINS", 64)
    df, rows = cloud(spark, 150, dims=6)
    passes, stats = [], pairs.tile_stats
    monkeypatch.setattr(pairs, "tile_stats", lambda *a, **k: passes.append((k.get("shift"), k.get("ranges"))) or stats(*a, **k))
    ranks = pairs.rank_counts(df, ["scope"], "cosine")
    auroc = {r["scope"]: r["auroc"] for r in pairs.pair_auroc(ranks, ["scope"]).collect()}
    ap = {r["scope"]: r["average_precision"] for r in pairs.average_precision(ranks, ["scope"]).collect()}
    want = brute(rows, "cosine")
    assert all(abs(auroc[s] - want[s][0]) < 1e-12 and abs(ap[s] - want[s][1]) < 1e-12 for s in want)
    assert passes[0] == (41, None)
    assert len([p for p in passes if p[1]]) <= 8  # 6,150 pairs, 400 x 150 / 10 in a pass at each level
