"""Operators without a SQL twin against NumPy, and the large-data plans against the small ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustframe.operators import cluster as cl
from trustframe.operators import family as fam
from trustframe.operators import fit, pairs, points
from trustframe.plans import ranks, scans, tiles
from trustframe.registry import fixtures as fx


@pytest.fixture(scope="module")
def emb(spark, sf):
    rows = fx.embeddings(spark, sf).select("vec_id", "family", F.slice("z", 1, 12).alias("z")).collect()
    x = np.array([r["z"] for r in rows])
    return spark.createDataFrame(rows, "vec_id long, family int, z array<double>").repartition(4), x, np.array([r["family"] for r in rows]), np.array([r["vec_id"] for r in rows])


def test_clean_reference_and_full_distance(emb):
    df, x, y, ids = emb
    stats = fit.fit_clean_reference(df.where("family = 0"), shrinkage=0.1, eps=1e-3)
    row = stats.first()
    c = np.cov(x[y == 0].T)
    cov = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-3 * np.eye(12)
    assert np.allclose(np.array(row["cov"]), cov) and np.allclose(np.array(row["precision"]), np.linalg.inv(cov))
    got = {r["vec_id"]: r["md"] for r in df.select("vec_id", fam.mahalanobis_full("z", stats).alias("md")).collect()}
    d = x - x[y == 0].mean(axis=0)
    want = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
    assert np.allclose([got[i] for i in ids], want)


def test_full_family_model(emb):
    df, x, y, ids = emb
    model = fit.fit_family_model(df, diag=False)
    scored = {r["vec_id"]: (r["pred"], r["min_d"]) for r in fam.nearest_family(df, model, diag=False).collect()}
    tiled = {r["vec_id"]: (r["pred"], r["min_d"]) for r in fam.nearest_family(df, model, diag=False, inline_values=0).collect()}
    best = []
    for f in range(10):
        c = np.cov(x[y == f].T) + 1e-4 * np.eye(12)
        d = x - x[y == f].mean(axis=0)
        best.append(np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    best = np.array(best)
    assert [scored[i][0] for i in ids] == best.argmin(axis=0).tolist()
    assert np.allclose([scored[i][1] for i in ids], best.min(axis=0))
    assert all(scored[i][0] == tiled[i][0] and math.isclose(scored[i][1], tiled[i][1]) for i in ids)


def test_single_row_family_has_unit_variance(spark):
    df = spark.createDataFrame([(1, 7, [1.0, 2.0])], "vec_id long, family int, z array<double>")
    assert np.allclose(fit.fit_family_model(df, eps=0.5).first()["var"], [1.5, 1.5])


def test_enroll_refuses_known_family(emb):
    model = fit.fit_family_model(emb[0])
    with pytest.raises(ValueError):
        fit.enroll_family(model, 3, emb[0].where("family = 3"), allow_update=False)


def test_gelu_head(emb):
    df, x, _, ids = emb
    w1, w2 = np.sin(np.arange(60).reshape(5, 12)), np.cos(np.arange(10).reshape(2, 5))
    got = {r[0]: r[1] for r in df.select("vec_id", fam.project("z", w1, np.zeros(5), w2, np.ones(2))).collect()}
    h = x @ w1.T
    h = 0.5 * h * (1 + np.vectorize(math.erf)(h / math.sqrt(2)))
    assert np.allclose([got[i] for i in ids], h @ w2.T + 1)


def brute_linkage(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = min(((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("single_task", [4096, 0])
def test_average_linkage(spark, single_task):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (7, 4)) for c in ([3, 0, 0, 0], [0, 3, 0, 0], [0, 0, 3, 3])])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pid long, z array<double>")
    got = {}
    for r in cl.agglomerative_cosine(df, 4, single_task=single_task).collect():
        got.setdefault(r["cluster"], []).append(r["pid"])
    assert {frozenset(g) for g in got.values()} == brute_linkage(x, 4)


def test_discovery_relabels_unseen_corruptions(spark):
    rng = np.random.default_rng(5)
    centre = {"a": [3, 0, 0], "b": [3, 0.1, 0], "c": [0, 3, 0], "d": [0, 3, 0.1], "e": [0, 0, 3]}
    rows = [(c, s, (np.array(m) + rng.normal(0, 0.05, 3)).tolist()) for c, m in centre.items() for s in (1, 2) for _ in range(4)]
    rows += [("new", 3, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "corruption string, severity int, z array<double>")
    mapping, k, _ = cl.discover_taxonomy(df, [1, 2], k_min=2, k_max=4)
    m = {r["corruption"]: r["family"] for r in mapping.collect()}
    assert m["a"] == m["b"] and m["c"] == m["d"] and len(set(m.values())) == k == 3
    assert {r["family"] for r in cl.relabel(df, mapping).where("corruption = 'new'").collect()} == {"new"}


def test_farthest_points_large_frame_plan(spark):
    rng = np.random.default_rng(1)
    rows = [(f, i, *map(float, rng.normal(size=3))) for f in (1, 2) for i in range(60 if f == 1 else 10)]
    df = spark.createDataFrame(rows, "frame_id long, point_idx long, x double, y double, z double")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(points.farthest_point_sample(df, 4)) == key(points.farthest_point_sample(df, 4, task_points=20))


def test_permutation_p_in_range_and_relabelling_invariance(spark, sf):
    pts = fx.pair_points(spark, sf).where("scope = 0")
    moved = pts.withColumn("family", F.concat(F.lit("q"), "family"))
    a, b = (pairs.separation(pairs.pair_moments(p, ["scope"], "l2"), ["scope"]).first()["separation_margin"] for p in (pts, moved))
    assert math.isclose(a, b)
    p = pairs.permutation_pvalue(pts, "cosine", 5, 1).first()["pvalue"]
    assert 0 < p <= 1


def test_undefined_metrics_are_null(spark):
    df = spark.createDataFrame([(0, i, "a", [float(i), 1.0]) for i in range(3)], "scope int, pid long, family string, z array<double>")
    assert pairs.silhouette(df, ["scope"], "cosine").first()["silhouette"] is None
    ranked = pairs.rank_counts(df, ["scope"], "l2")
    assert pairs.pair_auroc(ranked, ["scope"]).first()["auroc"] is None
    assert pairs.average_precision(ranked, ["scope"]).first()["average_precision"] is None
    assert pairs.separation(pairs.pair_moments(df, ["scope"], "l2"), ["scope"]).first()["cohens_d"] is None


@pytest.fixture
def large_plans(monkeypatch):
    monkeypatch.setattr(ranks, "SINGLE_TASK_ROWS", 0)
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 60)
    monkeypatch.setattr(scans, "SEGMENT", 16)
    monkeypatch.setattr(scans, "BELIEF_SEGMENT", 16)


@pytest.mark.parametrize("name", ["unseen_threshold", "delta_trimmed", "frame_auroc", "belief_ema", "rolling_bad_count", "consecutive_run", "knn_purity", "pair_auroc", "keypoints_radius", "pillar_points"])
def test_large_data_plans_match_duckdb(spark, sf, large_plans, name):
    from check_oracle import compare, connect
    from trustframe.registry import all_oracles, all_queries

    message, _, _ = compare(spark, connect(sf), sf, name, all_queries()[name], all_oracles()[name])
    assert message.startswith("ok"), message


def test_hot_key_quantiles_with_ties(spark, large_plans):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") % 97).cast("double")).alias("v"))
    got = {r["p"]: r["value"] for r in ranks.exact_quantiles(df, "v", [0.1, 0.5, 0.99]).collect()}
    x = np.array([5.0 if i % 3 == 0 else float(i % 97) for i in range(3000)])
    assert all(math.isclose(got[p], np.percentile(x, 100 * p)) for p in got) and len(got) == 3
