"""Models too large to send, and long streams, give the rows of the small plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustframe.operators import family, pairs
from trustframe.plans import scans


def rounded(df):
    fix = lambda v: tuple(round(x, 9) for x in v) if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v
    return sorted(([fix(v) for v in r] for r in df.collect()), key=str)


@pytest.fixture
def points(spark):
    r = np.random.default_rng(4)
    rows = [(i % 2, None if i == 7 else i // 2, f"f{r.integers(9)}", r.normal(size=5).tolist()) for i in range(140)]
    rows += [(0, 500, "alone", [0.0] * 5), (1, 501, "twin", [1.0] * 5), (1, 501, "twin", [1.0] * 5)]
    return spark.createDataFrame(rows, "scope int, pid long, family string, z array<double>").repartition(3)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(pairs, "MODEL_BLOCK_VALUES", 10)
    monkeypatch.setattr(pairs, "POINT_BLOCK_ROWS", 16)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("scope", [[], ["scope"]])
def test_left_out_centroids_in_blocks(points, small_blocks, metric, scope):
    cols = ["scope", "pid", "family", "pred", "pred_distance"]
    both = [rounded(pairs.loo_centroid(points, scope, metric, max_values=n).select(cols)) for n in (10**6, 0)]
    assert both[0] == both[1] and len(both[0]) == 143


@pytest.mark.parametrize("scope", [[], ["scope"]])
def test_silhouette_in_blocks(points, small_blocks, scope):
    p = points.where("family <> 'alone'")
    both = [rounded(pairs.silhouette(p, scope, "cosine", max_values=n)) for n in (10**6, 0)]
    assert both[0] == both[1] and both[0][0][-1] is not None


def test_one_family_only_has_no_other_centroid(points, small_blocks):
    p = points.where("family = 'alone'")
    for n in (10**6, 0):
        assert [r["pred"] for r in pairs.loo_centroid(p, ["scope"], "l2", max_values=n).collect()] == [None]


def test_left_out_centroids_brute_force(points):
    rows = [r for r in points.collect() if r["scope"] == 0]
    got = {(r["pid"], r["family"], str(r["z"])): r["pred"] for r in pairs.loo_centroid(points, ["scope"], "l2").where("scope = 0").collect()}
    for r in rows:
        best = (np.inf, None)
        for f in sorted({x["family"] for x in rows}):
            others = [x["z"] for x in rows if x["family"] == f and x is not r]
            if others:
                d = np.linalg.norm(np.mean(others, axis=0) - np.array(r["z"]))
                best = (d, f) if d < best[0] else best
        assert got[(r["pid"], r["family"], str(r["z"]))] == best[1]


@pytest.mark.parametrize("values", [1, 15, 60])
def test_softmax_over_label_blocks(spark, monkeypatch, values):
    monkeypatch.setattr(family, "LABEL_BLOCK_VALUES", values)
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(None if i == 3 else i // 2, r.normal(size=4).tolist()) for i in range(60)], "vec_id long, z array<double>").repartition(3)
    vecs = [r.normal(size=4).tolist() for _ in range(20)]
    labels = spark.createDataFrame([(f"l{k:02d}", vecs[k // 2]) for k in range(40)], "label string, vec array<double>")  # ties in pairs
    both = [rounded(family.zero_shot(df, labels, max_values=n).select("vec_id", "z", "probs", "pred", "prob")) for n in (10**6, 0)]
    assert both[0] == both[1]
    assert all(abs(sum(row[2]) - 1) < 1e-6 and len(row[2]) == 40 and int(row[3][1:]) % 2 == 0 for row in both[1])


def brute_belief(x, frozen, alpha):
    b, out = x[0], []
    for v, f in zip(x, frozen):
        before = b
        b = b if f else alpha * b + (1 - alpha) * v
        out.append((before, b))
    return out


@pytest.mark.parametrize("size", [None, 16, 1])
@pytest.mark.parametrize("batch", [10_000, 7])
def test_belief_scan_walks_batches_and_segments(spark, size, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        r = np.random.default_rng(2)
        streams = {s: (r.normal(size=(n, 3)), r.random(n) < 0.3) for s, n in ((1, 1), (2, 40), (3, 16), (2**60 + 1, 5))}
        rows = [(s, t, x[t].tolist(), bool(f[t]), None if t % 3 else "e") for s, (x, f) in streams.items() for t in range(len(x))]
        df = spark.createDataFrame(rows, "sid long, t int, z array<double>, f boolean, extra string").repartition(4)
        got = scans.belief_scan(df, ["sid"], "t", "z", 0.7, frozen=F.col("f"), size=size)
        assert got.columns == [*df.columns, "belief", "belief_next"]
        got = {(r["sid"], r["t"]): (r["belief"], r["belief_next"]) for r in got.collect()}
        for s, (x, f) in streams.items():
            for t, (before, after) in enumerate(brute_belief(x, f, 0.7)):
                assert np.allclose(got[(s, t)][0], before) and np.allclose(got[(s, t)][1], after), (s, t)
        assert len(got) == len(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_linear_scan():
    r = np.random.default_rng(0)
    a, b = r.random(300), r.normal(size=(300, 2))
    a[[0, 50, 51]] = 0
    want, prev = np.empty_like(b), np.zeros(2)
    for i in range(300):
        prev = want[i] = a[i] * prev + b[i]
    assert np.allclose(scans.linear_scan(a, b), want)
