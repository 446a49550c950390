"""Neighbours in a frame: blocks, ties, features, few points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustframe.operators import points as P


@pytest.mark.parametrize("blocks", [(16_384, 256), (7, 3)])
def test_knn_group_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(P, "KNN_POINTS", blocks[0])
    monkeypatch.setattr(P, "KNN_CENTRES", blocks[1])
    r = np.random.default_rng(3)
    rows = [(f, i, *r.integers(0, 4, 3).astype(float).tolist(), [float(i), 1.0], None if i % 4 else f"n{i}") for f, n in (("a", 60), ("b", 3), ("c", 20)) for i in range(n)]
    rows.append(("c", 20, float("nan"), 0.0, 0.0, [9.0, 9.0], None))
    pts = spark.createDataFrame(rows, "frame_id string, point_idx long, x double, y double, z double, feats array<double>, note string").repartition(4)
    cen = [(f, k, *r.integers(0, 4, 3).astype(float).tolist()) for f in "abcd" for k in range(8)]
    got = P.knn_group(pts, spark.createDataFrame(cen, "frame_id string, centre_id int, cx double, cy double, cz double"), 5)
    assert got.columns == ["frame_id", "centre_id", "rank", "point_idx", "rx", "ry", "rz", "distance", "feats", "note"]
    want = []
    for f, k, *c in cen:
        mine = [x for x in rows if x[0] == f]
        d = lambda x: np.sqrt(sum((a - b) ** 2 for a, b in zip(x[2:5], c)))
        near = sorted(mine, key=lambda x: (np.isnan(d(x)), 0 if np.isnan(d(x)) else d(x), x[1]))[:5]
        want += [(f, k, n + 1, x[1], x[5], x[6]) for n, x in enumerate(near)]
    assert sorted(((r.frame_id, r.centre_id, r["rank"], r.point_idx, r.feats, r.note) for r in got.collect()), key=str) == sorted(want, key=str)


def test_rows_before_the_rank_do_not_follow_the_points(spark, monkeypatch):
    pts = spark.range(20_000).select(F.lit(1).alias("frame_id"), F.col("id").alias("point_idx"), *[F.rand(k).alias(a) for k, a in enumerate("xyz")])
    cen = spark.createDataFrame([(1, k, 0.1 * k, 0.5, 0.5) for k in range(10)], "frame_id int, centre_id int, cx double, cy double, cz double")
    seen, tiles = [], P.scoped_cross_tiles
    monkeypatch.setattr(P, "scoped_cross_tiles", lambda *a: seen.append(tiles(*a)) or seen[0])
    P.knn_group(pts, cen, 4).collect()
    assert seen[0].count() == 10 * 4 * 2  # two blocks of points
