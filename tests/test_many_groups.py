"""Moments of as many groups as a few rows each make take no Python call per group."""

import numpy as np
from pyspark.sql import functions as F

from trustframe.operators import fit


def test_moments_of_many_small_and_one_hot_group(spark):
    r = np.random.default_rng(0)
    rows = [(None if i % 50 == 0 else f"k{i % 301}" if i % 3 else "hot", i % 2, (r.normal(size=3) + 100).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, h int, z array<double>").repartition(7)
    out = fit.moments(df, ["k", "h"])
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(x["k"], x["h"]): x for x in out.collect()}
    want = {}
    for k, h, z in rows:
        want.setdefault((k, h), []).append(z)
    assert got.keys() == want.keys()
    for key, z in want.items():
        z = np.array(z)
        c = z - z.mean(axis=0)
        assert got[key]["n"] == len(z) and np.allclose(got[key]["mu"], z.mean(axis=0)) and np.allclose(got[key]["m2"], (c.T @ c).ravel(), atol=1e-8)
    whole = fit.moments(df).first()
    z = np.array([x[2] for x in rows])
    assert whole["n"] == 4000 and np.allclose(whole["m2"], ((z - z.mean(axis=0)).T @ (z - z.mean(axis=0))).ravel())
    assert fit.moments(df.where(F.col("h") > 5), ["k"]).collect() == []
