"""Whole-vector queries against NumPy on all 64 dimensions."""

import numpy as np
import pytest

from trustframe.registry import all_queries
from trustframe.registry import fixtures as fx


@pytest.fixture(scope="module")
def emb(spark, sf):
    rows = fx.embeddings(spark, sf).select("vec_id", "family", "z").collect()
    return np.array([r["z"] for r in rows]), np.array([r["family"] for r in rows]), np.array([r["vec_id"] for r in rows])


def test_family_fit_full(spark, sf, emb):
    x, y, _ = emb
    got = {(r["family"], r["i"]): r for r in all_queries()["family_fit_full"](spark, sf).collect()}
    assert x.shape[1] == 64 and len(got) == 64 * len(set(y))
    for f in set(y):
        c = np.cov(x[y == f].T) + 1e-4 * np.eye(64)
        assert np.allclose([got[f, i]["var"] for i in range(64)], np.diag(c), atol=1e-6)
        assert np.allclose([got[f, i]["prec"] for i in range(64)], np.diag(np.linalg.inv(c)), rtol=1e-6, atol=1e-6)


def test_mahalanobis_full(spark, sf, emb):
    x, y, ids = emb
    c = np.cov(x[y == 0].T)
    prec = np.linalg.inv(0.99 * c + 0.01 * np.diag(np.diag(c)) + 1e-5 * np.eye(64))
    d = x - x[y == 0].mean(axis=0)
    got = {r["vec_id"]: r["md"] for r in all_queries()["mahalanobis_full"](spark, sf).collect()}
    assert np.allclose([got[i] for i in ids], np.einsum("ij,jk,ik->i", d, prec, d), rtol=1e-6, atol=1e-6)
