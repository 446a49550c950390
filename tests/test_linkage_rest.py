"""Rounds of merges hand over to one task when few clusters are left, with the same tree."""

import numpy as np

from trustframe.operators import cluster


def plain(units):
    """The merge loop that looks at every pair each time."""
    n = len(units)
    s, c, ids, out = units.copy(), np.ones(n), list(range(n)), []
    live = list(range(n))
    for step in range(n - 1):
        h, i, j = min((1 - s[a] @ s[b] / (c[a] * c[b]), a, b) for x, a in enumerate(live) for b in live[x + 1 :])
        out.append((ids[i], ids[j], h))
        s[i], c[i], ids[i] = s[i] + s[j], c[i] + c[j], n + step
        live.remove(j)
    return out


def test_remembered_neighbours_give_the_plain_merges():
    for seed, whole in ((0, False), (1, False), (2, True)):
        r = np.random.default_rng(seed)
        x = np.eye(4)[r.integers(0, 4, 24)] if whole else r.normal(size=(40, 5))
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        got, want = cluster.linkage_cosine(x), plain(x)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_the_last_clusters_merge_in_one_task(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pid long, z array<double>")
    looked, search = [], cluster._neighbours_of
    monkeypatch.setattr(cluster, "_neighbours_of", lambda some, state: looked.append(1) or search(some, state))
    trees = [cluster.merge_tree(df, single_task=n).cut([2, 7, 30]) for n in (1000, 30)]
    assert len(looked) <= 4
    assert len({str(sorted(map(tuple, t.collect()))) for t in trees}) == 1


def test_rounds_in_memory_give_the_plain_merges():
    for seed, known in ((0, False), (5, True)):
        x = np.random.default_rng(seed).normal(size=(300, 6))
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = h = None
        if known:  # neighbours of some are known before
            place, far = cluster.nearest_of(x, np.arange(300), np.arange(300), x)
            near, h = np.where(np.arange(300) % 3 == 0, place, -1), np.where(np.arange(300) % 3 == 0, far, np.inf)
        got = cluster.linkage_rounds(x, np.ones(300), near, h)
        edges = cluster._edges_of(np.arange(300), cluster.linkage_cosine(x))
        assert sorted(g[:2] for g in got) == sorted(zip(edges["pid"], edges["near"]))
        assert np.allclose(sorted(g[2] for g in got), sorted(edges["h"]))


def test_rounds_in_memory_with_ties_repeats_and_unknown_vectors():
    x = np.repeat(np.eye(4), 5, axis=0)
    assert len(cluster.linkage_rounds(x, np.ones(20))) == 19
    x[3] = np.nan
    got = cluster.linkage_rounds(x, np.ones(20))
    assert len(got) == 18 and all(3 not in g[:2] for g in got)


def test_many_items_take_no_rounds_of_jobs(spark, monkeypatch):
    """Beyond the dense limit one task still merges by rounds and one cuts; a distributed tree is the same."""
    x = np.random.default_rng(4).normal(size=(80, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pid long, z array<double>")
    monkeypatch.setattr(cluster, "SINGLE_TASK_ITEMS", 10)
    looked, search = [], cluster._neighbours_of
    monkeypatch.setattr(cluster, "_neighbours_of", lambda some, state: looked.append(1) or search(some, state))
    trees = []
    for most in (1000, 40):  # all rounds in one task; the first ones as jobs
        monkeypatch.setattr(cluster, "ROUND_ITEMS", most, raising=False)
        trees.append(cluster.merge_tree(df).cut([2, 7, 30]))
        assert bool(looked) == (most == 40)
    trees.append(cluster.merge_tree(df, single_task=1000).cut([2, 7, 30]))
    assert len({str(sorted(map(tuple, t.collect()))) for t in trees}) == 1
