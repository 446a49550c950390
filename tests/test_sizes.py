"""Plans for large tables give the rows of the plans for small ones: NULL, NaN, ties, hot and NULL keys, repeated ids."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustframe.operators import cluster, family
from trustframe.plans import lookup, ranks, tiles


@pytest.fixture
def awkward(spark):
    """Hot key with most rows, a NULL key, NULL and NaN values, one value in most rows."""
    i = F.col("id")
    key = F.when(i % 7 == 0, F.lit(None).cast("string")).when(i % 5 == 0, "b").otherwise("a")
    v = F.when(i % 11 == 0, F.lit(None).cast("double")).when(i % 13 == 0, float("nan")).when(i % 2 == 0, 0.0).otherwise((i % 97).cast("double"))
    return spark.range(4000).repartition(5).select(key.alias("k"), v.alias("v"), "id")


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("order", ["asc", "desc", "asc_nulls_last", "desc_nulls_first"])
def test_rank_is_the_same_at_every_size(awkward, monkeypatch, keys, order):
    along = [getattr(F.col("v"), order)(), F.col("id")]
    small = rows_of(ranks.rank_in_group(awkward, keys, along, "rn", total="n").select("k", "v", "id", "rn", "n"))
    monkeypatch.setattr(ranks, "SINGLE_TASK_ROWS", 0)
    large = rows_of(ranks.rank_in_group(awkward, keys, along, "rn", total="n").select("k", "v", "id", "rn", "n"))
    assert len(large) == 4000 and small == large


def test_rank_of_an_empty_table(awkward, monkeypatch):
    monkeypatch.setattr(ranks, "SINGLE_TASK_ROWS", 0)
    assert ranks.rank_in_group(awkward.where("id < 0"), ["k"], [F.col("v")]).collect() == []


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_are_the_same_at_every_size(awkward, monkeypatch, keys):
    def got():
        q = ranks.exact_quantiles(awkward, "v", [0.0, 0.25, 0.5, 0.9, 1.0], keys).collect()
        return {(*[r[k] for k in keys], r["p"]): r["value"] for r in q}

    small = got()
    monkeypatch.setattr(ranks, "SINGLE_TASK_ROWS", 0)
    large = got()
    assert small.keys() == large.keys() and len(small) == (15 if keys else 5)
    assert all(math.isclose(small[k], large[k]) or math.isnan(small[k]) and math.isnan(large[k]) for k in small)


def test_auroc_is_the_same_at_every_size(awkward, monkeypatch):
    d = awkward.where("v is not null").withColumn("y", F.col("id") % 3 == 0)

    def got():
        return {r["k"]: r["auroc"] for r in ranks.auroc(d, ["k"], "v", "y").collect()}

    small = got()
    monkeypatch.setattr(ranks, "SINGLE_TASK_ROWS", 0)
    large = got()
    assert small.keys() == large.keys() == {None, "a", "b"}
    assert all(math.isclose(small[k], large[k]) for k in small)


def test_group_facts_reach_null_keys(awkward):
    got = lookup.with_group_stats(awkward, ["k"], {"n": F.count(F.lit(1))}, ["id"])
    assert got.count() == 4000
    assert got.where("k is null").select("n").distinct().collect()[0]["n"] == got.where("k is null").count()


def test_nearest_keeps_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 2)
    x = [(None, [0.0, 1.0]), (1, [5.0, 5.0]), (1, [0.1, 0.0]), (None, [5.0, 4.0]), (2, [9.0, 9.0])]
    df = spark.createDataFrame(x, "vec_id long, z array<double>")
    table = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [5.0, 5.0]), ("c", [9.0, 8.0])], "family string, prototype array<double>")
    both = [rows_of(family.nearest_of_table(df, table, "family", ["prototype"], family.l2_to, inline_values=n)) for n in (1000, 0)]
    assert both[0] == both[1] and len(both[0]) == 5


@pytest.mark.parametrize("k", [1, 3, 12])
def test_clusters_are_the_same_at_every_size(spark, k):
    a = [(i % 3) * 2.0 + 0.01 * i for i in range(12)]
    df = spark.createDataFrame([(None if i == 5 else 100 - i, [math.cos(t), math.sin(t)]) for i, t in enumerate(a)], "pid long, z array<double>")
    small, large = (rows_of(cluster.agglomerative_cosine(df, k, single_task=n)) for n in (1000, 0))
    assert small == large
    if k == 12:  # labels follow the order of ids
        assert [r["cluster"] for r in cluster.agglomerative_cosine(df, k, single_task=0).orderBy("pid").collect()] == list(range(12))


@pytest.mark.parametrize("single", [1000, 0])
def test_one_merge_tree_is_cut_at_every_k(spark, monkeypatch, single):
    r = np.random.default_rng(3)
    x = r.normal(size=(23, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pid long, z array<double>")
    tree = cluster.merge_tree(df, single_task=single)
    got = {}
    for row in tree.cut([1, 2, 5, 22, 23]).collect():
        got.setdefault(row["k"], {})[row["pid"]] = row["cluster"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[i] for i in range(23)]
    while groups:
        if len(groups) in got:
            groups.sort(key=min)
            assert got[len(groups)] == {i: c for c, g in enumerate(groups) for i in g}, len(groups)
        if len(groups) == 1:
            break
        far = lambda a, b: np.mean([1 - u[i] @ u[j] for i in a for j in b])
        a, b = min(((a, b) for k, a in enumerate(groups) for b in groups[:k]), key=lambda p: far(*p))
        groups = [g for g in groups if g is not a and g is not b] + [a + b]
    built = []
    monkeypatch.setattr(cluster, "merge_tree", lambda *args, **kw: built.append(1) or tree)
    k, labels, scores = cluster.select_k(df, "agglomerative_cosine", 2, 6)
    assert len(built) == 1 and [s[0] for s in scores] == [2, 3, 4, 5, 6] and labels.count() == 23


def test_only_touched_clusters_look_again(spark, monkeypatch):
    a = [(i, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate([0.0, 0.1, 0.3, 0.7, 1.5])]
    df = spark.createDataFrame(a, "pid long, z array<double>")
    looked, search = [], cluster._neighbours_of
    monkeypatch.setattr(cluster, "_neighbours_of", lambda some, state: looked.append((some.count(), state.count())) or search(some, state))
    cluster.merge_tree(df, single_task=0)
    assert looked and all(n <= m for n, m in looked) and any(n < m for n, m in looked)
