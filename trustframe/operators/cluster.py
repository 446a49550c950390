"""Clustering, taxonomy discovery and clustering agreement."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize
from ..plans.ranks import rank_in_group
from ..plans.tiles import cross_tiles, matrix, self_tiles
from ..session import materialize
from .fit import mean_vector
from .pairs import silhouette_values

# Largest set of items whose merge loop runs inside one task with all its pairs in memory.
SINGLE_TASK_ITEMS = 4096
# Largest set that one task merges by rounds, holding the clusters' vectors only, and largest merge tree that one task cuts.
ROUND_ITEMS = 49_152
CUT_ITEMS = 1_000_000
# Rows and columns of a step of a search for neighbours: small enough to stay in a core's cache.
STEP_ROWS, STEP_COLS = 256, 1024
# Clusters in a block of a distributed search: each further block copies every cluster once more.
BLOCK_ITEMS = 8192


def kmeans(df: DataFrame, k: int, z: str = "z", seed: int = 42, restarts: int = 10) -> DataFrame:
    """k-means keeping the cheapest of ``restarts`` runs; adds ``cluster``."""
    data = materialize(df.withColumn("_v", array_to_vector(z)))
    best = None
    for r in range(restarts):
        model = KMeans(k=k, seed=seed + r, featuresCol="_v", predictionCol="cluster", maxIter=50).fit(data)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best.transform(data).drop("_v")


def linkage_cosine(units: np.ndarray, sizes: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Average-linkage merges (a, b, height) of unit vectors, or of sums of ``sizes`` of them; merged pairs get ids n, n+1, ...

    The mean cosine distance of two clusters is 1 - S_a.S_b / (n_a n_b).  Each cluster remembers its nearest,
    the first on ties, so a merge looks only at the rows whose nearest it took away.
    """
    n = len(units)
    s, c = units.astype(float).copy(), np.ones(n) if sizes is None else sizes.astype(float).copy()
    ids = list(range(n))
    merges = []
    d = 1.0 - (s @ s.T) / np.outer(c, c)
    np.fill_diagonal(d, np.inf)
    alive = np.ones(n, bool)
    near = d.argmin(axis=1)
    low = d[np.arange(n), near]
    for step in range(n - 1):
        i = int(low.argmin())
        i, j = min(i, int(near[i])), max(i, int(near[i]))
        merges.append((ids[i], ids[j], float(d[i, j])))
        s[i], c[i], ids[i] = s[i] + s[j], c[i] + c[j], n + step
        alive[j] = False
        d[j, :] = d[:, j] = np.inf
        row = 1.0 - (s @ s[i]) / (c * c[i])
        row[~alive] = np.inf
        row[i] = np.inf
        d[i, :] = d[:, i] = row
        low[j] = np.inf
        stale = np.flatnonzero(alive & ((near == i) | (near == j)))
        near[stale] = d[stale].argmin(axis=1)
        low[stale] = d[stale, near[stale]]
        near[i], low[i] = row.argmin(), row.min()
        closer = np.flatnonzero(alive & ((row < low) | (row == low) & (i < near)))
        closer = closer[closer != i]
        near[closer], low[closer] = i, row[closer]
    return merges


def nearest_of(some: np.ndarray, own: np.ndarray, ids: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each mean vector of ``some`` with id ``own`` the place of the nearest of ``means`` with another id, and its distance.

    The distance of two clusters is 1 less the product of their means.  ``ids`` must ascend: on ties the first is taken.
    Without any other cluster, or none at a known distance, the distance is infinite.
    """
    place, best = np.zeros(len(some), np.int64), np.full(len(some), -np.inf)
    turned = np.ascontiguousarray(means.T)
    for lo in range(0, len(some), STEP_ROWS):
        r = slice(lo, lo + STEP_ROWS)
        a, mine = some[r], own[r]
        for at in range(0, len(ids), STEP_COLS):
            c = slice(at, at + STEP_COLS)
            near = a @ turned[:, c]
            here = ids[c]
            self_at = np.minimum(np.searchsorted(here, mine), len(here) - 1)
            hit = np.flatnonzero(here[self_at] == mine)
            near[hit, self_at[hit]] = -np.inf
            j = near.argmax(axis=1)
            v = near[np.arange(len(j)), j]
            if np.isnan(v).any():
                near[np.isnan(near)] = -np.inf
                j = near.argmax(axis=1)
                v = near[np.arange(len(j)), j]
            closer = v > best[r]
            place[r] = np.where(closer, j + at, place[r])
            best[r] = np.where(closer, v, best[r])
    return place, 1.0 - best


def linkage_rounds(sums: np.ndarray, sizes: np.ndarray, near: np.ndarray | None = None, h: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """The merges of ``linkage_cosine`` as (first member, first member, height), found by rounds and in no order.

    All reciprocal nearest neighbours merge in a round; then only clusters that merged or whose neighbour did look
    for a new one.  Memory holds the clusters' vectors and one step of products, never all pairs.
    ``near`` gives the neighbours that are known at distance ``h``, -1 where none is.
    """
    s, c = sums.astype(float).copy(), sizes.astype(float).copy()
    live = np.arange(len(s))
    near, h = (np.full(len(s), -1), np.full(len(s), np.inf)) if near is None else (near.copy(), h.copy())
    todo, merges = np.flatnonzero(near < 0), []
    while len(live) > 1:
        means = s[live] / c[live, None]
        place, h[todo] = nearest_of(means[np.searchsorted(live, todo)], todo, live, means)
        near[todo] = live[place]
        low = live[np.isfinite(h[live])]
        a = low[(near[near[low]] == low) & (low < near[low])]
        if not len(a) and len(low):  # the last bits of equal distances may differ from both sides
            a = low[[h[low].argmin()]]
        if not len(a):
            break
        first, second = np.minimum(a, near[a]), np.maximum(a, near[a])
        merges += zip(first.tolist(), second.tolist(), h[a].tolist())
        s[first] += s[second]
        c[first] += c[second]
        gone, touched = np.zeros(len(s), bool), np.zeros(len(s), bool)
        gone[second] = True
        touched[first] = touched[second] = True
        live = live[~gone[live]]
        todo = live[touched[live] | touched[near[live]]]
    return merges


def cut_merges(n: int, merges: Sequence[tuple[int, int]], k: int) -> np.ndarray:
    """Cluster labels 0..k-1 (by first member) after the first n - k merges, given as pairs of members."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in merges[: n - k]:
        parent[find(b)] = find(a)
    roots: dict[int, int] = {}
    return np.array([roots.setdefault(find(i), len(roots)) for i in range(n)])


class MergeTree:
    """Average-linkage merges of a table: ``members`` (row_id, node) and ``edges`` (pid, near, h, at), cut at any k.

    A cluster goes by its first member's place in the order of ``row_id``, so NULL and repeated ids stay apart.
    Edges ordered by (at, h, pid) are merges from the lowest on.
    """

    def __init__(self, members: DataFrame, edges: DataFrame, n: int, row_id: str, small: bool):
        self.members, self.edges, self.n, self.row_id, self.small = members, edges, n, row_id, small

    def cut(self, ks: Sequence[int]) -> DataFrame:
        """``row_id, k, cluster`` for every k; clusters are numbered by first member."""
        if self.small:
            n = self.n

            def labels(pdf: pd.DataFrame) -> pd.DataFrame:
                e = pdf.dropna(subset=["pid"]).sort_values(["at", "h", "pid"])
                merges = list(zip(e["pid"].astype(int), e["near"].astype(int)))
                return pd.concat([pd.DataFrame({"node": np.arange(n), "k": k, "cluster": cut_merges(n, merges, k)}) for k in ks])

            one = self.edges.unionByName(self.edges.sparkSession.createDataFrame([(None, None, None, None)], self.edges.schema))  # n - 1 edges, never none
            coded = one.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(labels, "node long, k int, cluster int")
        else:
            coded = None
            for k in ks:
                one = self._connected(k).withColumn("k", F.lit(k))
                coded = one if coded is None else coded.unionByName(one)
        return self.members.join(coded, "node").select(self.row_id, "k", "cluster")

    def _connected(self, k: int) -> DataFrame:
        """(node, cluster) after the n - k lowest merges: every member takes the smallest node it reaches."""
        labels = self.members.select("node", F.col("node").alias("label"))
        low = materialize(self.edges.orderBy("at", "h", "pid").limit(self.n - k))
        both = materialize(low.select(F.col("pid").alias("a"), F.col("near").alias("b")).unionByName(low.select(F.col("near").alias("a"), F.col("pid").alias("b"))))
        while True:
            pushed = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("m"))
            nxt = labels.join(pushed, "node", "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label"))
            # Pointer jumping: follow the label's own label.
            hop = nxt.select(F.col("node").alias("label"), F.col("label").alias("far"))
            nxt = materialize(nxt.join(hop, "label", "left").select("node", F.coalesce("far", "label").alias("label")))
            changed = nxt.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
            labels = nxt
            if not changed:
                break
        codes = rank_in_group(labels.select("label").distinct(), [], [F.col("label")], "cluster")
        return labels.join(codes, "label").select("node", F.col("cluster").cast("int").alias("cluster"))


def merge_tree(df: DataFrame, row_id: str = "pid", z: str = "z", single_task: int | None = None) -> MergeTree:
    """Average-linkage cosine merges of all rows, computed once.

    A counted small set merges in one task.  A larger one merges all reciprocal nearest
    neighbours per round (average linkage is reducible, so the merge tree is the same)
    with clusters kept as (size, vector sum) rows; after a round only clusters that merged
    or whose neighbour did look for a new neighbour.  Once ``ROUND_ITEMS`` (or ``single_task``)
    are left, one task merges them by the same rounds without any further job.
    """
    members = materialize(rank_in_group(df.select(row_id, z), [], [F.col(row_id)], "node"))
    n = members.count()
    limit = SINGLE_TASK_ITEMS if single_task is None else single_task
    if n > limit:
        rest = max(limit, ROUND_ITEMS) if single_task is None else limit
        return MergeTree(members.select(row_id, "node"), _merge_rounds(members, z, n, rest), n, row_id, single_task is None and n <= CUT_ITEMS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        x = np.stack([np.asarray(v, float) for v in pdf["z"]])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return _edges_of(np.arange(len(x)), linkage_cosine(x))

    edges = members.select("node", F.col(z).alias("z"), F.lit(0).alias("_all")).groupBy("_all").applyInPandas(run, EDGES)
    return MergeTree(members.select(row_id, "node"), materialize(edges), n, row_id, True)


EDGES = "pid long, near long, h double, at long"


def _edges_of(pid: np.ndarray, merges: list[tuple[int, int, float]]) -> pd.DataFrame:
    """Merges as edges between first members; ``pid`` holds the first member of each item, in order."""
    first = list(range(len(pid)))  # of merged pairs too
    rows = []
    for at, (a, b, h) in enumerate(merges):
        low, high = sorted((first[a], first[b]))
        first.append(low)
        rows.append((pid[low], pid[high], h, at))
    return pd.DataFrame(rows, columns=["pid", "near", "h", "at"])


def agglomerative_cosine(df: DataFrame, k: int, row_id: str = "pid", z: str = "z", single_task: int | None = None) -> DataFrame:
    """Average-linkage cosine clustering into ``k`` clusters: ``row_id, cluster``; see ``merge_tree``."""
    tree = merge_tree(df, row_id, z, single_task)
    if k < 1 or k > tree.n:
        raise ValueError(f"cluster count must lie in [1, {tree.n}]")
    return tree.cut([k]).drop("k")


def _merge_rounds(items: DataFrame, z: str, n: int, single_task: int) -> DataFrame:
    """Merges (pid, near, h, at = 0) by reciprocal-nearest-neighbour rounds over the ``n`` rows of ``node`` and ``z``.

    Each round stores its tables in the checkpoint folder.  At most ``single_task`` clusters that are left
    merge in one task; edges are put in order by height, so it does not matter where they were found.
    """

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        pid, sums, sizes = pdf["pid"].to_numpy(), np.stack([np.asarray(v, float) for v in pdf["z"]]), pdf["c"].to_numpy()
        if len(pid) <= SINGLE_TASK_ITEMS:
            return _edges_of(pid, linkage_cosine(sums, sizes)).assign(at=0)
        known = pdf["near"].notna().to_numpy()
        near = np.where(known, np.searchsorted(pid, pdf["near"].fillna(-1).to_numpy()), -1)
        merges = linkage_rounds(sums, sizes, near, np.where(known, pdf["h"].to_numpy(), np.inf))
        low, high, h = (np.array([m[i] for m in merges], kind) for i, kind in enumerate((np.int64, np.int64, float)))
        return pd.DataFrame({"pid": pid[low], "near": pid[high], "h": h, "at": 0})

    def handed_over(edges: list[DataFrame], state: DataFrame) -> DataFrame:
        found = state.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(rest, EDGES)
        return materialize(reduce(DataFrame.unionByName, [*edges, found]))

    state = items.select(F.col("node").alias("pid"), l2_normalize(z).alias("z"), F.lit(1.0).alias("c"))
    if n <= single_task:
        return handed_over([], state.select("*", F.lit(None).cast("long").alias("near"), F.lit(None).cast("double").alias("h")))
    state = materialize(state)
    nn = materialize(_cluster_neighbours(state))
    edges: list[DataFrame] = []
    while True:
        other = nn.select(F.col("pid").alias("near"), F.col("near").alias("back"))
        mutual = materialize(nn.join(other, "near").where("back = pid and pid < near").select("pid", "near", "h"))
        found = mutual.count()
        if not found:  # the last bits of equal distances may differ from both sides
            mutual = materialize(nn.orderBy("h", "pid").limit(1).select(F.least("pid", "near").alias("pid"), F.greatest("pid", "near").alias("near"), "h"))
            found = mutual.count()
        if not found:
            return materialize(reduce(DataFrame.unionByName, edges)) if edges else state.sparkSession.createDataFrame([], EDGES)
        edges.append(mutual.withColumn("at", F.lit(0).cast("long")))
        target = mutual.select(F.col("near").alias("pid"), F.col("pid").alias("into"))
        moved = state.join(target, "pid", "left").withColumn("pid", F.coalesce("into", "pid")).drop("into")
        pairs = moved.groupBy("pid").agg(F.collect_list(F.struct("z", "c")).alias("m"))  # at most two rows each
        add = F.aggregate(F.slice("m.z", 2, 1), F.element_at("m.z", 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
        state = materialize(pairs.select("pid", add.alias("z"), F.aggregate("m.c", F.lit(0.0), lambda a, b: a + b).alias("c")))
        n -= found
        touched = mutual.select(F.explode(F.array("pid", "near")).alias("t"))
        kept = nn.join(touched.withColumnRenamed("t", "pid"), "pid", "left_anti").join(touched.withColumnRenamed("t", "near"), "near", "left_anti")
        kept = materialize(kept.select("pid", "near", "h"))
        if 1 < n <= single_task:
            return handed_over(edges, state.join(kept, "pid", "left"))
        dirty = state.join(kept.select("pid"), "pid", "left_anti")
        nn = materialize(kept.unionByName(_neighbours_of(dirty, state)))


def _nearest(a: pa.Table, b: pa.Table) -> pa.Table:
    """The nearest of the clusters ``b`` for each of ``a``, smaller id first on ties."""
    b = b.sort_by("pid")
    ids, own = b.column("pid").to_numpy(), a.column("pid").to_numpy()
    means = lambda t: matrix(t.column("z")) / t.column("c").to_numpy()[:, None]
    place, h = nearest_of(means(a), own, ids, means(b))
    ok = np.isfinite(h)
    return pa.table({"pid": own[ok], "near": ids[place[ok]], "h": h[ok]})


def _closest(parts: DataFrame) -> DataFrame:
    best = parts.groupBy("pid").agg(F.min(F.struct("h", "near")).alias("b"))
    return best.select("pid", F.col("b.near").alias("near"), F.col("b.h").alias("h"))


def _neighbours_of(some: DataFrame, state: DataFrame) -> DataFrame:
    """Nearest other cluster of the clusters ``some`` among all: ``pid, near, h``."""

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"pid": pa.array([], pa.int64()), "near": pa.array([], pa.int64()), "h": pa.array([], pa.float64())})
        return _nearest(a, b)

    some = materialize(some)
    return _closest(cross_tiles(some.toDF(*some.columns), state, "pid", "pid", kernel, "pid long, near long, h double", BLOCK_ITEMS))


def _cluster_neighbours(state: DataFrame) -> DataFrame:
    """Nearest other cluster of every cluster: ``pid, near, h`` (smaller id first on ties)."""

    def kernel(_: tuple, a: pa.Table, b: pa.Table | None) -> pa.Table:
        return _nearest(a, a) if b is None else pa.concat_tables([_nearest(a, b), _nearest(b, a)])

    return _closest(self_tiles(state.withColumn("one", F.lit(0)), ["one"], "pid", kernel, "pid long, near long, h double", BLOCK_ITEMS))


def select_k(items: DataFrame, method: str, k_min: int, k_max: int, row_id: str = "pid", z: str = "z", seed: int = 42) -> tuple[int, DataFrame, list[tuple[int, float | None]]]:
    """Cluster count with the best cosine silhouette (first wins); undefined scores rank last.

    Average linkage builds its merge tree once and cuts it at every k.
    """
    n = items.count()
    low, high = max(2, k_min), min(k_max, max(2, n - 1))
    if high < low:
        low, high = 2, max(2, n - 1)
    ks = list(range(low, high + 1))
    if method == "agglomerative_cosine":
        cuts = materialize(merge_tree(items, row_id, z).cut(ks))
        labels_of = {k: cuts.where(F.col("k") == k).drop("k") for k in ks}
    else:
        labels_of = {k: materialize(cluster(items, method, k, row_id, z, seed)) for k in ks}
    best, scores = None, []
    for k, labels in labels_of.items():
        s = cluster_silhouette(items, labels, row_id, z)
        scores.append((k, s))
        rank = -1e18 if s is None else s
        if best is None or rank > best[0]:
            best = (rank, k, labels)
    return best[1], best[2], scores


def cluster(items: DataFrame, method: str, k: int, row_id: str = "pid", z: str = "z", seed: int = 42) -> DataFrame:
    if method == "kmeans":
        return kmeans(items, k, z, seed).select(row_id, "cluster")
    if method == "agglomerative_cosine":
        return agglomerative_cosine(items, k, row_id, z)
    raise ValueError(f"unsupported cluster method {method}")


def cluster_silhouette(items: DataFrame, labels: DataFrame, row_id: str, z: str) -> float | None:
    """Cosine silhouette of a labelling; a singleton cluster's member scores 0, as is usual."""
    pts = items.join(labels, row_id).select(F.xxhash64(F.col(row_id).cast("string")).alias("pid"), F.col("cluster").cast("string").alias("family"), F.col(z).alias("z"))
    return _silhouette_with_singletons(materialize(pts))


def _silhouette_with_singletons(pts: DataFrame) -> float | None:
    sizes = pts.groupBy("family").agg(F.count(F.lit(1)).alias("c"))
    shape = sizes.agg(F.count(F.lit(1)).alias("f"), F.sum("c").alias("n")).first()
    if shape["f"] < 2 or shape["f"] >= shape["n"]:
        return None
    return silhouette_values(pts, []).agg(F.avg("_v")).first()[0]


def discover_taxonomy(
    points: DataFrame, discovery: Sequence[int], method: str = "agglomerative_cosine", k: int = 0, k_min: int = 2,
    k_max: int = 8, corruption: str = "corruption", severity: str = "severity", z: str = "z", seed: int = 42,
) -> tuple[DataFrame, int, list[tuple[int, float | None]]]:
    """Cluster one mean vector per corruption (discovery severities only).

    Returns (``corruption, family`` table, chosen k, scores); families are named
    ``discovered_family_00`` ... in cluster order.
    """
    protos = mean_vector(points.where(F.col(severity).isin(list(discovery))), [corruption], z, "z")
    protos = materialize(protos.withColumn("pid", F.col(corruption).cast("string")))
    n = protos.count()
    if n < 2:
        raise ValueError("taxonomy discovery needs at least 2 corruptions")
    if k > 0:
        if k < 2 or k > n:
            raise ValueError(f"family count must lie in [2, {n}]")
        labels = materialize(cluster(protos, method, k, "pid", "z", seed))
        chosen, scores = k, [(k, cluster_silhouette(protos, labels, "pid", "z"))]
    else:
        chosen, labels, scores = select_k(protos, method, k_min, k_max, "pid", "z", seed)
    named = protos.join(labels, "pid").select(
        corruption, F.concat(F.lit("discovered_family_"), F.lpad(F.col("cluster").cast("string"), 2, "0")).alias("family")
    )
    return named, chosen, scores


def relabel(points: DataFrame, mapping: DataFrame, corruption: str = "corruption") -> DataFrame:
    """Points with the discovered family; a corruption outside the mapping keeps its own name."""
    from ..plans.lookup import attach_facts

    base = points.drop("family")
    out = attach_facts(base, mapping, [corruption], [c for c in base.columns if c != corruption][:1], "left")
    return out.withColumn("family", F.coalesce("family", F.col(corruption).cast("string")))


def agreement(df: DataFrame, truth: str, guess: str, scope: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index and arithmetic-mean normalised mutual information from the contingency table."""
    scope = list(scope)
    cell = df.groupBy(*scope, truth, guess).agg(F.count(F.lit(1)).cast("double").alias("c"))
    rows = cell.groupBy(*scope, truth).agg(F.sum("c").alias("a"))
    cols = cell.groupBy(*scope, guess).agg(F.sum("c").alias("b"))
    full = cell.join(rows, [*scope, truth]).join(cols, [*scope, guess])
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    plogp = lambda c: F.sum(F.col(c) * F.log(c))
    cells = full.groupBy(*scope).agg(pairs("c").alias("sc"), F.sum("c").alias("n"), F.sum(F.col("c") * F.log(F.col("c") / (F.col("a") * F.col("b")))).alias("mi0"))
    ra = rows.groupBy(*scope).agg(pairs("a").alias("sa"), plogp("a").alias("ha"), F.count(F.lit(1)).alias("ka"))
    cb = cols.groupBy(*scope).agg(pairs("b").alias("sb"), plogp("b").alias("hb"), F.count(F.lit(1)).alias("kb"))
    if scope:
        t = cells.join(ra, scope).join(cb, scope)
    else:
        t = cells
        for side in (ra, cb):
            for c in side.columns:
                t = t.withColumn(c, side.select(c).scalar())
    n = F.col("n")
    expect = F.col("sa") * F.col("sb") / (n * (n - 1) / 2)
    top = (F.col("sa") + F.col("sb")) / 2
    same = (F.col("ka") == F.col("kb")) & ((F.col("ka") == 1) | (F.col("ka") == n))
    ari = F.when(same, F.lit(1.0)).otherwise((F.col("sc") - expect) / (top - expect))
    ha, hb = F.log(n) - F.col("ha") / n, F.log(n) - F.col("hb") / n
    mi = F.col("mi0") / n + F.log(n)
    nmi = F.when(same, F.lit(1.0)).when(mi <= 1e-15, F.lit(0.0)).otherwise(mi / ((ha + hb) / 2))
    return t.select(*scope, ari.alias("ari"), nmi.alias("nmi"))
