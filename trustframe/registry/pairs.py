"""Queries: separation of families in embedding space, per scope."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize
from ..operators import pairs as P
from ..session import materialize
from .fixtures import EMB, PAIRS, pair_points, r6

SCOPE = ["scope"]
TOPK = 8
PERMUTATIONS = 20
SEED = 5


def _separation(metric):
    def query(spark, d):
        s = P.separation(P.pair_moments(pair_points(spark, d), SCOPE, metric), SCOPE)
        cols = ("within_mean_distance", "between_mean_distance", "separation_margin")
        return s.select("scope", "pair_count_within", "pair_count_between", *[r6(c) for c in cols])

    return query


def _cohens(metric):
    def query(spark, d):
        return P.separation(P.pair_moments(pair_points(spark, d), SCOPE, metric), SCOPE).select("scope", r6("cohens_d"))

    return query


def _auroc(metric):
    return lambda spark, d: P.pair_auroc(P.rank_counts(pair_points(spark, d), SCOPE, metric, ties=False), SCOPE).select("scope", r6("auroc"))


def _ap(metric):
    return lambda spark, d: P.average_precision(P.rank_counts(pair_points(spark, d), SCOPE, metric), SCOPE).select("scope", r6("average_precision"))


def _nn(spark, d, metric, k):
    pts = pair_points(spark, d)
    return pts, P.nearest_neighbours(P.tile_stats(pts, SCOPE, metric, {"nn"}, k=k), pts, SCOPE, k)


def knn_purity(spark, d):
    pts, nn = _nn(spark, d, "l2", 5)
    sizes = pts.groupBy("scope").agg(F.count(F.lit(1)).alias("n_points"))
    return P.knn_purity(materialize(nn), sizes, SCOPE, [1, 3, 5]).select("scope", "k", r6("purity_mean"), r6("purity_median"))


def knn_neighbours(spark, d):
    _, nn = _nn(spark, d, "cosine", 3)
    return nn.select("scope", "pid", "rank", "neighbour", r6("distance"))


def misfit_rate(spark, d):
    _, nn = _nn(spark, d, "l2", 1)
    return P.misfits(nn).groupBy("scope").agg(r6(F.avg(F.col("misfit").cast("double")), "misfit_rate"))


def misfit_per_family(spark, d):
    _, nn = _nn(spark, d, "l2", 1)
    return P.misfits(nn).groupBy("scope", "family").agg(r6(F.avg(F.col("misfit").cast("double")), "misfit_rate"))


def misfit_examples(spark, d):
    _, nn = _nn(spark, d, "l2", 1)
    return P.misfit_examples(P.misfits(nn), SCOPE, 25).select("scope", "pid", "family", "neighbour", "neighbour_family", r6("distance"))


def _loo(metric):
    def query(spark, d):
        p = P.loo_centroid(pair_points(spark, d), SCOPE, metric)
        return P.accuracy_and_f1(p, SCOPE).select("scope", r6("loo_accuracy"), r6("loo_macro_f1"))

    return query


def loo_predictions(spark, d):
    p = P.loo_centroid(pair_points(spark, d), SCOPE, "l2")
    return p.select("scope", "pid", "pred", r6("pred_distance"))


def topk_overlap(spark, d):
    o = P.topk_overlap(P.tile_stats(pair_points(spark, d), SCOPE, "l2", {"jac"}, topk=TOPK), SCOPE)
    return o.select("scope", *[r6(c) for c in ("jaccard_within_mean", "jaccard_between_mean", "jaccard_gap")])


def _silhouette(metric):
    return lambda spark, d: P.silhouette(pair_points(spark, d), SCOPE, metric).select("scope", r6("silhouette"))


def _permutation(metric):
    return lambda spark, d: P.permutation_pvalue(pair_points(spark, d), metric, PERMUTATIONS, SEED).select("valid", "count_ge", r6("pvalue"))


def _permutation_scoped(metric):
    """Shuffles inside each scope."""
    return lambda spark, d: P.permutation_pvalue(pair_points(spark, d), metric, PERMUTATIONS, SEED, scope=SCOPE).select("scope", "valid", "count_ge", r6("pvalue"))


def sampled_separation(spark, d):
    """The same means from an even sample of 5,000 of all pairs."""
    s = P.sampled_pairs(pair_points(spark, d), 5000, SEED, "l2", TOPK)
    return s.groupBy("same").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("distance"), "mean_distance"), r6(F.avg("overlap"), "mean_overlap"))


def scoped_metrics(spark, d):
    """Pooled and per-scope metrics x raw/normalised x L2/cosine, one row per metric."""
    base = pair_points(spark, d)
    pooled = base.withColumn("scope", F.lit("pooled")).unionByName(base.withColumn("scope", F.concat(F.lit("modality:"), F.col("scope").cast("string"))))
    return metric_table(pooled, "fixture").select("encoder", "delta_variant", "scope", "distance", "metric", r6("value"))


def metric_table(points, encoder: str, ks=(1, 3, 5), topk: int = TOPK, n_perm: int = PERMUTATIONS, seed: int = SEED):
    """Tall metric table ``encoder, delta_variant, scope, distance, metric, value``."""
    variants = points.withColumn("delta_variant", F.lit("raw")).unionByName(
        points.withColumn("z", l2_normalize("z")).withColumn("delta_variant", F.lit("l2_normalized"))
    )
    pts = materialize(variants)
    keys = ["delta_variant", "scope"]
    sizes = materialize(pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points")))
    out = None
    for metric in ("l2", "cosine"):
        kinds = {"nn", "jac"} | ({"mom", "fam"} if metric == "l2" else set())
        stats = materialize(P.tile_stats(pts, keys, metric, kinds, k=max(ks), topk=topk))
        nn = materialize(P.nearest_neighbours(stats, pts, keys, max(ks)))
        ranks = materialize(P.rank_counts(pts, keys, metric))
        wide = P.separation(P.pair_moments(pts, keys, metric, stats), keys)
        purity = P.knn_purity(nn, sizes, keys, ks).groupBy(*keys).pivot("k", list(ks)).agg(
            F.first("purity_mean").alias("mean"), F.first("purity_median").alias("median")
        )
        for k in ks:
            purity = purity.withColumnRenamed(f"{k}_mean", f"knn_purity_mean@{k}").withColumnRenamed(f"{k}_median", f"knn_purity_median@{k}")
        parts = [
            sizes, P.silhouette(pts, keys, metric, stats), P.pair_auroc(ranks, keys), P.average_precision(ranks, keys), purity,
            P.accuracy_and_f1(P.loo_centroid(pts, keys, metric), keys), P.topk_overlap(stats, keys),
            P.permutation_pvalue(pts, metric, n_perm, seed, scope=keys).select(*keys, F.col("pvalue").alias("permutation_pvalue")),
            P.misfits(nn).groupBy(*keys).agg(F.avg(F.col("misfit").cast("double")).alias("misfit_rate")),
        ]
        for p in parts:
            wide = wide.join(p, keys, "left")
        names = [c for c in wide.columns if c not in keys]
        tall = wide.select(*keys, *[F.col(c if "@" not in c else f"`{c}`").cast("double").alias(c) for c in names]).unpivot(keys, [F.col(f"`{c}`") for c in names], "metric", "value")
        tall = tall.withColumn("distance", F.lit(metric))
        out = tall if out is None else out.unionByName(tall)
    return out.withColumn("encoder", F.lit(encoder)).select("encoder", "delta_variant", "scope", "distance", "metric", "value")


QUERIES = {
    "pair_separation": _separation("l2"),
    "pair_separation_cosine": _separation("cosine"),
    "cohens_d": _cohens("l2"),
    "cohens_d_cosine": _cohens("cosine"),
    "pair_auroc": _auroc("l2"),
    "pair_auroc_cosine": _auroc("cosine"),
    "pair_ap": _ap("l2"),
    "knn_purity": knn_purity,
    "knn_neighbours": knn_neighbours,
    "misfit_rate": misfit_rate,
    "misfit_per_family": misfit_per_family,
    "misfit_examples": misfit_examples,
    "loo_centroid": _loo("l2"),
    "loo_centroid_cosine": _loo("cosine"),
    "loo_predictions": loo_predictions,
    "topk_overlap": topk_overlap,
    "silhouette_l2": _silhouette("l2"),
    "silhouette_cosine": _silhouette("cosine"),
    "permutation_pvalue": _permutation("l2"),
    "permutation_pvalue_cosine": _permutation("cosine"),
    "permutation_scoped": _permutation_scoped("l2"),
    "permutation_scoped_cosine": _permutation_scoped("cosine"),
    "sampled_separation": sampled_separation,
    "scoped_metrics": scoped_metrics,
}


def _sep_sql(d):
    return f"""WITH {PAIRS}
SELECT scope, count(*) FILTER (same) AS pair_count_within, count(*) FILTER (NOT same) AS pair_count_between,
       round(avg({d}) FILTER (same), 6) AS within_mean_distance, round(avg({d}) FILTER (NOT same), 6) AS between_mean_distance,
       round(avg({d}) FILTER (NOT same) - avg({d}) FILTER (same), 6) AS separation_margin FROM pr GROUP BY scope"""


def _cohen_sql(d):
    return f"""WITH {PAIRS}, g AS (SELECT scope, count(*) FILTER (same) AS na, count(*) FILTER (NOT same) AS nb,
 avg({d}) FILTER (same) AS ma, avg({d}) FILTER (NOT same) AS mb, var_samp({d}) FILTER (same) AS va, var_samp({d}) FILTER (NOT same) AS vb FROM pr GROUP BY scope)
SELECT scope, round((mb - ma) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS cohens_d FROM g"""


def _auroc_sql(d):
    return f"""WITH {PAIRS}, s AS (SELECT scope, same, -{d} AS sc FROM pr),
r AS (SELECT *, rank() OVER (PARTITION BY scope ORDER BY sc) + (count(*) OVER (PARTITION BY scope, sc) - 1) / 2.0::DOUBLE AS r FROM s)
SELECT scope, round((sum(r) FILTER (same) - count(*) FILTER (same) * (count(*) FILTER (same) + 1) / 2.0::DOUBLE) / (count(*) FILTER (same) * count(*) FILTER (NOT same)), 6) AS auroc
FROM r GROUP BY scope"""


def _ap_sql(d):
    return f"""WITH {PAIRS}, h AS (SELECT scope, {d} AS b, count(*) FILTER (same) AS p, count(*) AS n FROM pr GROUP BY 1, 2),
c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM h WINDOW w AS (PARTITION BY scope ORDER BY b))
SELECT scope, round(sum(p * (cp::DOUBLE / cn)) / sum(p), 6) AS average_precision FROM c GROUP BY scope"""


_NN = PAIRS + """,
nn AS (SELECT *, row_number() OVER (PARTITION BY scope, pid ORDER BY d_l2, oid) AS rk, row_number() OVER (PARTITION BY scope, pid ORDER BY d_cos, oid) AS rkc FROM sym)"""
_LOO_SUMS = EMB + """,
ln AS (SELECT scope, vec_id, family, unnest(range(0, 64)) AS dim, unnest(z) AS v FROM emb),
fs AS (SELECT scope, family AS fam, dim, sum(v) AS s, count(*) AS n FROM ln GROUP BY ALL),
cd AS (SELECT l.scope, l.vec_id, l.family, fs.fam, sum((l.v - c) * (l.v - c)) AS d2, sum(l.v * c) AS xc, sum(l.v * l.v) AS xx, sum(c * c) AS cc
  FROM (SELECT l.*, fs.fam, CASE WHEN fs.fam = l.family THEN (s - v) / nullif(n - 1, 0) ELSE s / n END AS c FROM ln l JOIN fs ON fs.scope = l.scope AND fs.dim = l.dim) l
  JOIN (SELECT DISTINCT scope, fam FROM fs) fs ON fs.scope = l.scope AND fs.fam = l.fam WHERE c IS NOT NULL GROUP BY ALL)"""


def _loo_sql(dist):
    return f"""WITH {_LOO_SUMS},
p AS (SELECT scope, vec_id, family, fam AS pred FROM (SELECT *, row_number() OVER (PARTITION BY scope, vec_id ORDER BY {dist}, fam) AS rn FROM cd) WHERE rn = 1),
l AS (SELECT scope, family AS lab FROM p UNION SELECT scope, pred FROM p),
f AS (SELECT l.scope, lab, 2.0::DOUBLE * count(*) FILTER (p.family = lab AND p.pred = lab) / (count(*) FILTER (p.family = lab) + count(*) FILTER (p.pred = lab)) AS f1
  FROM l JOIN p ON p.scope = l.scope GROUP BY l.scope, lab)
SELECT scope, round((SELECT avg((family = pred)::INT) FROM p WHERE p.scope = f.scope), 6) AS loo_accuracy, round(avg(f1), 6) AS loo_macro_f1 FROM f GROUP BY scope"""


def _sil_sql(d):
    return f"""WITH {PAIRS}, m AS (SELECT scope, pid, family, ofam, avg({d}) AS m FROM sym GROUP BY ALL),
ab AS (SELECT scope, pid, max(m) FILTER (ofam = family) AS a, min(m) FILTER (ofam <> family) AS b FROM m GROUP BY scope, pid),
g AS (SELECT scope, min(c) AS lo, count(*) AS k FROM (SELECT scope, family, count(*) AS c FROM emb GROUP BY ALL) GROUP BY scope)
SELECT g.scope, round(CASE WHEN any_value(lo) >= 2 AND any_value(k) >= 2 THEN avg((b - a) / greatest(a, b)) END, 6) AS silhouette FROM g JOIN ab USING (scope) GROUP BY g.scope"""


def _perm_sql(dist, scoped=False):
    """Labels by the same bit fields, round by round; numbers beyond n go round again."""
    sc, on = ("scope", "a.scope = b.scope AND ") if scoped else ("0 AS scope", "")
    mix = "xor(((xor(xor(y >> 16, y) * 73244475 & 4294967295, (xor(y >> 16, y) * 73244475 & 4294967295) >> 16)) * 73244475 & 4294967295) >> 16, (xor(xor(y >> 16, y) * 73244475 & 4294967295, (xor(y >> 16, y) * 73244475 & 4294967295) >> 16)) * 73244475 & 4294967295)"
    return f"""WITH RECURSIVE {EMB},
ap AS (SELECT {"a.scope AS scope" if scoped else "0 AS scope"}, a.vec_id AS a_id, b.vec_id AS b_id, a.family = b.family AS same, {dist} AS d FROM emb a JOIN emb b ON {on}a.vec_id < b.vec_id),
sz AS (SELECT scope, family, sum(c) OVER (PARTITION BY scope ORDER BY family::VARCHAR) AS hi FROM (SELECT {sc}, family, count(*) AS c FROM emb GROUP BY ALL)),
nb AS (SELECT {sc}, vec_id, row_number() OVER (PARTITION BY {"scope" if scoped else "0"} ORDER BY vec_id) - 1 AS i FROM emb),
n AS (SELECT scope, n, greatest(2, CASE WHEN n < 2 THEN 0 ELSE length(bin(n - 1)) END)::INT AS bits FROM (SELECT scope, count(*) AS n FROM nb GROUP BY scope)),
ky AS (SELECT p, k, CAST('0x' || substr(md5('{SEED}|' || p || '|' || k), 1, 8) AS BIGINT) AS ky FROM (SELECT unnest(range(0, {PERMUTATIONS})) AS p), (SELECT unnest(range(0, 10)) AS k)),
fe AS (SELECT nb.scope, vec_id, p, 0::BIGINT AS k, i::BIGINT AS x, n, bits // 2 AS low FROM nb JOIN n USING (scope), (SELECT unnest(range(0, {PERMUTATIONS})) AS p)
  UNION ALL SELECT scope, vec_id, p, k + 1, CASE WHEN k % 2 = 0 THEN (xor(x >> low, {mix} & ((1::BIGINT << (bits - low)) - 1)) << low) + (x & ((1::BIGINT << low) - 1))
    ELSE ((x >> low) << low) + xor(x & ((1::BIGINT << low) - 1), {mix} & ((1::BIGINT << low) - 1)) END, n, low
  FROM (SELECT fe.scope, vec_id, fe.p, fe.k % 10 AS k, x, fe.n, low, bits, (CASE WHEN fe.k % 2 = 0 THEN x & ((1::BIGINT << low) - 1) ELSE x >> low END + ky) & 4294967295 AS y
    FROM fe JOIN n USING (scope) JOIN ky ON ky.p = fe.p AND ky.k = fe.k % 10 WHERE fe.k < 10 OR fe.x >= fe.n)),
lb AS (SELECT scope, p, vec_id, (SELECT count(*) FROM sz WHERE sz.scope = fe.scope AND hi <= x) AS lab FROM fe WHERE k = 10 AND x < n),
w AS (SELECT ap.scope AS scope, x.p AS p, avg(d) FILTER (x.lab <> y.lab) - avg(d) FILTER (x.lab = y.lab) AS margin FROM ap JOIN lb x ON x.vec_id = a_id AND x.scope = ap.scope JOIN lb y ON y.vec_id = b_id AND y.p = x.p AND y.scope = ap.scope GROUP BY ap.scope, x.p),
o AS (SELECT scope, avg(d) FILTER (NOT same) - avg(d) FILTER (same) AS margin FROM ap GROUP BY scope)
SELECT {"scope, " if scoped else ""}count(*) AS valid, count(*) FILTER (w.margin >= o.margin) AS count_ge, round((count(*) FILTER (w.margin >= o.margin) + 1)::DOUBLE / (count(*) + 1), 6) AS pvalue
FROM w JOIN o USING (scope) GROUP BY scope"""


_TOPK = PAIRS.replace("list_distance(a.z, b.z) AS d_l2", "len(list_intersect(a.top, b.top)) AS common, list_distance(a.z, b.z) AS d_l2").replace(
    "FROM emb a JOIN emb b", "FROM tp a JOIN tp b"
).replace(",\npr AS (", """,
tp AS (SELECT emb.*, (SELECT list(i) FROM (SELECT unnest(range(0, 64)) AS i, unnest(z) AS v ORDER BY abs(v) DESC, i LIMIT 8)) AS top FROM emb),
pr AS (""")
_SAMPLED = f"""WITH {EMB},
nb AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM emb),
c AS (SELECT count(*) AS n, count(*) * (count(*) - 1) // 2 AS tot FROM emb),
m AS (SELECT n, tot, least(5000, tot) AS m FROM c),
s AS (SELECT id, n, tot // m AS w, tot % m AS ex FROM (SELECT unnest(range(0, m)) AS id, * FROM m)),
q AS (SELECT n, id * w + least(id, ex) + CAST('0x' || substr(md5('{SEED}|' || id), 1, 15) AS BIGINT) % (CASE WHEN id < ex THEN w + 1 ELSE w END) AS code FROM s),
st AS (SELECT i, i * (2 * n - i - 1) // 2 AS first FROM nb JOIN c ON true),
ij AS (SELECT st.i, code - st.first + st.i + 1 AS j FROM q ASOF JOIN st ON q.code >= st.first),
tp AS (SELECT nb.*, (SELECT list(k) FROM (SELECT unnest(range(0, 64)) AS k, unnest(z) AS v ORDER BY abs(v) DESC, k LIMIT 8)) AS top FROM nb),
p AS (SELECT a.family = b.family AS same, list_distance(a.z, b.z) AS d, len(list_intersect(a.top, b.top)) AS c FROM ij JOIN tp a ON a.i = ij.i JOIN tp b ON b.i = ij.j)
SELECT same, count(*) AS n, round(avg(d), 6) AS mean_distance, round(avg(c / (16.0::DOUBLE - c)), 6) AS mean_overlap FROM p GROUP BY same"""

def _knn_sql(rk):
    return f"""WITH {_NN}, k AS (SELECT unnest([1, 3, 5]) AS k),
s AS (SELECT scope, k, pid, avg((family = ofam)::INT) AS share FROM nn JOIN k ON {rk} <= k GROUP BY ALL)
SELECT scope, k, round(avg(share), 6) AS purity_mean, round(median(share), 6) AS purity_median FROM s GROUP BY scope, k"""


def _misfit_sql(rk):
    return f"WITH {_NN} SELECT scope, round(avg((family <> ofam)::INT), 6) AS misfit_rate FROM nn WHERE {rk} = 1 GROUP BY scope"


_TOPK_SQL = f"""WITH {_TOPK}
SELECT scope, round(avg(common / (16.0::DOUBLE - common)) FILTER (same), 6) AS jaccard_within_mean, round(avg(common / (16.0::DOUBLE - common)) FILTER (NOT same), 6) AS jaccard_between_mean,
       round(avg(common / (16.0::DOUBLE - common)) FILTER (same) - avg(common / (16.0::DOUBLE - common)) FILTER (NOT same), 6) AS jaccard_gap FROM pr GROUP BY scope"""
# Points of the tall table: pooled and by scope, raw and of unit length; the scope's name states both.
_VARIANTS = EMB.replace("emb AS", "emb0 AS") + """,
emb AS (SELECT vec_id, family, severity, corruption, v || '|' || s AS scope, CASE v WHEN 'raw' THEN z ELSE list_transform(z, lambda x: x / greatest(sqrt(list_sum(list_transform(z, lambda y: y * y))), 1e-12)) END AS z
  FROM (SELECT *, unnest(['raw', 'l2_normalized']) AS v FROM (SELECT *, unnest(['pooled', 'modality:' || scope]) AS s FROM emb0)))"""


def _tall_sql():
    """All metrics as rows, from the SQL of each."""
    parts = []
    for metric, d, rk, loo in (("l2", "d_l2", "rk", "d2"), ("cosine", "d_cos", "rkc", "1 - xc / (sqrt(xx) * sqrt(cc))")):
        dist = "list_distance(a.z, b.z)" if metric == "l2" else "list_cosine_distance(a.z, b.z)"
        sep = _sep_sql(d).replace("SELECT scope, count(*) FILTER (same) AS pair_count_within", "SELECT scope, count(*) AS pair_count_used, count(*) FILTER (same) AS pair_count_within")
        wide = [
            (f"WITH {EMB} SELECT scope, count(*) AS n_points FROM emb GROUP BY scope", ["n_points"]),
            (sep, ["pair_count_used", "pair_count_within", "pair_count_between", "within_mean_distance", "between_mean_distance", "separation_margin"]),
            (_cohen_sql(d), ["cohens_d"]), (_auroc_sql(d), ["auroc"]), (_ap_sql(d), ["average_precision"]), (_sil_sql(d), ["silhouette"]),
            (_loo_sql(loo), ["loo_accuracy", "loo_macro_f1"]), (_TOPK_SQL, ["jaccard_within_mean", "jaccard_between_mean", "jaccard_gap"]),
            (_misfit_sql(rk), ["misfit_rate"]), (_perm_sql(dist, True).replace("pvalue\nFROM", "permutation_pvalue\nFROM"), ["permutation_pvalue"]),
        ]
        rows = [(sql, [(f"'{c}'", c) for c in cols]) for sql, cols in wide]
        rows.append((_knn_sql(rk), [(f"'knn_purity_{c}@' || k", f"purity_{c}") for c in ("mean", "median")]))
        for sql, cols in rows:
            cells = ", ".join(f"{{'m': {name}, 'v': {c}::DOUBLE}}" for name, c in cols)
            parts.append(f"SELECT split_part(scope, '|', 1) AS delta_variant, split_part(scope, '|', 2) AS scope, '{metric}' AS distance, u.m AS metric, u.v AS value FROM (SELECT scope, unnest([{cells}]) AS u FROM ({sql.replace(EMB, _VARIANTS)}))")
    return "SELECT 'fixture' AS encoder, delta_variant, scope, distance, metric, round(value, 6) AS value FROM (" + "\nUNION ALL ".join(parts) + ")"


ORACLE = {
    "scoped_metrics": _tall_sql(),
    "pair_separation": _sep_sql("d_l2"),
    "pair_separation_cosine": _sep_sql("d_cos"),
    "cohens_d": _cohen_sql("d_l2"),
    "cohens_d_cosine": _cohen_sql("d_cos"),
    "pair_auroc": _auroc_sql("d_l2"),
    "pair_auroc_cosine": _auroc_sql("d_cos"),
    "pair_ap": _ap_sql("d_l2"),
    "knn_purity": _knn_sql("rk"),
    "knn_neighbours": f"WITH {_NN} SELECT scope, pid, CAST(rkc AS INTEGER) AS rank, oid AS neighbour, round(d_cos, 6) AS distance FROM nn WHERE rkc <= 3",
    "misfit_rate": _misfit_sql("rk"),
    "misfit_per_family": f"WITH {_NN} SELECT scope, family::VARCHAR AS family, round(avg((family <> ofam)::INT), 6) AS misfit_rate FROM nn WHERE rk = 1 GROUP BY 1, 2",
    "misfit_examples": f"""WITH {_NN}, m AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY pid) AS q FROM nn WHERE rk = 1 AND family <> ofam)
SELECT scope, pid, family::VARCHAR AS family, oid AS neighbour, ofam::VARCHAR AS neighbour_family, round(d_l2, 6) AS distance FROM m WHERE q <= 25""",
    "loo_centroid": _loo_sql("d2"),
    "loo_centroid_cosine": _loo_sql("1 - xc / (sqrt(xx) * sqrt(cc))"),
    "loo_predictions": f"""WITH {_LOO_SUMS}
SELECT scope, vec_id AS pid, fam::VARCHAR AS pred, round(sqrt(d2), 6) AS pred_distance
FROM (SELECT *, row_number() OVER (PARTITION BY scope, vec_id ORDER BY d2, fam) AS rn FROM cd) WHERE rn = 1""",
    "topk_overlap": _TOPK_SQL,
    "silhouette_l2": _sil_sql("d_l2"),
    "silhouette_cosine": _sil_sql("d_cos"),
    "permutation_pvalue": _perm_sql("list_distance(a.z, b.z)"),
    "permutation_pvalue_cosine": _perm_sql("list_cosine_distance(a.z, b.z)"),
    "permutation_scoped": _perm_sql("list_distance(a.z, b.z)", True),
    "permutation_scoped_cosine": _perm_sql("list_cosine_distance(a.z, b.z)", True),
    "sampled_separation": _SAMPLED,
}
