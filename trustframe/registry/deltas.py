"""Queries: clean/corrupt matching, deltas, sampling, splits, clustering and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as cl
from ..operators import deltas as D
from ..session import materialize
from .fixtures import DELTA, EMB, deltas, embeddings, r6

# Corruption ids of the fixture with the family each is mapped to; ids 18 and 19 stay unmapped.
MAPPED = {f"fam{c // 4}": [str(c + i) for i in range(4) if c + i < 18] for c in range(0, 20, 4)}


def clean_only(spark, d):
    return embeddings(spark, d).where("family = 0").select("vec_id", "scope", "severity")


def delta_points(spark, d):
    dl = deltas(spark, d)
    return dl.select("vec_id", F.posexplode("delta").alias("dim", "v")).select("vec_id", "dim", r6("v", "value"))


def _agg(mode):
    def query(spark, d):
        return D.aggregate_delta(deltas(spark, d), ["corruption"], mode).select("corruption", "dim", r6("value"))

    query.__doc__ = f"Per-corruption {mode} of the deltas."
    return query


def delta_per_image(spark, d):
    """Per-image points: at most 12 sampled deltas per scope and corruption, with ids and norms."""
    from ..functions.scoring import point_id
    from ..functions.vectors import l2_norm

    s = D.sample_n(deltas(spark, d), ["scope", "corruption"], "vec_id", 3, 7)
    return s.select(point_id("scope", "corruption", "severity", "vec_id").alias("point_id"), "vec_id", r6(l2_norm("delta"), "norm"))


def _matched(spark, d):
    """Clean = family 0 rows, one per slot; corrupt = the others, sample = slot they cycle onto."""
    from ..plans.ranks import rank_in_group

    e = embeddings(spark, d)
    good = rank_in_group(e.where("family = 0"), [], [F.col("vec_id")], "slot", total="n_clean")
    n = good.agg(F.max("n_clean"))
    bad = rank_in_group(e.where("family <> 0"), [], [F.col("vec_id")], "k").withColumn("slot", F.pmod(F.col("k"), n.scalar()))
    label = (F.col("slot") % 3).alias("lab")
    clean = good.select(F.lit("all").alias("modality"), "slot", label, "z")
    # Every 11th corrupt row carries a wrong label.
    wrong = F.when(F.col("k") % 11 == 0, F.lit(9)).otherwise(F.col("slot") % 3).alias("lab")
    corrupt = bad.select(F.lit("all").alias("modality"), "slot", "corruption", "severity", "vec_id", wrong, "z")
    return corrupt, clean


def match_clean_corrupt(spark, d):
    corrupt, clean = _matched(spark, d)
    from ..functions.vectors import l2_norm

    m = D.match_clean_corrupt(corrupt, clean, "modality", "slot")
    return m.select("vec_id", "slot", r6(l2_norm("delta"), "delta_norm"))


def match_check(spark, d):
    """Compared rows and label mismatches per group; the partial sets of the fixture would fail the guard (``match_guarded``)."""
    corrupt, clean = _matched(spark, d)
    out = D.match_counts(corrupt, clean, "modality", "slot", "lab", ["corruption", "severity"])
    return out.drop("unmatched_count", "missing_count")


def match_missing(spark, d):
    """Missing partners per group: the fixture's corrupt sets are partial, and every 13th slot is not clean."""
    corrupt, clean = _matched(spark, d)
    out = D.match_counts(corrupt, clean.where("slot % 13 <> 0"), "modality", "slot", "lab", ["corruption", "severity"])
    return out.select("modality", "corruption", "severity", "selected_count", "unmatched_count", "missing_count")


def match_guarded(spark, d):
    """The guarded match of complete corrupt sets: every clean slot in each corruption and severity."""
    corrupt, clean = _matched(spark, d)
    full = clean.drop("z").crossJoin(corrupt.select("corruption", "severity").distinct())
    return D.match_check(full, clean, "modality", "slot", "lab", ["corruption", "severity"], strict=True)


def attach_family(spark, d):
    """Unmapped corruptions become their own family."""
    tax = D.taxonomy_frame(spark, MAPPED)
    e = embeddings(spark, d).select("vec_id", F.col("corruption").cast("string").alias("corruption"))
    return D.attach_family(e, tax, unknown="as_own_family").select("vec_id", "corruption", "family")


def attach_family_skip(spark, d):
    tax = D.taxonomy_frame(spark, MAPPED)
    e = embeddings(spark, d).select("vec_id", F.col("corruption").cast("string").alias("corruption"))
    return D.attach_family(e, tax, unknown="skip").select("vec_id", "corruption", "family")


def severity_split(spark, d):
    return D.severity_split(embeddings(spark, d), [1, 3]).select("vec_id", "severity")


def severity_except(spark, d):
    """Severities seen anywhere minus the discovery severities."""
    e = embeddings(spark, d)
    seen = e.agg(F.array_sort(F.collect_set("severity")).alias("s"))
    return seen.select(F.explode(F.array_except("s", F.array(F.lit(1), F.lit(3)).cast("array<bigint>"))).alias("severity"))


def sample_n(spark, d):
    return D.sample_n(embeddings(spark, d), ["family"], "vec_id", 10, 42).select("family", "vec_id")


def sample_large(spark, d):
    """Group samples larger than the rank-limit fast path."""
    from .fixtures import table

    ev = table(spark, d, "events").withColumn("half", F.col("user_id") % 2)
    return D.sample_n(ev.select("half", "event_id"), ["half"], "event_id", 1500, 42)


def union_variants(spark, d):
    """Raw and normalised deltas as one table with a variant column."""
    from ..functions.vectors import l2_norm, l2_normalize

    dl = deltas(spark, d)
    raw = dl.select("vec_id", F.lit("raw").alias("variant"), l2_norm("delta").alias("norm"))
    unit = dl.select("vec_id", F.lit("l2_normalized").alias("variant"), l2_norm(l2_normalize("delta")).alias("norm"))
    return raw.unionByName(unit).select("vec_id", "variant", r6("norm"))


def requested_available(spark, d):
    e = embeddings(spark, d)
    return D.requested_available(e, ["19", "4", "77", "2", "11"], "scope").select("scope", "corruption", "position")


def build_summary(spark, d):
    """Scope-corruption-severity groups with at least 3 rows count as processed."""
    g = embeddings(spark, d).groupBy("scope", "corruption", "severity").agg(F.count(F.lit(1)).alias("n"))
    return D.build_summary(g, "scope", F.col("n") >= 3)


def ari_nmi(spark, d):
    e = embeddings(spark, d).withColumn("guess", F.col("vec_id") % 10)
    return cl.agreement(e, "family", "guess").select(r6("ari"), r6("nmi"))


def ari_nmi_by_scope(spark, d):
    e = embeddings(spark, d).withColumn("guess", F.col("vec_id") % 7)
    return cl.agreement(e, "family", "guess", ["scope"]).select("scope", r6("ari"), r6("nmi"))


def _points(spark, d):
    return materialize(deltas(spark, d).select("vec_id", F.col("corruption").cast("string").alias("corruption"), "severity", F.col("delta").alias("z")))


def taxonomy_discover(spark, d):
    """Cluster corruption prototypes by average linkage and relabel every point."""
    pts = _points(spark, d)
    mapping, _, _ = cl.discover_taxonomy(pts, [1, 2, 3], "agglomerative_cosine", k_min=2, k_max=6)
    return cl.relabel(pts, mapping).select("vec_id", "corruption", "family")


def kmeans_taxonomy(spark, d):
    pts = _points(spark, d)
    mapping, _, _ = cl.discover_taxonomy(pts, [1, 2, 3], "kmeans", k=4)
    return cl.relabel(pts, mapping).select("vec_id", "corruption", "family")


def recoverability(spark, d):
    """Agreement of true families with k-means and average-linkage clusters of all points."""
    e = embeddings(spark, d).select(F.col("vec_id").alias("pid"), "family", "z")
    k = e.select("family").distinct().count()
    km = cl.cluster(e, "kmeans", k, "pid", "z")
    ag = cl.cluster(e, "agglomerative_cosine", k, "pid", "z")
    parts = [cl.agreement(e.select("pid", "family").join(c, "pid"), "family", "cluster").select(F.lit(n).alias("method"), r6("ari"), r6("nmi")) for n, c in (("kmeans", km), ("agglomerative_cosine", ag))]
    return parts[0].unionByName(parts[1])


QUERIES = {
    "clean_only": clean_only,
    "delta_points": delta_points,
    "delta_mean": _agg("mean"),
    "delta_median": _agg("median"),
    "delta_trimmed": _agg("trimmed_mean"),
    "delta_per_image": delta_per_image,
    "match_clean_corrupt": match_clean_corrupt,
    "match_check": match_check,
    "match_missing": match_missing,
    "match_guarded": match_guarded,
    "attach_family": attach_family,
    "attach_family_skip": attach_family_skip,
    "severity_split": severity_split,
    "severity_except": severity_except,
    "sample_n": sample_n,
    "sample_large": sample_large,
    "union_variants": union_variants,
    "requested_available": requested_available,
    "build_summary": build_summary,
    "ari_nmi": ari_nmi,
    "ari_nmi_by_scope": ari_nmi_by_scope,
    "taxonomy_discover": taxonomy_discover,
    "kmeans_taxonomy": kmeans_taxonomy,
    "recoverability": recoverability,
}


def _sample_sql(table, keys, row, n, seed):
    return f"""SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY md5('{seed}|' || {row}::VARCHAR), {row}) AS rn FROM {table}"""


def _agree(guess: str, scope: str = "") -> str:
    g = f"{scope}," if scope else ""
    j = (lambda *c: " AND ".join(["true", *([f"x.{scope} = y.{scope}"] if scope else []), *[f"x.{k} = y.{k}" for k in c]]))
    return f"""WITH {EMB}, s AS (SELECT {g} family, {guess} AS guess FROM emb),
c AS (SELECT {g} family, guess, count(*)::DOUBLE AS c FROM s GROUP BY ALL),
a AS (SELECT {g} family, sum(c) AS a FROM c GROUP BY ALL), b AS (SELECT {g} guess, sum(c) AS b FROM c GROUP BY ALL),
f AS (SELECT x.*, y.a FROM c x JOIN a y ON {j('family')}), h AS (SELECT x.*, y.b FROM f x JOIN b y ON {j('guess')}),
t AS (SELECT {g} sum(c) AS n, sum(c * (c - 1) / 2) AS sc FROM h GROUP BY ALL),
ha AS (SELECT {g} sum(a * (a - 1) / 2) AS sa, sum(a * ln(a)) AS la FROM a {'GROUP BY ' + scope if scope else ''}),
hb AS (SELECT {g} sum(b * (b - 1) / 2) AS sb, sum(b * ln(b)) AS lb FROM b {'GROUP BY ' + scope if scope else ''}),
m AS (SELECT {g} sum(c * ln(c / (a * b))) AS mi FROM h {'GROUP BY ' + scope if scope else ''}),
z AS (SELECT {'x.' + scope + ',' if scope else ''} n, sc, sa, sb, la, lb, mi FROM t x {'JOIN ha USING (' + scope + ') JOIN hb USING (' + scope + ') JOIN m USING (' + scope + ')' if scope else 'JOIN ha ON true JOIN hb ON true JOIN m ON true'})
SELECT {g} round((sc - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) AS ari,
       round((mi / n + ln(n)) / ((ln(n) - la / n + ln(n) - lb / n) / 2), 6) AS nmi FROM z"""


_MATCH = DELTA + """,
mc AS (SELECT vec_id, corruption, severity, k, k % (SELECT count(*) FROM good) AS slot FROM bad)"""
_FAMILY = "CASE WHEN corruption < 18 THEN 'fam' || (corruption // 4)::VARCHAR ELSE corruption::VARCHAR END"

ORACLE = {
    "clean_only": f"WITH {EMB} SELECT vec_id, scope, severity FROM emb WHERE family = 0",
    "delta_points": f"WITH {DELTA} SELECT vec_id, dim, round(v, 6) AS value FROM dl",
    "delta_mean": f"WITH {DELTA} SELECT corruption, dim, round(avg(v), 6) AS value FROM dl GROUP BY 1, 2",
    "delta_median": f"WITH {DELTA} SELECT corruption, dim, round(quantile_cont(v, 0.5), 6) AS value FROM dl GROUP BY 1, 2",
    "delta_trimmed": f"""WITH {DELTA},
r AS (SELECT *, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY corruption, dim) AS n FROM dl WINDOW w AS (PARTITION BY corruption, dim ORDER BY v))
SELECT corruption, dim, round(avg(v), 6) AS value FROM r WHERE r >= floor(n * 0.1) AND r < n - floor(n * 0.1) GROUP BY 1, 2""",
    "delta_per_image": f"""WITH {DELTA}, n AS (SELECT vec_id, sqrt(sum(v * v)) AS norm FROM dl GROUP BY vec_id),
s AS ({_sample_sql('bad', 'scope, corruption', 'vec_id', 3, 7)})
SELECT scope::VARCHAR || '|' || corruption::VARCHAR || '|s' || severity::VARCHAR || '|i' || vec_id::VARCHAR AS point_id, vec_id, round(norm, 6) AS norm
FROM s JOIN n USING (vec_id) WHERE rn <= 3""",
    "match_clean_corrupt": f"""WITH {_MATCH}, n AS (SELECT vec_id, sqrt(sum(v * v)) AS norm FROM dl GROUP BY vec_id)
SELECT vec_id, slot, round(norm, 6) AS delta_norm FROM mc JOIN n USING (vec_id)""",
    "match_check": f"""WITH {_MATCH}
SELECT 'all' AS modality, corruption, severity, count(*) AS selected_count, count(*) FILTER (k % 11 = 0) = 0 AS labels_match,
       count(*) FILTER (k % 11 = 0) AS mismatch_count FROM mc GROUP BY corruption, severity""",
    "match_missing": f"""WITH {_MATCH}, n AS (SELECT count(*) FILTER (s % 13 <> 0) AS n FROM (SELECT unnest(range(0, (SELECT count(*) FROM good))) AS s))
SELECT 'all' AS modality, corruption, severity, count(*) FILTER (slot % 13 <> 0) AS selected_count, count(*) FILTER (slot % 13 = 0) AS unmatched_count,
       (SELECT n FROM n) - count(DISTINCT slot) FILTER (slot % 13 <> 0) AS missing_count FROM mc GROUP BY corruption, severity""",
    "match_guarded": f"""WITH {_MATCH}
SELECT DISTINCT 'all' AS modality, corruption, severity, (SELECT count(*) FROM good) AS selected_count, true AS labels_match, 0 AS mismatch_count FROM mc""",
    "attach_family": f"WITH {EMB} SELECT vec_id, corruption::VARCHAR AS corruption, {_FAMILY} AS family FROM emb",
    "attach_family_skip": f"WITH {EMB} SELECT vec_id, corruption::VARCHAR AS corruption, {_FAMILY} AS family FROM emb WHERE corruption < 18",
    "severity_split": f"WITH {EMB} SELECT vec_id, severity FROM emb WHERE severity NOT IN (1, 3)",
    "severity_except": f"WITH {EMB} SELECT DISTINCT severity FROM emb EXCEPT SELECT unnest([1, 3])",
    "sample_n": f"WITH {EMB}, s AS ({_sample_sql('emb', 'family', 'vec_id', 10, 42)}) SELECT family, vec_id FROM s WHERE rn <= 10",
    "sample_large": f"""WITH ev AS (SELECT user_id % 2 AS half, event_id FROM events), s AS ({_sample_sql('ev', 'half', 'event_id', 1500, 42)})
SELECT half, event_id FROM s WHERE rn <= 1500""",
    "union_variants": f"""WITH {DELTA}, n AS (SELECT vec_id, sqrt(sum(v * v)) AS norm FROM dl GROUP BY vec_id)
SELECT vec_id, 'raw' AS variant, round(norm, 6) AS norm FROM n UNION ALL SELECT vec_id, 'l2_normalized', round(norm / greatest(norm, 1e-12), 6) FROM n""",
    "requested_available": f"""WITH {EMB}, want AS (SELECT unnest(['19', '4', '77', '2', '11']) AS c, unnest([1, 2, 3, 4, 5]) AS position)
SELECT DISTINCT scope, corruption, position FROM emb JOIN want ON want.c = corruption::VARCHAR""",
    "build_summary": f"""WITH {EMB}, g AS (SELECT scope, corruption, severity, count(*) AS n FROM emb GROUP BY ALL)
SELECT count(*) FILTER (n >= 3) AS groups_processed, count(*) FILTER (n < 3) AS groups_skipped, count(DISTINCT scope) FILTER (n >= 3) AS scopes_processed FROM g""",
    "ari_nmi": _agree("vec_id % 10"),
    "ari_nmi_by_scope": _agree("vec_id % 7", "scope"),
}
