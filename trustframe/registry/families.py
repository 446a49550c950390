"""Queries: distribution fitting, family scoring, open-set calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import reliability_b
from ..functions.vectors import anchor_distance, mahalanobis_diag_sq
from ..operators import family as fam
from ..operators import fit
from ..operators.deltas import assert_min_count, min_support
from ..plans.ranks import rank_in_group
from ..session import materialize
from .fixtures import DELTA, EMB, LONG, STREAM, deltas, embeddings, r6, streams

# family_cov_full alone; family_cov_whole takes all dimensions.
FULL_DIMS = 16

MODEL = """model AS (
  SELECT family, dim, count(*) AS n, avg(v) AS mu, CASE WHEN count(*) >= 2 THEN var_samp(v) ELSE 1.0 END + 1e-4 AS var
  FROM long GROUP BY family, dim)"""
NEAREST = LONG + ",\n" + MODEL + """,
dist AS (
  SELECT l.vec_id, m.family AS pred, sum((l.v - m.mu) * (l.v - m.mu) / m.var) AS d
  FROM long l JOIN model m USING (dim) GROUP BY l.vec_id, m.family),
best AS (
  SELECT vec_id, pred, d AS min_d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, pred) AS rn FROM dist) WHERE rn = 1)"""


def _model(spark, d):
    e = embeddings(spark, d)
    return e, materialize(fit.fit_family_model(e))


def family_nearest(spark, d):
    """Fit per-family Gaussians, find each vector's nearest family, calibrate and flag unseen."""
    e, model = _model(spark, d)
    scored = materialize(fam.nearest_family(e.select("vec_id", "family", "z"), model).drop("z"))
    limit = fam.calibrate_unseen(scored, 99.0)
    flagged = scored.withColumn("is_unseen", F.col("min_d") > limit.scalar())
    return flagged.select("vec_id", "family", F.col("pred").alias("pred_family"), r6("min_d"), "is_unseen")


def family_counts(spark, d):
    """Confusion counts of true and nearest family with the unseen share."""
    out = family_nearest(spark, d)
    return out.groupBy("family", "pred_family").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_unseen").alias("unseen"))


def family_fit_diag(spark, d):
    _, model = _model(spark, d)
    z = F.posexplode(F.arrays_zip("mu", "var")).alias("dim", "s")
    return model.select("family", "n", z).select("family", "n", "dim", r6(F.col("s.mu"), "mu"), r6(F.col("s.var"), "var"))


def family_fit_full(spark, d):
    """Full covariance and precision per family."""
    m = fit.fit_family_model(embeddings(spark, d), diag=False)
    return m.select("family", "n", F.posexplode("cov").alias("i", "row"), "precision").select(
        "family", "n", "i", r6(F.element_at("row", F.col("i") + 1), "var"), r6(F.element_at(F.element_at("precision", F.col("i") + 1), F.col("i") + 1), "prec")
    )


def _cov_entries(e):
    m = fit.fit_family_model(e, diag=False)
    return m.select("family", F.posexplode("cov").alias("i", "row")).select("family", "i", F.posexplode("row").alias("j", "c")).select("family", "i", "j", r6("c", "cov"))


def family_cov_full(spark, d):
    """Entries of the full family covariances on the leading dimensions."""
    return _cov_entries(embeddings(spark, d).withColumn("z", F.slice("z", 1, FULL_DIMS)))


def family_cov_whole(spark, d):
    """Entries of the full family covariances on all dimensions."""
    return _cov_entries(embeddings(spark, d))


def unseen_threshold(spark, d):
    e, model = _model(spark, d)
    scored = materialize(fam.nearest_family(e.select("vec_id", "z"), model).select("vec_id", "min_d"))
    return fam.calibrate_unseen(scored, 99.0).select(r6("unseen_threshold"))


def enroll_family(spark, d):
    """Replace family 9 by a fit over families 8 and 9, append family 10 from family 0 rows."""
    e, model = _model(spark, d)
    m = materialize(fit.enroll_family(model, 9, e.where("family >= 8")))
    m = fit.enroll_family(m, 10, e.where("family = 0"))
    z = F.posexplode(F.arrays_zip("mu", "var")).alias("dim", "s")
    return m.select("family", "n", z).select("family", "n", "dim", r6(F.col("s.mu"), "mu"), r6(F.col("s.var"), "var"))


def few_shot_registry(spark, d):
    """Prototypes of cyclic deltas; corruption-severity classes with fewer than 10 shots have no variance."""
    dl = deltas(spark, d).withColumn("cls", F.concat_ws("-", "corruption", "severity"))
    reg = fit.few_shot_registry(dl, "cls", "delta")
    both = F.arrays_zip("prototype", F.coalesce("diag_var", F.array_repeat(F.lit(None).cast("double"), 64)).alias("v"))
    return reg.select("family", "num_shots", F.posexplode(both).alias("dim", "s")).select(
        "family", "num_shots", "dim", r6(F.col("s.prototype"), "prototype"), r6(F.col("s.v"), "diag_var")
    )


def _classify(spark, d, metric, threshold):
    e = embeddings(spark, d)
    reg = materialize(fit.few_shot_registry(e))
    out = fam.classify_few_shot(e.select("vec_id", "z"), reg, metric, threshold)
    return out.select("vec_id", F.col("pred").alias("family"), r6("min_d", "distance"), "is_unseen")


def few_shot_cosine(spark, d):
    return _classify(spark, d, "cosine", 0.5)


def few_shot_euclidean(spark, d):
    return _classify(spark, d, "euclidean", 0.9)


def model_sorted(spark, d):
    _, model = _model(spark, d)
    return model.orderBy("family").select("family", "n", "diag", r6("eps"), F.col("threshold_source"))


def clean_cov_shrunk(spark, d):
    """Shrunk, regularised covariance of the clean family."""
    stats = fit.fit_clean_reference(embeddings(spark, d).where("family = 0"), shrinkage=0.01, eps=1e-5)
    return stats.select("n", F.posexplode("cov").alias("i", "row")).select("n", "i", F.posexplode("row").alias("j", "c")).select("n", "i", "j", r6("c", "cov"))


def _clean_diag(spark, d):
    e = embeddings(spark, d)
    return e, materialize(fit.mean_var(e.where("family = 0").withColumn("one", F.lit(1)), ["one"]).select("n", "mu", F.transform("var", lambda v: v + 1e-5).alias("var")))


def _scored_diag(spark, d):
    e, stats = _clean_diag(spark, d)
    row = e.withColumn("mu", stats.select("mu").scalar()).withColumn("var", stats.select("var").scalar())
    return row.withColumn("md", mahalanobis_diag_sq("z", "mu", "var"))


def mahalanobis_diag(spark, d):
    return _scored_diag(spark, d).select("vec_id", r6("md"))


def reliability_b_query(spark, d):
    return _scored_diag(spark, d).select("vec_id", r6(reliability_b("md", 25.0, 3.0), "r_b"))


def anchor_distance_query(spark, d):
    """Distance to the clean mean; the bad anchor exists for families 5 and up only."""
    e = embeddings(spark, d)
    mu = fit.mean_vector(e.where("family = 0").withColumn("one", F.lit(1)), ["one"]).select("mu")
    bad = fit.mean_vector(e.where("family = 9").withColumn("one", F.lit(1)), ["one"]).select("mu")
    row = e.withColumn("mu", mu.scalar()).withColumn("bad", F.when(F.col("family") >= 5, bad.scalar()))
    return row.select("vec_id", r6(anchor_distance("z", "mu"), "d_clean"), r6(anchor_distance("z", "bad"), "d_bad"))


def mahalanobis_full(spark, d):
    """Full-precision distance against the clean family."""
    e = embeddings(spark, d)
    stats = materialize(fit.fit_clean_reference(e.where("family = 0")))
    return e.select("vec_id", r6(fam.mahalanobis_full("z", stats), "md"))


def score_with_model(spark, d):
    """Every row against the one-row reference: distance, reliability, anchor distance."""
    s = _scored_diag(spark, d)
    return s.select("vec_id", "family", r6("md"), r6(reliability_b("md", 25.0, 3.0), "r_b"), r6(anchor_distance("z", "mu"), "d_clean"))


def finite_only(spark, d):
    """Drop infinite and missing distances before calibration."""
    e = embeddings(spark, d)
    x = F.element_at("z", 1)
    bent = e.withColumn("dist", F.when(F.col("vec_id") % 7 == 0, F.lit(float("inf"))).when(F.col("vec_id") % 7 == 1, F.lit(float("nan"))).when(F.col("vec_id") % 7 == 2, F.lit(None)).otherwise(x))
    return fam.finite_only(bent, "dist").select("vec_id", r6("dist"))


def min_support_query(spark, d):
    """Rows of corruption-severity classes with at least 6 members."""
    e = embeddings(spark, d)
    return min_support(e.select("corruption", "severity", "vec_id"), ["corruption", "severity"], 6)


def guards(spark, d):
    return assert_min_count(embeddings(spark, d), ["scope"], 3, "scope")


def clean_prefix_fit(spark, d):
    """Per-stream reference over the first 20 steps."""
    stats = fit.clean_prefix_fit(streams(spark, d), "t", 20, keys=["stream_id"])
    return stats.select("stream_id", "n", r6(F.element_at("mu", 1), "mu"), r6(F.element_at(F.element_at("cov", 1), 1), "cov"), r6(F.element_at(F.element_at("precision", 1), 1), "precision"))


def zero_shot_label(spark, d):
    """Family means as label vectors; softmax over cosine similarities."""
    e = embeddings(spark, d)
    labels = materialize(fit.mean_vector(e, ["family"], name="vec"))
    out = fam.zero_shot(e.select("vec_id", "z"), labels, "family", "vec")
    return out.select("vec_id", F.col("pred").alias("label"), r6("prob"))


def zero_shot_probs(spark, d):
    e = embeddings(spark, d)
    labels = materialize(fit.mean_vector(e, ["family"], name="vec"))
    out = fam.zero_shot(e.select("vec_id", "z"), labels, "family", "vec")
    return out.select("vec_id", F.posexplode("probs").alias("label", "p")).select("vec_id", "label", r6("p", "prob"))


QUERIES = {
    "family_nearest": family_nearest,
    "family_counts": family_counts,
    "family_fit_diag": family_fit_diag,
    "family_fit_full": family_fit_full,
    "family_cov_full": family_cov_full,
    "family_cov_whole": family_cov_whole,
    "unseen_threshold": unseen_threshold,
    "enroll_family": enroll_family,
    "few_shot_registry": few_shot_registry,
    "few_shot_cosine": few_shot_cosine,
    "few_shot_euclidean": few_shot_euclidean,
    "model_sorted": model_sorted,
    "clean_cov_shrunk": clean_cov_shrunk,
    "mahalanobis_diag": mahalanobis_diag,
    "mahalanobis_full": mahalanobis_full,
    "reliability_b": reliability_b_query,
    "anchor_distance": anchor_distance_query,
    "score_with_model": score_with_model,
    "finite_only": finite_only,
    "min_support": min_support_query,
    "guards": guards,
    "clean_prefix_fit": clean_prefix_fit,
    "zero_shot_label": zero_shot_label,
    "zero_shot_probs": zero_shot_probs,
}

_CLEAN = LONG + """,
ref AS (SELECT dim, avg(v) AS mu, var_samp(v) + 1e-5 AS var FROM long WHERE family = 0 GROUP BY dim),
md AS (SELECT vec_id, family, sum((v - mu) * (v - mu) / var) AS md, sqrt(sum((v - mu) * (v - mu))) AS d_clean
       FROM long JOIN ref USING (dim) GROUP BY vec_id, family)"""
_PROTO = LONG + """,
proto AS (SELECT family, list(mu ORDER BY dim) AS p FROM (SELECT family, dim, avg(v) AS mu FROM long GROUP BY family, dim) GROUP BY family)"""


def _classify_sql(dist: str, threshold: float) -> str:
    return f"""WITH {_PROTO},
d AS (SELECT vec_id, CAST(p.family AS VARCHAR) AS family, {dist} AS d FROM emb CROSS JOIN proto p),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, family) AS rn FROM d)
SELECT vec_id, family, round(d, 6) AS distance, d > {threshold} AS is_unseen FROM b WHERE rn = 1"""


_SOFT = _PROTO + """,
s AS (SELECT vec_id, p.family AS label, exp(list_cosine_similarity(z, p.p)) AS e FROM emb CROSS JOIN proto p),
q AS (SELECT vec_id, label, e / sum(e) OVER (PARTITION BY vec_id) AS prob FROM s)"""

ORACLE = {
    "family_nearest": f"""WITH {NEAREST},
lim AS (SELECT quantile_cont(min_d, 0.99) AS th FROM best)
SELECT vec_id, family, pred AS pred_family, round(min_d, 6) AS min_d, min_d > (SELECT th FROM lim) AS is_unseen
FROM best JOIN emb USING (vec_id)""",
    "family_counts": f"""WITH {NEAREST},
lim AS (SELECT quantile_cont(min_d, 0.99) AS th FROM best)
SELECT family, pred AS pred_family, count(*) AS n, count(*) FILTER (min_d > (SELECT th FROM lim)) AS unseen
FROM best JOIN emb USING (vec_id) GROUP BY 1, 2""",
    "family_fit_diag": f"""WITH {LONG}, {MODEL}
SELECT family, n, dim, round(mu, 6) AS mu, round(var, 6) AS var FROM model""",
    "family_cov_whole": f"""WITH {LONG}
SELECT a.family AS family, a.dim AS i, b.dim AS j, round(covar_samp(a.v, b.v) + CASE WHEN a.dim = b.dim THEN 1e-4 ELSE 0 END, 6) AS cov
FROM long a JOIN long b ON a.vec_id = b.vec_id GROUP BY 1, 2, 3""",
    "family_cov_full": f"""WITH {LONG}
SELECT a.family AS family, a.dim AS i, b.dim AS j, round(covar_samp(a.v, b.v) + CASE WHEN a.dim = b.dim THEN 1e-4 ELSE 0 END, 6) AS cov
FROM long a JOIN long b ON a.vec_id = b.vec_id WHERE a.dim < {FULL_DIMS} AND b.dim < {FULL_DIMS} GROUP BY 1, 2, 3""",
    "unseen_threshold": f"WITH {NEAREST} SELECT round(quantile_cont(min_d, 0.99), 6) AS unseen_threshold FROM best",
    "enroll_family": f"""WITH {LONG},
src AS (SELECT family, dim, v FROM long WHERE family < 9
        UNION ALL SELECT 9, dim, v FROM long WHERE family >= 8
        UNION ALL SELECT 10, dim, v FROM long WHERE family = 0)
SELECT family, count(*) AS n, dim, round(avg(v), 6) AS mu, round(var_samp(v) + 1e-4, 6) AS var FROM src GROUP BY family, dim""",
    "few_shot_registry": f"""WITH {DELTA},
c AS (SELECT corruption::VARCHAR || '-' || severity::VARCHAR AS family, dim, v FROM dl)
SELECT family, CAST(count(*) AS INTEGER) AS num_shots, dim, round(avg(v), 6) AS prototype,
       round(CASE WHEN count(*) >= 10 THEN var_samp(v) END, 6) AS diag_var
FROM c GROUP BY family, dim""",
    "few_shot_cosine": _classify_sql("list_cosine_distance(z, p.p)", 0.5),
    "few_shot_euclidean": _classify_sql("list_distance(z, p.p)", 0.9),
    "model_sorted": f"""WITH {EMB}
SELECT family, count(*) AS n, true AS diag, 0.0001::DOUBLE AS eps, 'unset' AS threshold_source FROM emb GROUP BY family ORDER BY family""",
    "clean_cov_shrunk": f"""WITH {LONG}, c AS (SELECT * FROM long WHERE family = 0),
m AS (SELECT a.dim AS i, b.dim AS j, count(*) AS n, covar_samp(a.v, b.v) AS s FROM c a JOIN c b ON a.vec_id = b.vec_id GROUP BY 1, 2)
SELECT n, i, j, round(CASE WHEN i = j THEN 0.99::DOUBLE * s + 0.01::DOUBLE * s + 1e-5 ELSE 0.99::DOUBLE * s END, 6) AS cov FROM m""",
    "mahalanobis_diag": f"WITH {_CLEAN} SELECT vec_id, round(md, 6) AS md FROM md",
    "reliability_b": f"WITH {_CLEAN} SELECT vec_id, round(1 / (1 + exp(md / 25.0::DOUBLE - 3.0)), 6) AS r_b FROM md",
    "anchor_distance": f"""WITH {LONG},
ref AS (SELECT dim, avg(v) FILTER (family = 0) AS mu, avg(v) FILTER (family = 9) AS bad FROM long GROUP BY dim)
SELECT vec_id, round(sqrt(sum((v - mu) * (v - mu))), 6) AS d_clean,
       round(CASE WHEN any_value(family) >= 5 THEN sqrt(sum((v - bad) * (v - bad))) END, 6) AS d_bad
FROM long JOIN ref USING (dim) GROUP BY vec_id""",
    "score_with_model": f"""WITH {_CLEAN}
SELECT vec_id, family, round(md, 6) AS md, round(1 / (1 + exp(md / 25.0::DOUBLE - 3.0)), 6) AS r_b, round(d_clean, 6) AS d_clean FROM md""",
    "finite_only": f"WITH {EMB} SELECT vec_id, round(z[1], 6) AS dist FROM emb WHERE vec_id % 7 NOT IN (0, 1, 2)",
    "min_support": f"""WITH {EMB}
SELECT corruption, severity, vec_id FROM (SELECT *, count(*) OVER (PARTITION BY corruption, severity) AS c FROM emb) WHERE c >= 6""",
    "guards": f"WITH {EMB} SELECT scope, count(*) AS n FROM emb GROUP BY scope",
    "clean_prefix_fit": f"""WITH {STREAM}
SELECT stream_id, count(*) AS n, round(avg(s), 6) AS mu, round(var_samp(s) + 1e-5, 6) AS cov, round(1 / (var_samp(s) + 1e-5), 6) AS precision
FROM st WHERE t < 20 GROUP BY stream_id""",
    "zero_shot_label": f"""WITH {_SOFT}
SELECT vec_id, label, round(prob, 6) AS prob FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, label) AS rn FROM q) WHERE rn = 1""",
    "zero_shot_probs": f"WITH {_SOFT} SELECT vec_id, label, round(prob, 6) AS prob FROM q",
}
