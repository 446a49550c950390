"""Queries: vector functions, projection, scoring scalars, name parsing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..functions import vectors as V
from ..operators import episodes as ep
from ..operators import family as fam
from ..operators import fit
from ..operators.points import longest_stream, masked_mean_pool
from ..plans.ranks import rank_in_group
from .fixtures import EMB, LONG, STREAM, TOKENS, TRACE, embeddings, r6, streams, table, tokens, traces


def _long(df, v, *cols):
    return df.select(*cols, F.posexplode(v).alias("dim", "v")).select(*cols, "dim", r6("v", "value"))


def mean_vector(spark, d):
    return _long(fit.mean_vector(embeddings(spark, d), ["family"]), "mu", "family")


def l2_normalize(spark, d):
    e = embeddings(spark, d).withColumn("z", F.transform("z", lambda v, i: v * (i + 1)))
    return _long(e, V.l2_normalize("z"), "vec_id")


def align_dim(spark, d):
    """Even ids cut to 48 entries, odd ids padded from 8 entries to 12."""
    e = embeddings(spark, d)
    v = F.when(F.col("vec_id") % 2 == 0, V.align_dim("z", 48)).otherwise(V.align_dim(F.slice("z", 1, 8), 12))
    return _long(e, v, "vec_id")


def topk_dims(spark, d):
    return embeddings(spark, d).select("vec_id", F.posexplode(V.topk_dims("z", 5)).alias("rank", "dim"))


def jaccard_dims(spark, d):
    """Overlap of each vector's top 8 dimensions with those of its family mean."""
    e = embeddings(spark, d)
    mu = fit.mean_vector(e, ["family"])
    j = e.join(mu, "family")
    return j.select("vec_id", r6(V.jaccard(V.topk_dims("z", 8), V.topk_dims("mu", 8)), "overlap"))


def fuse_vectors(spark, d):
    """Concatenate two leading parts and align to 40 entries."""
    e = embeddings(spark, d)
    return _long(e, V.fuse(F.slice("z", 1, 16), F.slice("z", 17, 16), 40), "vec_id")


def fuse_whole(spark, d):
    """Concatenate both halves of every vector and align to 80 entries."""
    e = embeddings(spark, d)
    return _long(e, V.fuse(F.slice("z", 1, 32), F.slice("z", 33, 32), 80), "vec_id")


def cosine_l2_distance(spark, d):
    e = embeddings(spark, d)
    mu = fit.mean_vector(e, ["family"])
    j = e.join(mu, "family")
    return j.select("vec_id", r6(V.cosine_distance("z", "mu"), "cosine"), r6(V.l2_distance("z", "mu"), "l2"))


def _weights(out: int, dim: int) -> np.ndarray:
    i, j = np.meshgrid(np.arange(out), np.arange(dim), indexing="ij")
    return np.sin(i * 7.0 + j * 3.0)


def linear_project(spark, d):
    """Linear layer 64 -> 4 with weights sin(7 i + 3 j) and biases i / 10."""
    e = embeddings(spark, d)
    return _long(e.withColumn("y", fam.project("z", _weights(4, 64), np.arange(4) / 10.0)), "y", "vec_id")


def gelu_project(spark, d):
    """Two-layer head 64 -> 8 -> 3 with GELU."""
    e = embeddings(spark, d)
    y = fam.project("z", _weights(8, 64), np.zeros(8), _weights(3, 8), np.ones(3))
    return _long(e.withColumn("y", y), "y", "vec_id")


def embedding_stats(spark, d):
    s = ep.embedding_stats(embeddings(spark, d))
    return s.select("rows", *[r6(c) for c in ("mean", "std", "min", "max", "norm_mean", "norm_std")])


def trace_head(spark, d):
    """Norm, mean and deviation of the first ten frames of each scope."""
    e = embeddings(spark, d)
    from pyspark.sql import Window as W

    head = e.withColumn("r", F.row_number().over(W.partitionBy("scope").orderBy("vec_id"))).where("r <= 10")
    return head.select("scope", "vec_id", r6(V.l2_norm("z"), "norm"), r6(V.vec_mean("z"), "mean"), r6(V.vec_std_pop("z"), "std"))


def reliability_a(spark, d):
    """Each vector against its family mean as belief; log-variance -2 (clamped range)."""
    e = embeddings(spark, d)
    mu = fit.mean_vector(e, ["family"])
    r = sc.reliability_a("mu", "z", 1.0, 3.0, [-2.0 + 0.1 * (i % 3) for i in range(64)])
    return e.join(mu, "family").select("vec_id", r6(r, "r_a"))


def point_ids(spark, d):
    e = embeddings(spark, d)
    base = sc.point_id("scope", "corruption", "severity")
    return e.select("vec_id", base.alias("point_id"), sc.point_id("scope", "corruption", "severity", "vec_id").alias("sample_point_id"))


def severity_block(spark, d):
    """Rows of a stacked file of 100-row severity blocks."""
    e = embeddings(spark, d)
    return e.select("vec_id", sc.severity_block("vec_id", F.lit(100)).alias("b")).select("vec_id", "b.severity", "b.sample_index")


def _names(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("us"))
    kind = F.col("event_id") % 3
    name = (
        F.when(kind == 0, F.concat(F.lit("u"), F.col("user_id"), F.lit("__LIDAR_TOP__"), "us", F.lit(".bin")))
        .when(kind == 1, F.concat(F.lit("u"), F.col("user_id"), F.lit("__cam__"), "us", F.lit(".bin")))
        .otherwise(F.concat(F.lit("frame"), "us", F.lit(".bin")))
    )
    return ev.select("event_id", "user_id", "us", name.alias("name"))


def frame_name_parse(spark, d):
    n = _names(spark, d).withColumn("p", sc.parse_frame_name("name"))
    return n.select("event_id", "p.stream", "p.sort_key")


def _lidar(spark, d):
    ev = _names(spark, d)
    name = F.concat(F.lit("u"), F.col("user_id"), F.lit("__LIDAR_TOP__"), "us", F.lit(".bin"))
    return ev.select(name.alias("name")).withColumn("p", sc.parse_frame_name("name")).select("name", "p.stream", "p.sort_key")


def frame_order(spark, d):
    """Position of each frame in its stream by parsed time, then name."""
    f = _lidar(spark, d)
    ranked = rank_in_group(f, ["stream"], [F.col("sort_key"), F.col("name")], "position")
    return ranked.select("stream", "name", "position")


def longest_stream_query(spark, d):
    """First 40 frames of the stream with most frames."""
    return longest_stream(_lidar(spark, d), 40).select("stream", "name")


def alarm_flag(spark, d):
    """Alarm and ordinal of a mode cycling by step."""
    s = streams(spark, d)
    mode = F.element_at(F.array(*[F.lit(m) for m in sc.MODES]), F.pmod("t", F.lit(4)) + 1)
    s = s.withColumn("mode", mode).withColumn("suspicious", F.col("value") > 30)
    return s.select("stream_id", "t", sc.mode_id("mode").alias("mode_id"), sc.alarm("suspicious", "mode").alias("alarm"))


def score_bands(spark, d):
    t = traces(spark, d)
    b = sc.score_band("severity", "is_corrupt", "t", "corrupt_start")
    return t.select("episode_id", "t", b.alias("b")).select("episode_id", "t", r6("b.low", "low"), r6("b.high", "high"))


def length_bucket(spark, d):
    t = traces(spark, d).select("episode_id", "corruption_length").distinct()
    return t.select("episode_id", sc.length_bucket("corruption_length").alias("bucket"))


def masked_pool(spark, d):
    return masked_mean_pool(tokens(spark, d), "item_id").select("item_id", "dim", r6("value"))


def mean_pool(spark, d):
    return masked_mean_pool(tokens(spark, d), "item_id", mask=None).select("item_id", "dim", r6("value"))


QUERIES = {
    "mean_vector": mean_vector,
    "l2_normalize": l2_normalize,
    "align_dim": align_dim,
    "topk_dims": topk_dims,
    "jaccard_dims": jaccard_dims,
    "fuse_vectors": fuse_vectors,
    "fuse_whole": fuse_whole,
    "cosine_l2_distance": cosine_l2_distance,
    "linear_project": linear_project,
    "gelu_project": gelu_project,
    "embedding_stats": embedding_stats,
    "trace_head": trace_head,
    "reliability_a": reliability_a,
    "point_id": point_ids,
    "severity_block": severity_block,
    "frame_name_parse": frame_name_parse,
    "frame_order": frame_order,
    "longest_stream": longest_stream_query,
    "alarm_flag": alarm_flag,
    "score_bands": score_bands,
    "length_bucket": length_bucket,
    "masked_pool": masked_pool,
    "mean_pool": mean_pool,
}

_MU = LONG + """,
mu AS (SELECT family, dim, avg(v) AS mu FROM long GROUP BY family, dim)"""
_TOP = """
ra AS (SELECT vec_id, dim, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, dim) AS r FROM long),
rb AS (SELECT family, dim, row_number() OVER (PARTITION BY family ORDER BY abs(mu) DESC, dim) AS r FROM mu)"""

ORACLE = {
    "mean_vector": f"WITH {LONG} SELECT family, dim, round(avg(v), 6) AS value FROM long GROUP BY family, dim",
    "l2_normalize": f"""WITH {LONG}, w AS (SELECT vec_id, dim, v * (dim + 1) AS v FROM long)
SELECT vec_id, dim, round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 1e-12), 6) AS value FROM w""",
    "align_dim": f"""WITH {EMB}, s AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 48 ELSE 12 END AS k, CASE WHEN vec_id % 2 = 0 THEN 64 ELSE 8 END AS have, z FROM emb),
g AS (SELECT vec_id, have, z, unnest(range(0, k)) AS dim FROM s)
SELECT vec_id, dim, round(CASE WHEN dim < have THEN z[dim + 1] ELSE 0 END, 6) AS value FROM g""",
    "topk_dims": f"""WITH {LONG}, r AS (SELECT vec_id, dim, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, dim) - 1 AS rank FROM long)
SELECT vec_id, rank, dim FROM r WHERE rank < 5""",
    "jaccard_dims": f"""WITH {_MU}, {_TOP},
i AS (SELECT e.vec_id, count(*) AS c FROM emb e JOIN ra ON ra.vec_id = e.vec_id AND ra.r <= 8 JOIN rb ON rb.family = e.family AND rb.dim = ra.dim AND rb.r <= 8 GROUP BY e.vec_id)
SELECT vec_id, round(coalesce(c, 0)::DOUBLE / (16 - coalesce(c, 0)), 6) AS overlap FROM emb LEFT JOIN i USING (vec_id)""",
    "fuse_vectors": f"""WITH {EMB}, g AS (SELECT vec_id, z, unnest(range(0, 40)) AS dim FROM emb)
SELECT vec_id, dim, round(CASE WHEN dim < 32 THEN z[dim + 1] ELSE 0 END, 6) AS value FROM g""",
    "fuse_whole": f"""WITH {EMB}, g AS (SELECT vec_id, z, unnest(range(0, 80)) AS dim FROM emb)
SELECT vec_id, dim, round(CASE WHEN dim < 64 THEN z[dim + 1] ELSE 0 END, 6) AS value FROM g""",
    "cosine_l2_distance": f"""WITH {_MU}
SELECT vec_id, round(1 - sum(v * mu) / (sqrt(sum(v * v)) * sqrt(sum(mu * mu))), 6) AS cosine, round(sqrt(sum((v - mu) * (v - mu))), 6) AS l2
FROM long JOIN mu USING (family, dim) GROUP BY vec_id""",
    "linear_project": f"""WITH {LONG}, o AS (SELECT unnest(range(0, 4)) AS i)
SELECT vec_id, CAST(i AS INTEGER) AS dim, round(sum(v * sin(i * 7.0::DOUBLE + dim * 3.0::DOUBLE)) + i / 10.0::DOUBLE, 6) AS value
FROM long CROSS JOIN o GROUP BY vec_id, i""",
    # erf by its series, 60 terms
    "gelu_project": f"""WITH {LONG}, h AS (SELECT unnest(range(0, 8)) AS j),
a AS (SELECT vec_id, j, sum(v * sin(j * 7.0::DOUBLE + dim * 3.0::DOUBLE)) AS x FROM long CROSS JOIN h GROUP BY vec_id, j),
g AS (SELECT vec_id, j, x * 0.5 * (1 + 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda n: (1 - 2 * (n % 2)) * pow(x / sqrt(2.0::DOUBLE), 2 * n + 1) / (gamma(n + 1.0::DOUBLE) * (2 * n + 1))))) AS y FROM a),
o AS (SELECT unnest(range(0, 3)) AS i)
SELECT vec_id, CAST(i AS INTEGER) AS dim, round(sum(y * sin(i * 7.0::DOUBLE + j * 3.0::DOUBLE)) + 1, 6) AS value FROM g CROSS JOIN o GROUP BY vec_id, i""",
    "embedding_stats": f"""WITH {LONG}, n AS (SELECT vec_id, sqrt(sum(v * v)) AS norm FROM long GROUP BY vec_id)
SELECT (SELECT count(*) FROM emb) AS rows, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
       round((SELECT avg(norm) FROM n), 6) AS norm_mean, round((SELECT stddev_pop(norm) FROM n), 6) AS norm_std FROM long""",
    "trace_head": f"""WITH {LONG}, r AS (SELECT vec_id, row_number() OVER (PARTITION BY scope ORDER BY vec_id) AS r FROM emb)
SELECT scope, vec_id, round(sqrt(sum(v * v)), 6) AS norm, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std
FROM long JOIN r USING (vec_id) WHERE r <= 10 GROUP BY scope, vec_id""",
    "reliability_a": f"""WITH {_MU}
SELECT vec_id, round(1 / (1 + exp(0.5::DOUBLE * sum((v - mu) * (v - mu) * exp(2.0::DOUBLE - 0.1::DOUBLE * (dim % 3))) - 3.0)), 6) AS r_a
FROM long JOIN mu USING (family, dim) GROUP BY vec_id""",
    "point_id": f"""WITH {EMB}
SELECT vec_id, scope::VARCHAR || '|' || corruption::VARCHAR || '|s' || severity::VARCHAR AS point_id,
       scope::VARCHAR || '|' || corruption::VARCHAR || '|s' || severity::VARCHAR || '|i' || vec_id::VARCHAR AS sample_point_id FROM emb""",
    "severity_block": f"WITH {EMB} SELECT vec_id, CAST(vec_id // 100 + 1 AS INTEGER) AS severity, vec_id % 100 AS sample_index FROM emb",
    "frame_name_parse": """WITH n AS (SELECT event_id, user_id, epoch_us(ts)::VARCHAR AS us FROM events)
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'u' || user_id WHEN 1 THEN 'u' || user_id ELSE 'frame' || us END AS stream,
       lpad(ltrim(CASE WHEN event_id % 3 = 1 THEN user_id::VARCHAR || us ELSE us END, '0'), 20, '0') AS sort_key FROM n""",
    "frame_order": """WITH n AS (SELECT 'u' || user_id AS stream, 'u' || user_id || '__LIDAR_TOP__' || epoch_us(ts)::VARCHAR || '.bin' AS name, ts FROM events)
SELECT stream, name, row_number() OVER (PARTITION BY stream ORDER BY ts, name) - 1 AS position FROM n""",
    "longest_stream": """WITH n AS (SELECT 'u' || user_id AS stream, 'u' || user_id || '__LIDAR_TOP__' || epoch_us(ts)::VARCHAR || '.bin' AS name, ts FROM events),
top AS (SELECT stream FROM n GROUP BY stream ORDER BY count(*) DESC, stream LIMIT 1)
SELECT stream, name FROM n WHERE stream = (SELECT stream FROM top) ORDER BY ts, name LIMIT 40""",
    "alarm_flag": f"WITH {STREAM} SELECT stream_id, t, CAST(t % 4 AS INTEGER) AS mode_id, value > 30 OR t % 4 <> 0 AS alarm FROM st",
    "score_bands": f"""WITH {TRACE},
c AS (SELECT episode_id, t, is_corrupt, severity, t < corrupt_start AS warm,
  CASE WHEN severity <= 1 THEN 0.6 WHEN severity >= 5 THEN 0.05 WHEN severity <= 3 THEN (1 - (severity - 1) / 2.0) * 0.6 + (severity - 1) / 2.0 * 0.3 ELSE (1 - (severity - 3) / 2.0) * 0.3 + (severity - 3) / 2.0 * 0.05 END AS lo,
  CASE WHEN severity <= 1 THEN 0.75 WHEN severity >= 5 THEN 0.2 WHEN severity <= 3 THEN (1 - (severity - 1) / 2.0) * 0.75 + (severity - 1) / 2.0 * 0.5 ELSE (1 - (severity - 3) / 2.0) * 0.5 + (severity - 3) / 2.0 * 0.2 END AS hi
  FROM tr)
SELECT episode_id, t, round(CASE WHEN is_corrupt THEN lo WHEN warm THEN 0.99 ELSE 0.9 END::DOUBLE, 6) AS low,
       round(CASE WHEN is_corrupt THEN hi ELSE 1.0 END::DOUBLE, 6) AS high FROM c""",
    "length_bucket": f"WITH {TRACE} SELECT DISTINCT episode_id, CASE corruption_length WHEN 12 THEN 'shorter' WHEN 20 THEN 'medium' ELSE 'longer' END AS bucket FROM tr",
    "masked_pool": f"""WITH {TOKENS}, l AS (SELECT item_id, mask, unnest(range(0, 3)) AS dim, unnest(vec) AS v FROM tk)
SELECT item_id, dim, round(sum(v * mask::INT) / greatest(sum(mask::INT), 1e-6), 6) AS value FROM l GROUP BY item_id, dim""",
    "mean_pool": f"""WITH {TOKENS}, l AS (SELECT item_id, unnest(range(0, 3)) AS dim, unnest(vec) AS v FROM tk)
SELECT item_id, dim, round(avg(v), 6) AS value FROM l GROUP BY item_id, dim""",
}
