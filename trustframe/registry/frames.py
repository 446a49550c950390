"""Queries: frame windows, step selection, pixels and corruption injection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixels as px
from ..operators import frames as Fr
from ..sources.files import read_split_images
from .fixtures import EMB, IMAGES, STREAM, embeddings, image_archives, images, r6, streams

SEVERITY = 0.6
NOISE_SEED = 3


def sequence_window(spark, d):
    """The last four signals at every step, left-padded."""
    s = streams(spark, d).select("stream_id", "t", "s")
    w = Fr.sequence_window(s, ["stream_id"], "t", "s", 4)
    return w.select("stream_id", "t", F.posexplode("window").alias("pos", "v")).select("stream_id", "t", "pos", r6("v"))


def select_steps(spark, d):
    """Twelve evenly spaced steps from step 5 on."""
    return Fr.select_steps(streams(spark, d), ["stream_id"], "t", 12, 5).select("stream_id", "t")


def _pixels(df, col="pixels"):
    return df.select("vec_id", F.posexplode(col).alias("i", "p")).select("vec_id", "i", r6("p"))


def pixel_scale(spark, d):
    """Byte pixels scaled to [0, 1]."""
    im = images(spark, d).withColumn("bytes", F.transform("pixels", lambda v: F.floor(v * 255)))
    return _pixels(im.withColumn("pixels", px.scale_pixels("bytes")))


def channel_normalize(spark, d):
    """Two interleaved channels with their own mean and deviation."""
    return _pixels(images(spark, d).withColumn("pixels", px.channel_normalize("pixels", [0.45, 0.5], [0.2, 0.25])))


def ensure_rgb(spark, d):
    """Grey bytes repeated to three channels; out-of-range values clip."""
    im = images(spark, d).withColumn("pixels", F.transform("pixels", lambda v: v * 400 - 60))
    out = im.select("vec_id", F.posexplode(px.ensure_rgb("pixels", "channels")).alias("i", "p"))
    return out.select("vec_id", "i", "p")


def _corrupt(kind):
    def query(spark, d):
        im = images(spark, d)
        bad = px.apply_corruption(kind, "pixels", F.lit(SEVERITY), F.col("h"), F.col("w"), F.col("channels"), NOISE_SEED, [F.col("vec_id")])
        return _pixels(im.withColumn("pixels", bad))

    query.__doc__ = f"Every frame under {kind} at severity {SEVERITY}."
    return query


def corrupt_range(spark, d):
    """Brightness drop on steps 10..30 of every episode, byte pixels."""
    im = images(spark, d).withColumn("pixels", F.transform("pixels", lambda v: F.floor(v * 255)))
    out = Fr.corrupt_range(im, "brightness_drop", SEVERITY, 10, 30)
    return out.select("episode_id", "timestep", "corruption", r6("severity"), "is_corrupt", F.posexplode("pixels").alias("i", "p")).select(
        "episode_id", "timestep", "corruption", "severity", "is_corrupt", "i", r6("p")
    )


def supcon_by_batch(spark, d):
    return Fr.supcon_by_batch(embeddings(spark, d), "vec_id", "family", 32, temperature=0.5).select("batch", "anchors", r6("loss"))


def channel_mean_embed(spark, d):
    """Channel means projected with fixed weights and normalised."""
    from ..operators.family import project
    from ..functions.vectors import l2_normalize
    import numpy as np

    weights = np.sin(np.arange(8)[:, None] * 5.0 + np.arange(2)[None, :] * 2.0)
    im = images(spark, d).withColumn("m", px.channel_means("pixels", 2)).withColumn("y", project("m", weights, np.zeros(8)))
    return im.select("vec_id", F.posexplode(l2_normalize("y")).alias("dim", "v")).select("vec_id", "dim", r6("v", "value"))


def archive_selected(spark, d):
    """Images of two scopes, three corruptions and two severities, from the archives that hold them."""
    wanted = {"modality": ["m1", "m3"], "corruption": ["c2", "c3", "c5"], "severity": [2, 4]}
    im = read_split_images(spark, image_archives(spark, d), wanted)
    lit = F.aggregate("pixels", F.lit(0).cast("long"), lambda a, p: a + p)
    return im.groupBy("modality", "corruption", "severity").agg(
        F.count(F.lit(1)).alias("images"), F.sum(F.element_at("label", 1)).alias("label_sum"), F.sum(lit).alias("pixel_sum"), F.max("h").alias("h"), F.max("channels").alias("channels")
    )


QUERIES = {
    "archive_selected": archive_selected,
    "sequence_window": sequence_window,
    "select_steps": select_steps,
    "pixel_scale": pixel_scale,
    "channel_normalize": channel_normalize,
    "ensure_rgb": ensure_rgb,
    "brightness_drop": _corrupt("brightness_drop"),
    "center_occlusion": _corrupt("center_occlusion"),
    "noise": _corrupt("gaussian_noise"),
    "noise_and_occlusion": _corrupt("noise_and_occlusion"),
    "corrupt_range": corrupt_range,
    "supcon_by_batch": supcon_by_batch,
    "channel_mean_embed": channel_mean_embed,
}

_UNIFORM = "(CAST('0x' || substr(md5('{seed}|' || vec_id || '|' || i), {at}, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
_U1, _U2 = (_UNIFORM.format(seed=NOISE_SEED, at=a) for a in (1, 9))
_NOISY = f"least(greatest(p + {0.03 + 0.17 * SEVERITY}::DOUBLE * sqrt(-2.0::DOUBLE * ln({_U1})) * cos(2.0::DOUBLE * pi() * {_U2}), 0), 1)"


def _patch(severity: float) -> str:
    side = max(1, int(8 * min(0.8, 0.18 + 0.42 * severity)))
    top = (8 - side) // 2
    return f"(i // 8 >= {top} AND i // 8 < {top + side} AND i % 8 >= {top} AND i % 8 < {top + side})"


ORACLE = {
    "archive_selected": f"""WITH {EMB}, p AS (SELECT *, list_sum(list_transform(z, lambda v: floor(abs(v) * 100)::BIGINT % 256))::BIGINT AS s FROM emb)
SELECT 'm' || scope AS modality, 'c' || corruption AS corruption, severity::INTEGER AS severity, count(*) AS images, sum(vec_id)::BIGINT AS label_sum, sum(s)::BIGINT AS pixel_sum, 8 AS h, 1 AS channels
FROM p WHERE scope IN (1, 3) AND corruption IN (2, 3, 5) AND severity IN (2, 4) GROUP BY ALL""",
    "sequence_window": f"""WITH {STREAM}, p AS (SELECT stream_id, t, unnest(range(0, 4)) AS pos FROM st)
SELECT p.stream_id, p.t, CAST(pos AS INTEGER) AS pos, round(s, 6) AS v FROM p JOIN st ON st.stream_id = p.stream_id AND st.t = greatest(p.t - 3 + pos, greatest(p.t - 3, 0))""",
    "select_steps": f"""WITH {STREAM}, n AS (SELECT stream_id, count(*) AS n FROM st GROUP BY 1), i AS (SELECT stream_id, n, unnest(range(0, 12)) AS i FROM n)
SELECT DISTINCT stream_id, CAST(CASE WHEN n - 5 <= 12 THEN n - 1 ELSE 5 + round_even(i * (n - 6)::DOUBLE / 11, 0) END AS INTEGER) AS t FROM i""",
    "pixel_scale": f"WITH {IMAGES} SELECT vec_id, i, round(floor(p * 255) / 255.0::DOUBLE, 6) AS p FROM px",
    "channel_normalize": f"""WITH {IMAGES} SELECT vec_id, i, round((least(greatest(p, 0), 1) - CASE i % 2 WHEN 0 THEN 0.45::DOUBLE ELSE 0.5::DOUBLE END) / CASE i % 2 WHEN 0 THEN 0.2::DOUBLE ELSE 0.25::DOUBLE END, 6) AS p FROM px""",
    "ensure_rgb": f"""WITH {IMAGES}, c AS (SELECT unnest([0, 1, 2]) AS c)
SELECT vec_id, i * 3 + c AS i, CAST(floor(least(greatest(p * 400 - 60, 0), 255)) AS INTEGER) AS p FROM px JOIN c ON true""",
    "brightness_drop": f"WITH {IMAGES} SELECT vec_id, i, round(least(greatest(p * {max(0.15, 1 - 0.75 * SEVERITY)}::DOUBLE, 0), 1), 6) AS p FROM px",
    "center_occlusion": f"WITH {IMAGES} SELECT vec_id, i, round(CASE WHEN {_patch(SEVERITY)} THEN 0 ELSE p END, 6) AS p FROM px",
    "noise": f"WITH {IMAGES} SELECT vec_id, i, round({_NOISY}, 6) AS p FROM px",
    "noise_and_occlusion": f"WITH {IMAGES} SELECT vec_id, i, round(CASE WHEN {_patch(SEVERITY + 0.1)} THEN 0 ELSE {_NOISY} END, 6) AS p FROM px",
    "corrupt_range": f"""WITH {IMAGES}, b AS (SELECT *, timestep BETWEEN 10 AND 30 AS bad, floor(p * 255) AS v FROM px)
SELECT episode_id, timestep, CASE WHEN bad THEN 'brightness_drop' ELSE 'none' END AS corruption, CASE WHEN bad THEN {SEVERITY} ELSE 0.0 END::DOUBLE AS severity, bad AS is_corrupt, i,
 round(CASE WHEN bad THEN round_even(v / 255.0::DOUBLE * {max(0.15, 1 - 0.75 * SEVERITY)}::DOUBLE * 255.0::DOUBLE, 0) ELSE v END, 6) AS p FROM b""",
    "supcon_by_batch": f"""WITH {EMB}, b AS (SELECT vec_id, family, z, (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS batch FROM emb),
s AS (SELECT a.batch, a.vec_id AS i, b.vec_id AS j, a.family = b.family AS pos, list_cosine_similarity(a.z, b.z) / 0.5::DOUBLE AS s FROM b a JOIN b ON a.batch = b.batch),
m AS (SELECT *, s - max(s) OVER (PARTITION BY i) AS c FROM s),
l AS (SELECT batch, i, j, pos, c - ln(sum(CASE WHEN i <> j THEN exp(c) ELSE 0 END) OVER (PARTITION BY i) + 1e-12) AS lp FROM m),
a AS (SELECT batch, i, avg(lp) FILTER (pos AND i <> j) AS v FROM l GROUP BY batch, i)
SELECT batch, CAST(count(v) AS INTEGER) AS anchors, round(-avg(v), 6) AS loss FROM a GROUP BY batch""",
    "channel_mean_embed": f"""WITH {IMAGES}, m AS (SELECT vec_id, avg(p) FILTER (i % 2 = 0) AS m0, avg(p) FILTER (i % 2 = 1) AS m1 FROM px GROUP BY vec_id),
y AS (SELECT vec_id, dim, m0 * sin(dim * 5.0::DOUBLE) + m1 * sin(dim * 5.0::DOUBLE + 2.0) AS v FROM m, (SELECT unnest(range(0, 8)) AS dim))
SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 1e-12), 6) AS value FROM y""",
}
