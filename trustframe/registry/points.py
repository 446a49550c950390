"""Queries: point-cloud features over line items as points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import points as P
from .fixtures import POINTS, points, r6

VALUES = ["x", "y", "z", "w"]
GRID = (16, 16)
XR, YR = (1.0, 6.5), (5.0, 95.0)
MAX_PILLARS, MAX_POINTS = 40, 8
Z_CENTRE = 0.15


def crop_range(spark, d):
    return P.crop_range(points(spark, d), XR, YR).select("frame_id", "point_idx", r6("x"), r6("y"))


def normalize_xyz(spark, d):
    return P.normalize_xyz(points(spark, d)).select("frame_id", "point_idx", r6("x"), r6("y"), r6("z"))


def drop_non_finite(spark, d):
    """Infinite heights and missing tax in some points; frames 3 and 4 lose every point."""
    p = points(spark, d)
    k = F.col("point_idx") % 13
    bent = p.withColumn("z", F.when((k == 0) | F.col("frame_id").isin(3, 4), F.lit(float("inf"))).otherwise(F.col("z"))).withColumn(
        "w", F.when(k == 1, F.lit(float("nan"))).otherwise(F.col("w"))
    )
    out = P.drop_non_finite(bent, "frame_id", VALUES, p, {"x": 3.5, "y": 50.0, "z": 0.15})
    return out.select("frame_id", "point_idx", r6("x"), r6("z"), r6("w"))


def fixed_count(spark, d):
    """100 evenly spaced points per frame."""
    return P.fixed_count(points(spark, d), "frame_id", 100).select("frame_id", "slot", "point_idx")


def fixed_count_cycle(spark, d):
    """Orders cycled or cut to 6 line items each."""
    from ..plans.ranks import rank_in_group
    from .fixtures import table

    cols = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    order = [F.col(c) for c in cols]
    l = rank_in_group(table(spark, d, "lineitem").select("l_orderkey", *cols), ["l_orderkey"], order, "rn", total="n")
    return P.fixed_slots(l, ["l_orderkey"], 6).select("l_orderkey", "slot", "rn")


def keypoints_radius(spark, d):
    return P.select_keypoints(points(spark, d), "frame_id", 16).select("frame_id", "slot", "point_idx", r6("radius"))


def resample_points(spark, d):
    """600 points per frame (at least 620 are drawn for frames below that)."""
    out = P.resample_points(points(spark, d, total="n"), "frame_id", 600, 590, 11, sizes="n")
    return out.select("frame_id", "slot", "point_idx")


def _grid(mode, extra):
    def query(spark, d):
        g = P.grid_features(points(spark, d, ordered=False), mode, 8, 12, VALUES, row="y")
        return g.select("frame_id", "token", "cell", "n", *[r6(c) for c in [f"mean_{v}" for v in VALUES] + extra])

    return query


_PILLAR_COLS = [f"std_{v}" for v in VALUES] + ["density"]
_CENTER_COLS = [f"max_{v}" for v in VALUES] + [f"off_{a}" for a in "xyz"]


def grid_tokens(spark, d):
    """Grid tokens padded to 80 rows per frame with a mask."""
    p = points(spark, d, ordered=False)
    g = P.grid_features(p, "pillars", 8, 80, ["x"], row="y")
    return P.padded_tokens(g, p, 80).select("frame_id", "token", "mask", r6("mean_x"), r6("density"))


def cell_topk(spark, d):
    """Fullest cells of each frame."""
    return P.grid_features(points(spark, d, ordered=False), "pillars", 8, 3, ["x"], row="y").select("frame_id", "token", "cell", "n")


def pillarize(spark, d):
    p = points(spark, d, ordered=False)
    out = P.pillars(p, XR, YR, GRID, MAX_PILLARS, MAX_POINTS, p)
    return out.select("frame_id", "pillar", "ix", "iy", F.col("count").alias("cnt"), "num_points")


def pillar_points(spark, d):
    p = points(spark, d)
    out = P.pillar_points(p, XR, YR, GRID, MAX_PILLARS, MAX_POINTS, p)
    return out.select("frame_id", "pillar", "slot", "point_idx")


def decorate_pillars(spark, d):
    p = points(spark, d)
    kept = P.pillar_points(p, XR, YR, GRID, MAX_PILLARS, MAX_POINTS, p)
    out = P.decorate_pillars(kept, XR, YR, GRID, Z_CENTRE, with_distance=True)
    return out.select("frame_id", "pillar", "slot", *[r6(c) for c in ("c_x", "c_y", "c_z", "p_x", "p_y", "p_z", "norm")])


def voxel_mean(spark, d):
    """Voxels of 1 x 10 x 0.1, at most 5 points each, 200 voxels per frame."""
    out = P.voxel_mean(points(spark, d), {"x": XR, "y": YR, "z": (0.0, 0.3)}, {"x": 1.1, "y": 9.0, "z": 0.1}, 5, 200, VALUES)
    return out.select("frame_id", "voxel", "vx", "vy", "vz", "n", *[r6(f"mean_{v}") for v in VALUES])


def keypoint_pool(spark, d):
    """Each frame cycled or cut to 605 points and averaged."""
    return P.keypoint_pool(points(spark, d), ["frame_id"], "point_idx", 605, ["x", "y"]).select("frame_id", r6("mean_x"), r6("mean_y"))


def densify_grid(spark, d):
    p = points(spark, d, ordered=False)
    cells = P.with_cells(p, XR, YR, GRID).groupBy("frame_id", "ix", "iy").agg(F.avg("y").alias("v"))
    return P.densify_grid(cells, p, GRID, "v").select("frame_id", "ix", "iy", r6("v"))


def regrid(spark, d):
    """16 x 16 cells pooled to 5 x 3 with overlapping bins."""
    p = points(spark, d, ordered=False)
    cells = P.with_cells(p, XR, YR, GRID).groupBy("frame_id", "ix", "iy").agg(F.avg("y").alias("v"))
    return P.regrid(P.densify_grid(cells, p, GRID, "v"), GRID, (5, 3), "v").select("frame_id", "oy", "ox", r6("v"))


def knn_group(spark, d):
    """Five nearest points of four evenly spaced centres per frame."""
    p = points(spark, d, total="n")
    c = P.fixed_count(p, "frame_id", 4, sizes="n").select("frame_id", F.col("slot").alias("centre_id"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"))
    return P.knn_group(p.drop("n"), c, 5).select("frame_id", "centre_id", "rank", "point_idx", r6("rx"), r6("ry"), r6("distance"))


def knn_group_features(spark, d):
    """The largest and the mean feature of each group, as a grouped layer pools them."""
    p = points(spark, d, total="n").withColumn("f", F.col("x") + 2 * F.col("y"))
    c = P.fixed_count(p, "frame_id", 4, sizes="n").select("frame_id", F.col("slot").alias("centre_id"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"))
    return P.knn_group(p.drop("n"), c, 5).groupBy("frame_id", "centre_id").agg(r6(F.max("f"), "f_max"), r6(F.avg("f"), "f_mean"), r6(F.max("rx"), "rx_max"))


def fps_per_frame(spark, d):
    return P.farthest_point_sample(points(spark, d), 8)


QUERIES = {
    "crop_range": crop_range,
    "normalize_xyz": normalize_xyz,
    "drop_non_finite": drop_non_finite,
    "fixed_count": fixed_count,
    "fixed_count_cycle": fixed_count_cycle,
    "keypoints_radius": keypoints_radius,
    "resample_points": resample_points,
    "grid_pillars": _grid("pillars", _PILLAR_COLS),
    "grid_centers": _grid("centers", _CENTER_COLS),
    "grid_tokens": grid_tokens,
    "cell_topk": cell_topk,
    "pillarize": pillarize,
    "pillar_points": pillar_points,
    "decorate_pillars": decorate_pillars,
    "voxel_mean": voxel_mean,
    "keypoint_pool": keypoint_pool,
    "densify_grid": densify_grid,
    "regrid": regrid,
    "knn_group": knn_group,
    "knn_group_features": knn_group_features,
    "fps_per_frame": fps_per_frame,
}

_FIXED = """g AS (SELECT frame_id, count(*) AS n FROM pt GROUP BY frame_id),
sl AS (SELECT frame_id, n, unnest(range(0, {t})) AS slot FROM g),
fx AS (SELECT frame_id, slot, CAST(CASE WHEN n >= {t} THEN round_even(slot * (n - 1)::DOUBLE / {t1}, 0) ELSE slot % n END AS BIGINT) AS idx FROM sl)"""
_CELLS = f"""cl AS (SELECT *, CAST(greatest(least(floor((x - {XR[0]}) / ({XR[1] - XR[0]}::DOUBLE / 16)), 15), 0) AS INTEGER) AS ix,
  CAST(greatest(least(floor((y - {YR[0]}) / ({YR[1] - YR[0]}::DOUBLE / 16)), 15), 0) AS INTEGER) AS iy
  FROM pt WHERE x >= {XR[0]} AND x < {XR[1]} AND y >= {YR[0]} AND y < {YR[1]})"""
_TOP = f"""tc AS (SELECT frame_id, ix, iy, count(*) AS c FROM cl GROUP BY ALL),
tp AS (SELECT *, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY c DESC, iy * 16 + ix) - 1 AS INTEGER) AS pillar FROM tc),
pl AS (SELECT * FROM tp WHERE pillar < {MAX_PILLARS})"""
_KEPT = f"""ps AS (SELECT cl.*, pillar, c, row_number() OVER (PARTITION BY cl.frame_id, pillar ORDER BY point_idx) - 1 AS rn FROM cl JOIN pl USING (frame_id, ix, iy)),
ss AS (SELECT frame_id, pillar, c, unnest(range(0, {MAX_POINTS})) AS slot FROM pl),
kp AS (SELECT ps.*, slot FROM ss JOIN ps ON ps.frame_id = ss.frame_id AND ps.pillar = ss.pillar
  AND ps.rn = CASE WHEN ss.c >= {MAX_POINTS} THEN round_even(slot * (ss.c - 1)::DOUBLE / {MAX_POINTS - 1}, 0) ELSE slot % ss.c END)"""
_GRIDC = """gm AS (SELECT frame_id, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, count(*) AS tot, avg(x) AS ax, avg(y) AS ay, avg(z) AS az FROM pt GROUP BY frame_id),
gc AS (SELECT pt.*, tot, ax, ay, az,
 CAST(floor(least(greatest((y - ly) / greatest(hy - ly, 1e-6), 0), 0.999999) * 8) * 8 + floor(least(greatest((x - lx) / greatest(hx - lx, 1e-6), 0), 0.999999) * 8) AS INTEGER) AS cell
 FROM pt JOIN gm USING (frame_id))"""


def _grid_sql(cols: str, tokens: int, extra: str = "") -> str:
    return f"""WITH {POINTS}, {_GRIDC},
a AS (SELECT frame_id, cell, count(*) AS n, {cols} FROM gc GROUP BY frame_id, cell),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, cell) - 1 AS INTEGER) AS token FROM a)
"""


_MEAN = ", ".join(f"round(avg({v}), 6) AS mean_{v}" for v in VALUES)
_STD = ", ".join(f"round(stddev_pop({v}), 6) AS std_{v}" for v in VALUES)
_MAX = ", ".join(f"round(max({v}), 6) AS max_{v}" for v in VALUES)
_OFF = ", ".join(f"round(avg({v}) - any_value(a{v}), 6) AS off_{v}" for v in "xyz")
_DENSE = """fr AS (SELECT DISTINCT frame_id FROM pt), sp AS (SELECT frame_id, i % 16 AS ix, i // 16 AS iy FROM fr, (SELECT unnest(range(0, 256)) AS i)),
cv AS (SELECT frame_id, ix, iy, avg(y) AS v FROM cl GROUP BY ALL),
dn AS (SELECT sp.frame_id, CAST(sp.ix AS INTEGER) AS ix, CAST(sp.iy AS INTEGER) AS iy, coalesce(v, 0) AS v FROM sp LEFT JOIN cv ON cv.frame_id = sp.frame_id AND cv.ix = sp.ix AND cv.iy = sp.iy)"""

ORACLE = {
    "crop_range": f"WITH {POINTS}, {_CELLS} SELECT frame_id, point_idx, round(x, 6) AS x, round(y, 6) AS y FROM cl",
    "normalize_xyz": f"""WITH {POINTS}, c AS (SELECT frame_id, point_idx, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM pt WINDOW w AS (PARTITION BY frame_id)),
s AS (SELECT *, greatest(max(sqrt(x * x + y * y + z * z)) OVER (PARTITION BY frame_id), 1e-6) AS m FROM c)
SELECT frame_id, point_idx, round(x / m, 6) AS x, round(y / m, 6) AS y, round(z / m, 6) AS z FROM s""",
    "drop_non_finite": f"""WITH {POINTS}
SELECT frame_id, point_idx, round(x, 6) AS x, round(z, 6) AS z, round(w, 6) AS w FROM pt WHERE point_idx % 13 > 1 AND frame_id NOT IN (3, 4)
UNION ALL SELECT DISTINCT frame_id, 0, 3.5, 0.15, 0 FROM pt WHERE frame_id IN (3, 4)""",
    "fixed_count": f"WITH {POINTS}, {_FIXED.format(t=100, t1=99)} SELECT frame_id, slot, idx AS point_idx FROM fx",
    "fixed_count_cycle": """WITH g AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey, n, unnest(range(0, 6)) AS slot FROM g)
SELECT l_orderkey, slot, CAST(CASE WHEN n >= 6 THEN round_even(slot * (n - 1)::DOUBLE / 5, 0) ELSE slot % n END AS BIGINT) AS rn FROM s""",
    "keypoints_radius": f"""WITH {POINTS}, {_FIXED.format(t=16, t1=15)},
r AS (SELECT *, sqrt(x * x + y * y + z * z) AS radius FROM pt), k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY radius DESC, point_idx) - 1 AS rn FROM r)
SELECT fx.frame_id, slot, point_idx, round(radius, 6) AS radius FROM fx JOIN k ON k.frame_id = fx.frame_id AND k.rn = fx.idx""",
    "resample_points": f"""WITH {POINTS}, g AS (SELECT frame_id, count(*) AS n FROM pt GROUP BY 1),
big AS (SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY md5('11|' || frame_id || '|' || point_idx), point_idx) - 1 AS slot, point_idx FROM pt JOIN g USING (frame_id) WHERE n >= 600),
sl AS (SELECT frame_id, n, CASE WHEN n < 590 THEN 590 ELSE n END AS base, unnest(range(0, 600)) AS slot FROM g WHERE n < 600),
b AS (SELECT *, CASE WHEN slot < base THEN slot ELSE CAST('0x' || substr(md5('pad|11|' || frame_id || '|' || slot), 1, 12) AS BIGINT) % base END AS b FROM sl)
SELECT frame_id, slot, point_idx FROM big WHERE slot < 600
UNION ALL SELECT frame_id, slot, CASE WHEN n < 590 THEN CAST('0x' || substr(md5('grow|11|' || frame_id || '|' || b), 1, 12) AS BIGINT) % n ELSE b END FROM b""",
    "grid_pillars": _grid_sql(f"{_MEAN}, {_STD}, round(count(*)::DOUBLE / any_value(tot), 6) AS density", 12) + "SELECT frame_id, token, cell, n, " + ", ".join([f"mean_{v}" for v in VALUES] + _PILLAR_COLS) + " FROM t WHERE token < 12",
    "grid_centers": _grid_sql(f"{_MEAN}, {_MAX}, {_OFF}", 12) + "SELECT frame_id, token, cell, n, " + ", ".join([f"mean_{v}" for v in VALUES] + _CENTER_COLS) + " FROM t WHERE token < 12",
    "grid_tokens": _grid_sql("round(avg(x), 6) AS mean_x, round(count(*)::DOUBLE / any_value(tot), 6) AS density", 80)
    + """, sp AS (SELECT DISTINCT frame_id, unnest(range(0, 80)) AS token FROM (SELECT DISTINCT frame_id FROM pt))
SELECT sp.frame_id, CAST(sp.token AS INTEGER) AS token, t.cell IS NOT NULL AS mask, coalesce(mean_x, 0) AS mean_x, coalesce(density, 0) AS density FROM sp LEFT JOIN t ON t.frame_id = sp.frame_id AND t.token = sp.token""",
    "cell_topk": _grid_sql("1 AS one", 3) + "SELECT frame_id, token, cell, n FROM t WHERE token < 3",
    "pillarize": f"WITH {POINTS}, {_CELLS}, {_TOP} SELECT frame_id, pillar, ix, iy, c AS cnt, least(c, {MAX_POINTS}) AS num_points FROM pl",
    "pillar_points": f"WITH {POINTS}, {_CELLS}, {_TOP}, {_KEPT} SELECT frame_id, pillar, slot, point_idx FROM kp",
    "decorate_pillars": f"""WITH {POINTS}, {_CELLS}, {_TOP}, {_KEPT}, r AS (SELECT * FROM kp WHERE slot < least(c, {MAX_POINTS}))
SELECT frame_id, pillar, slot, round(x - avg(x) OVER w, 6) AS c_x, round(y - avg(y) OVER w, 6) AS c_y, round(z - avg(z) OVER w, 6) AS c_z,
 round(x - (ix * {(XR[1] - XR[0]) / 16}::DOUBLE + {(XR[1] - XR[0]) / 32}::DOUBLE + {XR[0]}), 6) AS p_x, round(y - (iy * {(YR[1] - YR[0]) / 16}::DOUBLE + {(YR[1] - YR[0]) / 32}::DOUBLE + {YR[0]}), 6) AS p_y,
 round(z - {Z_CENTRE}::DOUBLE, 6) AS p_z, round(sqrt(x * x + y * y + z * z), 6) AS norm FROM r WINDOW w AS (PARTITION BY frame_id, pillar)""",
    "voxel_mean": f"""WITH {POINTS}, v AS (SELECT *, CAST(floor((x - {XR[0]}) / 1.1::DOUBLE) AS INTEGER) AS vx, CAST(floor((y - {YR[0]}) / 9.0::DOUBLE) AS INTEGER) AS vy, CAST(floor(z / 0.1::DOUBLE) AS INTEGER) AS vz
 FROM pt WHERE x >= {XR[0]} AND x < {XR[1]} AND y >= {YR[0]} AND y < {YR[1]} AND z >= 0 AND z < 0.3),
r AS (SELECT *, row_number() OVER (PARTITION BY frame_id, vx, vy, vz ORDER BY point_idx) AS rn FROM v),
a AS (SELECT frame_id, vx, vy, vz, min(point_idx) AS f, count(*) AS n, {_MEAN} FROM r WHERE rn <= 5 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY f) - 1 AS voxel FROM a)
SELECT frame_id, voxel, vx, vy, vz, n, {', '.join(f'mean_{v}' for v in VALUES)} FROM o WHERE voxel < 200""",
    "keypoint_pool": f"""WITH {POINTS}, g AS (SELECT frame_id, count(*) AS n FROM pt GROUP BY 1), s AS (SELECT frame_id, n, unnest(range(0, 605)) AS slot FROM g)
SELECT s.frame_id, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y FROM s JOIN pt ON pt.frame_id = s.frame_id AND pt.point_idx = slot % n GROUP BY s.frame_id""",
    "densify_grid": f"WITH {POINTS}, {_CELLS}, {_DENSE} SELECT frame_id, ix, iy, round(v, 6) AS v FROM dn",
    "regrid": f"""WITH {POINTS}, {_CELLS}, {_DENSE}, oy AS (SELECT unnest(range(0, 5)) AS oy), ox AS (SELECT unnest(range(0, 3)) AS ox)
SELECT frame_id, oy, ox, round(avg(v), 6) AS v FROM dn JOIN oy ON iy >= floor(oy * 16 / 5.0) AND iy < ceil((oy + 1) * 16 / 5.0) JOIN ox ON ix >= floor(ox * 16 / 3.0) AND ix < ceil((ox + 1) * 16 / 3.0)
GROUP BY frame_id, oy, ox""",
    "knn_group": f"""WITH {POINTS}, {_FIXED.format(t=4, t1=3)}, c AS (SELECT fx.frame_id, slot AS centre_id, x AS cx, y AS cy, z AS cz FROM fx JOIN pt ON pt.frame_id = fx.frame_id AND pt.point_idx = fx.idx),
d AS (SELECT c.*, point_idx, x - cx AS rx, y - cy AS ry, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) AS dist FROM c JOIN pt USING (frame_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY frame_id, centre_id ORDER BY dist, point_idx) AS INTEGER) AS rank FROM d)
SELECT frame_id, centre_id, rank, point_idx, round(rx, 6) AS rx, round(ry, 6) AS ry, round(dist, 6) AS distance FROM r WHERE rank <= 5""",
    "knn_group_features": f"""WITH {POINTS}, {_FIXED.format(t=4, t1=3)}, c AS (SELECT fx.frame_id, slot AS centre_id, x AS cx, y AS cy, z AS cz FROM fx JOIN pt ON pt.frame_id = fx.frame_id AND pt.point_idx = fx.idx),
d AS (SELECT frame_id, centre_id, x + 2 * y AS f, x - cx AS rx, row_number() OVER (PARTITION BY frame_id, centre_id ORDER BY sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)), point_idx) AS rank FROM c JOIN pt USING (frame_id))
SELECT frame_id, centre_id, round(max(f), 6) AS f_max, round(avg(f), 6) AS f_mean, round(max(rx), 6) AS rx_max FROM d WHERE rank <= 5 GROUP BY frame_id, centre_id""",
    "fps_per_frame": f"""WITH RECURSIVE {POINTS},
r AS (SELECT frame_id, point_idx, x, y, z, 1e300::DOUBLE AS far, 0 AS k, point_idx = 0 AS sel FROM pt
UNION ALL SELECT frame_id, point_idx, x, y, z, f2, k + 1, row_number() OVER (PARTITION BY frame_id ORDER BY f2 DESC, point_idx) = 1
 FROM (SELECT *, least(far, (x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz)) AS f2
  FROM (SELECT *, max(x) FILTER (sel) OVER w AS sx, max(y) FILTER (sel) OVER w AS sy, max(z) FILTER (sel) OVER w AS sz FROM r WHERE k < 7 WINDOW w AS (PARTITION BY frame_id))))
SELECT frame_id, CAST(k AS INTEGER) AS order, point_idx FROM r WHERE sel""".replace("AS order", 'AS "order"'),
}
