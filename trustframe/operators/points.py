"""Point-cloud features on long tables ``frame_id, point_idx, x, y, z, feats...``.

A frame may hold any number of points: per-frame facts come from partial
aggregates, orders within a frame from bucketed ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType

from ..functions.vectors import all_finite, is_finite
from ..plans.lookup import SALTS, salted_join, spread, with_group_stats
from ..plans.ranks import rank_in_group
from ..plans.tiles import scoped_cross_tiles
from ..session import materialize

XYZ = ("x", "y", "z")


def drop_non_finite(points: DataFrame, frame: str, values: Sequence[str], frames: DataFrame, centre: dict[str, float]) -> DataFrame:
    """Keep points whose every value is finite; a frame left empty gets one point at ``centre``."""
    ok = F.lit(True)
    for v in values:
        kind = points.schema[v].dataType.typeName()
        ok = ok & (all_finite(v) if kind == "array" else is_finite(v))
    kept = points.where(ok)
    empty = frames.select(frame).distinct().join(kept.select(frame).distinct(), frame, "left_anti")
    for f in points.schema.fields:
        if f.name != frame:
            empty = empty.withColumn(f.name, F.lit(centre.get(f.name, 0)).cast(f.dataType))
    return kept.unionByName(empty)


def normalize_xyz(points: DataFrame, frame: str = "frame_id", row: str = "point_idx") -> DataFrame:
    """Centre each frame and divide by its largest radius (floored at 1e-6)."""
    c = with_group_stats(points, [frame], {f"_m{a}": F.avg(a) for a in XYZ}, [row])
    for a in XYZ:
        c = c.withColumn(a, F.col(a) - F.col(f"_m{a}"))
    c = c.drop(*[f"_m{a}" for a in XYZ])
    radius = F.sqrt(sum((F.col(a) * F.col(a) for a in XYZ), F.lit(0.0)))
    s = with_group_stats(c, [frame], {"_scale": F.greatest(F.max(radius), F.lit(1e-6))}, [row])
    for a in XYZ:
        s = s.withColumn(a, F.col(a) / F.col("_scale"))
    return s.drop("_scale")


def crop_range(points: DataFrame, x_range: tuple[float, float], y_range: tuple[float, float]) -> DataFrame:
    return points.where(
        (F.col("x") >= x_range[0]) & (F.col("x") < x_range[1]) & (F.col("y") >= y_range[0]) & (F.col("y") < y_range[1])
    )


def fixed_slots(ranked: DataFrame, keys: Sequence[str], target: int, rank: str = "rn", total: str = "n") -> DataFrame:
    """Exactly ``target`` rows per group as ``slot``: evenly spaced ranks when trimming, cycling when short.

    Each row computes the slots it fills, so nothing is joined and groups need no task of their own.
    """
    i = F.sequence(F.lit(0), F.lit(target - 1))
    if target > 1:
        spread = lambda s: F.bround(s * (F.col(total) - 1) / F.lit(float(target - 1)))
    else:
        spread = lambda s: F.lit(0.0)
    # Slots near this rank's own position are the only candidates when trimming.
    step = (F.col(total) - 1) / F.lit(float(max(target - 1, 1)))
    guess = F.floor(F.col(rank) / F.greatest(step, F.lit(1e-12)))
    near = F.sequence(F.greatest(guess - 1, F.lit(0)), F.least(guess + 2, F.lit(target - 1).cast("long")))
    trimmed = F.filter(near, lambda s: spread(s) == F.col(rank))
    if target == 1:
        trimmed = F.when(F.col(rank) == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>"))
    trimmed = F.when(guess - 1 > target - 1, F.array().cast("array<long>")).otherwise(trimmed)
    cycled = F.filter(i, lambda s: F.pmod(s, F.col(total)) == F.col(rank)).cast("array<long>")
    return ranked.withColumn("slot", F.explode(F.when(F.col(total) >= target, trimmed).otherwise(cycled)))


def fixed_count(points: DataFrame, frame: str, target: int, row: str = "point_idx", sizes: str | None = None) -> DataFrame:
    """Trim or cycle each frame to ``target`` points in point order."""
    p = points if sizes else with_group_stats(points, [frame], {"_n": F.count(F.lit(1))}, [row])
    return fixed_slots(p, [frame], target, row, sizes or "_n").drop("_n")


def select_keypoints(points: DataFrame, frame: str, target: int, descending: bool = True, row: str = "point_idx") -> DataFrame:
    """Order by distance from the origin (ties by point index), then ``fixed_count``."""
    r = points.withColumn("radius", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))
    key = -F.col("radius") if descending else F.col("radius")
    ranked = rank_in_group(r, [frame], [key, F.col(row)], "rn", total="n")
    return fixed_slots(ranked, [frame], target).drop("n")


def resample_points(points: DataFrame, frame: str, max_points: int, min_points: int, seed: int, row: str = "point_idx", step: str | None = None, sizes: str | None = None) -> DataFrame:
    """Bring each frame to ``max_points`` rows in ``slot``; ``sizes`` names a column that already holds the frame's size.

    Large frames keep a hashed choice without replacement.  Small ones first grow to
    ``min_points`` by hashed draws, and the rest is padded by hashed draws from that.
    ``step`` (frame number t) seeds the draws per frame with 104729 (t + 1).
    """
    seed_col = F.lit(seed) if step is None else F.lit(104729) * (F.col(step) + 1)  # fixed value: seed stride
    p = points.withColumnRenamed(sizes, "_n") if sizes else with_group_stats(points, [frame], {"_n": F.count(F.lit(1))}, [row])
    h = F.md5(F.concat_ws("|", seed_col, F.col(frame), F.col(row)))
    big = p.where(F.col("_n") >= max_points).withColumn("_h", h)
    if max_points <= 1000:
        # The rank filter is applied inside map tasks, so a hot frame never shuffles whole.
        w = W.partitionBy(frame).orderBy("_h", row)
        big = big.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_points)
        big = big.withColumn("slot", (F.col("_r") - 1).cast("long")).drop("_r")
    else:
        big = rank_in_group(big, [frame], [F.col("_h"), F.col(row)], "slot").where(F.col("slot") < max_points)
    big = big.drop("_h", "_n")

    def draw(tag, slot, n):
        u = F.md5(F.concat_ws("|", F.lit(tag), seed_col, F.col(frame), slot))
        return F.pmod(F.conv(F.substring(u, 1, 12), 16, 10).cast("long"), n)

    # A small frame has fewer than max_points rows, so its slot list is bounded.
    small = p.where(F.col("_n") < max_points)
    heads = small.groupBy(frame, *([step] if step else [])).agg(F.max("_n").alias("_n"))
    slots = heads.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_points - 1).cast("long"))))
    tiny = F.col("_n") < min_points
    base = F.when(tiny, F.lit(min_points)).otherwise(F.col("_n"))
    # Position inside the base list: itself, or a padding draw from it.
    slots = slots.withColumn("_b", F.when(F.col("slot") < base, F.col("slot")).otherwise(draw("pad", F.col("slot"), base)))
    slots = slots.withColumn("_src", F.when(tiny, draw("grow", F.col("_b"), F.col("_n"))).otherwise(F.col("_b")))
    numbered = small.drop("_n").withColumnRenamed(row, "_src")
    # The planner takes the slots for as small as their heads; broadcast, the driver would hold max_points rows per frame.
    grown = slots.select(frame, "slot", "_src").hint("merge").join(numbered, [frame, "_src"]).withColumnRenamed("_src", row)
    return big.unionByName(grown.select(*big.columns))


# ---- grids and pillars ------------------------------------------------------------------


def grid_features(points: DataFrame, mode: str, grid: int, max_tokens: int, values: Sequence[str], frame: str = "frame_id", row: str = "point_idx") -> DataFrame:
    """XY-grid cell features of the ``max_tokens`` fullest cells per frame, one row per token.

    ``pillars``: mean, population deviation, density; ``centers``: mean, max, offset of the
    cell mean from the scene centroid.  Columns ``frame, token, cell, n, mean_*, ...``.
    """
    if mode not in ("pillars", "centers"):
        raise ValueError(f"unsupported grid mode {mode}")
    stats = {"_n": F.count(F.lit(1))}
    for a in ("x", "y"):
        stats[f"_lo{a}"], stats[f"_hi{a}"] = F.min(a), F.max(a)
    if mode == "centers":
        stats.update({f"_c{a}": F.avg(a) for a in XYZ})
    p = with_group_stats(points, [frame], stats, [row])

    def axis(a):
        span = F.greatest(F.col(f"_hi{a}") - F.col(f"_lo{a}"), F.lit(1e-6))
        unit = F.least(F.greatest((F.col(a) - F.col(f"_lo{a}")) / span, F.lit(0.0)), F.lit(0.999999))
        return F.least(F.floor(unit * grid), F.lit(grid - 1)).cast("int")

    p = p.withColumn("cell", axis("y") * grid + axis("x"))
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values]]
    if mode == "pillars":
        aggs += [F.stddev_pop(v).alias(f"std_{v}") for v in values]
        aggs.append((F.count(F.lit(1)) / F.max("_n")).alias("density"))
    else:
        aggs += [F.max(v).alias(f"max_{v}") for v in values]
        aggs += [(F.avg(a) - F.max(f"_c{a}")).alias(f"off_{a}") for a in XYZ]
    cells = p.groupBy(frame, "cell").agg(*aggs)
    w = W.partitionBy(frame).orderBy(F.desc("n"), "cell")  # at most grid^2 cells per frame
    ranked = cells.withColumn("token", F.row_number().over(w) - 1).where(F.col("token") < max_tokens)
    return ranked


def padded_tokens(tokens: DataFrame, frames: DataFrame, max_tokens: int, frame: str = "frame_id") -> DataFrame:
    """Exactly ``max_tokens`` rows per frame with ``mask``; missing tokens hold zeros."""
    spine = frames.select(frame).distinct().withColumn("token", F.explode(F.sequence(F.lit(0), F.lit(max_tokens - 1))))
    out = spine.join(tokens.withColumn("mask", F.lit(True)), [frame, "token"], "left")
    fill = [c for c in out.columns if c not in (frame, "token", "mask")]
    return out.select(frame, "token", F.coalesce("mask", F.lit(False)).alias("mask"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in fill])


def with_cells(points: DataFrame, x_range, y_range, grid: tuple[int, int]) -> DataFrame:
    """Cropped points with clamped ``ix, iy``."""
    nx, ny = grid
    sx, sy = (x_range[1] - x_range[0]) / nx, (y_range[1] - y_range[0]) / ny

    def idx(a, lo, size, n):
        return F.greatest(F.least(F.floor((F.col(a) - lo) / size), F.lit(n - 1).cast("long")), F.lit(0).cast("long")).cast("int")

    c = crop_range(points, x_range, y_range)
    return c.withColumn("ix", idx("x", x_range[0], sx, nx)).withColumn("iy", idx("y", y_range[0], sy, ny))


def pillars(points: DataFrame, x_range, y_range, grid: tuple[int, int], max_pillars: int, max_points: int, frames: DataFrame, frame: str = "frame_id") -> DataFrame:
    """The ``max_pillars`` fullest cells per frame: ``ix, iy, count, num_points``.

    A frame without points in range reports one empty pillar at the grid centre.
    """
    cells = with_cells(points, x_range, y_range, grid).groupBy(frame, "ix", "iy").agg(F.count(F.lit(1)).alias("count"))
    w = W.partitionBy(frame).orderBy(F.desc("count"), F.col("iy") * grid[0] + F.col("ix"))  # bounded by the grid
    top = cells.withColumn("pillar", F.row_number().over(w) - 1).where(F.col("pillar") < max_pillars)
    top = top.withColumn("num_points", F.least("count", F.lit(max_points).cast("long")))
    bare = frames.select(frame).distinct().join(top.select(frame).distinct(), frame, "left_anti")
    zero = bare.select(
        frame, F.lit(grid[0] // 2).alias("ix"), F.lit(grid[1] // 2).alias("iy"), F.lit(0).cast("long").alias("count"),
        F.lit(0).alias("pillar"), F.lit(1).cast("long").alias("num_points"),
    )
    return top.unionByName(zero)


def pillar_points(points: DataFrame, x_range, y_range, grid, max_pillars: int, max_points: int, frames: DataFrame, frame: str = "frame_id", row: str = "point_idx") -> DataFrame:
    """Kept points of kept pillars, with ``slot`` 0..max_points-1 (trimmed evenly or cycled)."""
    kept = pillars(points, x_range, y_range, grid, max_pillars, max_points, frames, frame).where(F.col("count") > 0)
    celled = with_cells(points, x_range, y_range, grid)
    inside = salted_join(celled, kept.select(frame, "ix", "iy", "pillar", "num_points"), [frame, "ix", "iy"], [row])
    ranked = rank_in_group(inside, [frame, "pillar"], [F.col(row)], "rn", total="n")
    return fixed_slots(ranked, [frame, "pillar"], max_points).drop("rn", "n")


def decorate_pillars(kept: DataFrame, x_range, y_range, grid, z_centre: float, with_distance: bool = False, frame: str = "frame_id") -> DataFrame:
    """Offsets of each real slot to its pillar's mean and centre (slots past ``num_points`` are masked).

    ``kept`` comes from ``pillar_points``; a pillar holds a bounded number of slots, so its
    mean is a bounded window.
    """
    nx, ny = grid
    sx, sy = (x_range[1] - x_range[0]) / nx, (y_range[1] - y_range[0]) / ny
    real = kept.where(F.col("slot") < F.col("num_points"))
    w = W.partitionBy(frame, "pillar")
    out = real
    for a in XYZ:
        out = out.withColumn(f"c_{a}", F.col(a) - F.avg(a).over(w))
    out = (
        out.withColumn("p_x", F.col("x") - (F.col("ix") * sx + sx / 2 + x_range[0]))
        .withColumn("p_y", F.col("y") - (F.col("iy") * sy + sy / 2 + y_range[0]))
        .withColumn("p_z", F.col("z") - z_centre)
    )
    if with_distance:
        out = out.withColumn("norm", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))
    return out


def voxel_mean(points: DataFrame, ranges: dict[str, tuple[float, float]], size: dict[str, float], max_points: int, max_voxels: int,
               values: Sequence[str], frame: str = "frame_id", row: str = "point_idx") -> DataFrame:
    """Mean of the first ``max_points`` points per voxel, for the first ``max_voxels`` voxels met per frame.

    Voxels are met in point order.  A frame with no voxel reports its first point at voxel (0, 0, 0).
    """
    inside = F.lit(True)
    v = points
    for a in XYZ:
        lo, hi = ranges[a]
        inside = inside & (F.col(a) >= lo) & (F.col(a) < hi)
        v = v.withColumn(f"v{a}", F.floor((F.col(a) - lo) / size[a]).cast("int"))
    v = v.where(inside)
    cell = [frame, "vx", "vy", "vz"]
    ranked = rank_in_group(v, cell, [F.col(row)], "rn")
    first = ranked.where(F.col("rn") < max_points)
    means = first.groupBy(*cell).agg(F.min(row).alias("_first"), F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in values])
    w = W.partitionBy(frame).orderBy("_first")
    if max_voxels <= 1000:
        capped = means.withColumn("voxel", F.row_number().over(w) - 1).where(F.col("voxel") < max_voxels)
    else:
        capped = rank_in_group(means, [frame], [F.col("_first")], "voxel").where(F.col("voxel") < max_voxels)
    capped = capped.drop("_first").withColumn("voxel", F.col("voxel").cast("long"))
    bare = points.join(capped.select(frame).distinct(), frame, "left_anti")
    lone = bare.groupBy(frame).agg(*[F.min_by(c, row).alias(f"mean_{c}") for c in values])
    lone = lone.select(frame, *[F.lit(0).alias(f"v{a}") for a in XYZ], F.lit(1).cast("long").alias("n"), *[f"mean_{c}" for c in values], F.lit(0).cast("long").alias("voxel"))
    return capped.unionByName(lone)


def keypoint_pool(rows: DataFrame, keys: Sequence[str], order: str, k: int, values: Sequence[str]) -> DataFrame:
    """Repeat-cycle or cut each group to ``k`` rows in ``order`` (a dense 0-based index) and average them."""
    p = with_group_stats(rows, keys, {"_n": F.count(F.lit(1))}, [order])
    times = F.when(F.col("_n") >= k, F.lit(1)).otherwise(F.floor((k - 1 - F.col(order)) / F.col("_n")) + 1)
    used = p.where(F.col(order) < k).withColumn("_w", times.cast("double"))
    return used.groupBy(*keys).agg(*[(F.sum(F.col(v) * F.col("_w")) / F.sum("_w")).alias(f"mean_{v}") for v in values])


def densify_grid(cells: DataFrame, frames: DataFrame, grid: tuple[int, int], value: str, frame: str = "frame_id") -> DataFrame:
    """Every cell of every frame, missing cells as 0."""
    nx, ny = grid
    spine = frames.select(frame).distinct().withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1))))
    spine = spine.select(frame, F.pmod("cell", F.lit(nx)).cast("int").alias("ix"), F.floor(F.col("cell") / nx).cast("int").alias("iy"))
    return spine.join(cells.select(frame, "ix", "iy", value), [frame, "ix", "iy"], "left").withColumn(value, F.coalesce(value, F.lit(0).cast("double")))


def regrid(cells: DataFrame, grid: tuple[int, int], out: tuple[int, int], value: str, frame: str = "frame_id") -> DataFrame:
    """Adaptive average pooling of dense ``iy, ix`` cells to ``out`` = (h, w).

    Output bin i covers input rows floor(i H / h) .. ceil((i+1) H / h) - 1; each cell lists
    the bins covering it, so no range join is needed.
    """

    def bins(pos, size, n):
        first = F.floor(F.col(pos) * n / F.lit(size))
        cand = F.sequence(F.greatest(first - 1, F.lit(0).cast("long")), F.least(first + 1, F.lit(n - 1).cast("long")))
        return F.filter(cand, lambda i: (F.col(pos) >= F.floor(i * size / F.lit(n))) & (F.col(pos) < F.ceil((i + 1) * size / F.lit(n))))

    nx, ny = grid
    h, w = out
    c = cells.withColumn("oy", F.explode(bins("iy", ny, h))).withColumn("ox", F.explode(bins("ix", nx, w)))
    return c.groupBy(frame, "oy", "ox").agg(F.avg(value).alias(value))


# ---- neighbours and sampling within a frame ----------------------------------------------


# Points and centres of a frame that meet in one task.
KNN_POINTS, KNN_CENTRES = 16_384, 256


def knn_group(points: DataFrame, centres: DataFrame, k: int, frame: str = "frame_id", row: str = "point_idx") -> DataFrame:
    """The k nearest points of each centre in its frame (ties: smaller ``row``), coordinates relative to the centre.

    ``centres`` has ``centre_id, cx, cy, cz`` by frame, any number of them; the points' other columns
    (features) come along.  Blocks of points and centres meet in tiles, which keep k candidates per
    centre, so n / ``KNN_POINTS`` * k rows per centre are ranked, not n.  Points without a finite distance come last.
    """
    extra = [c for c in points.columns if c not in (frame, row, *XYZ)]
    types = {f.name: f.dataType.simpleString() for f in [*points.schema.fields, *centres.select("centre_id").schema.fields]}
    out = [frame, "centre_id", row, *[f"r{a}" for a in XYZ], "distance", *extra]
    ddl = ", ".join(f"`{c}` {types.get(c, 'double')}" for c in out)
    kinds = {f.name: f.dataType for f in [*points.schema.fields, *centres.select("centre_id").schema.fields]}
    arrow_types = [to_arrow_type(kinds.get(c, DoubleType())) for c in out]

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_arrays([pa.array([], f) for f in arrow_types], names=out)
        p, c = (np.stack([t.column(f"{side}{x}").to_numpy().astype(float) for x in XYZ], axis=1) for t, side in ((a, ""), (b, "c")))
        d = np.sqrt(sum((p[None, :, i] - c[:, None, i]) ** 2 for i in range(3)))
        near = np.where(np.isnan(d), np.inf, d)
        place = np.empty(len(p), np.int64)
        place[np.argsort(a.column(row).to_numpy(), kind="stable")] = np.arange(len(p))
        limit = np.partition(near, k - 1, axis=1)[:, k - 1 : k] if k < len(p) else np.full((len(c), 1), np.inf)
        i, j = np.nonzero(near <= limit)
        order = np.lexsort((place[j], near[i, j], i))
        i, j = i[order], j[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j = i[keep], j[keep]
        rel = p[j] - c[i]
        mine, theirs = a.take(pa.array(j)), b.take(pa.array(i))
        cols = [mine.column(frame), theirs.column("centre_id"), mine.column(row), *[pa.array(rel[:, x]) for x in range(3)], pa.array(d[i, j])]
        return pa.Table.from_arrays([*cols, *[mine.column(x) for x in extra]], names=out)

    c = centres.select(frame, "centre_id", *[F.col(f"c{a}").cast("double") for a in XYZ])
    found = scoped_cross_tiles(points, c, [frame], row, "centre_id", nearest, ddl, KNN_POINTS, KNN_CENTRES)
    w = W.partitionBy(frame, "centre_id").orderBy(F.isnan("distance"), "distance", row)
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(frame, "centre_id", "rank", row, "rx", "ry", "rz", "distance", *extra)


def farthest_points(xyz: np.ndarray, n: int) -> np.ndarray:
    """Indices of iterative max-min selection from index 0."""
    far = np.full(len(xyz), np.inf)
    pick = np.zeros(min(n, len(xyz)), int)
    for i in range(1, len(pick)):
        far = np.minimum(far, ((xyz - xyz[pick[i - 1]]) ** 2).sum(axis=1))
        pick[i] = far.argmax()
    return pick


FRAME_TASK_POINTS = 200_000


def farthest_point_sample(points: DataFrame, n: int, frame: str = "frame_id", row: str = "point_idx", task_points: int | None = None) -> DataFrame:
    """``frame, order, point``: farthest-point sampling from the smallest point index (ties: smaller index).

    Frames counted within ``task_points`` are sampled whole inside tasks.  Larger ones run
    round by round as distributed aggregates, all such frames together.
    """
    task_points = FRAME_TASK_POINTS if task_points is None else task_points
    p = with_group_stats(points.select(frame, row, *XYZ), [frame], {"_n": F.count(F.lit(1))}, [row])
    ft, rt = (points.schema[c].dataType.simpleString() for c in (frame, row))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row)
        pick = farthest_points(pdf[list(XYZ)].to_numpy(float), n)
        return pd.DataFrame({frame: pdf[frame].iloc[0], "order": np.arange(len(pick)), row: pdf[row].to_numpy()[pick]})

    small = spread(p.where(F.col("_n") <= task_points).drop("_n"), frame).groupBy(frame).applyInPandas(run, f"{frame} {ft}, order int, {row} {rt}")
    sizes = points.groupBy(frame).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > task_points)
    if not sizes.limit(1).count():
        return small
    state = materialize(p.where(F.col("_n") > task_points).drop("_n").withColumn("_far", F.lit(float("inf"))))
    last = materialize(state.groupBy(frame).agg(F.min(F.struct(row, *XYZ)).alias("s")).select(frame, "s.*"))
    out = last.select(frame, F.lit(0).alias("order"), row)
    for i in range(1, n):
        near = last.select(frame, *[F.col(a).alias(f"l{a}") for a in XYZ])
        d = sum(((F.col(a) - F.col(f"l{a}")) ** 2 for a in XYZ), F.lit(0.0))
        joined = salted_join(state, near, [frame], [row], salts=SALTS)
        state = materialize(joined.withColumn("_far", F.least("_far", d)).select(frame, row, *XYZ, "_far"))
        best = state.groupBy(frame).agg(F.max(F.struct(F.col("_far"), (-F.col(row)).alias("neg"), F.col(row), *[F.col(a) for a in XYZ])).alias("s"))
        last = materialize(best.select(frame, f"s.{row}", *[f"s.{a}" for a in XYZ]))
        out = out.unionByName(last.select(frame, F.lit(i).alias("order"), row))
    return small.unionByName(out)


def masked_mean_pool(tokens: DataFrame, item: str, vec: str = "vec", mask: str | None = "mask") -> DataFrame:
    """Mean of the unmasked token vectors per item, as rows ``item, dim, value``; an all-masked item gives zeros."""
    m = F.lit(1.0) if mask is None else F.col(mask).cast("double")
    long = tokens.select(item, m.alias("m"), F.posexplode(vec).alias("dim", "v"))
    den = F.greatest(F.sum("m"), F.lit(1e-6))
    return long.groupBy(item, "dim").agg((F.sum(F.col("v") * F.col("m")) / den).alias("value"))


# ---- frame files -------------------------------------------------------------------------


def longest_stream(frames: DataFrame, length: int, stream: str = "stream", order: Sequence[str] = ("sort_key", "name")) -> DataFrame:
    """First ``length`` frames of the stream with most frames (ties by name); too short fails."""
    top = frames.groupBy(stream).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), stream).limit(1)
    row = top.first()
    if row is None or row["c"] < length:
        raise ValueError(f"no stream has {length} frames")
    mine = frames.where(F.col(stream) == F.lit(row[stream]))
    return mine.orderBy(*order).limit(length)
