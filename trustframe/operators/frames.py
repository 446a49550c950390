"""Frame tables: step selection, look-back windows, range corruption, batch losses."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import apply_corruption
from ..plans.lookup import spread
from ..plans.ranks import rank_in_group
from ..plans.scans import halo_window


def sequence_window(frames: DataFrame, keys: Sequence[str], t: str, value: str, length: int, segment: int | None = None) -> DataFrame:
    """``window``: the last ``length`` values ending at t, left-padded with the window's first value."""

    def columns(w):
        got = F.collect_list(value).over(w.rowsBetween(-(length - 1), 0))
        pad = F.array_repeat(F.element_at(got, 1), F.lit(length) - F.size(got))
        return {"window": F.concat(pad, got)}

    return halo_window(frames, keys, t, length - 1, columns, segment)


def rolling_bad_count(df: DataFrame, keys: Sequence[str], t: str, bad: Column, window: int = 50, segment: int | None = None) -> DataFrame:
    return halo_window(
        df, keys, t, window - 1, lambda w: {"bad_run": F.sum(bad.cast("long")).over(w.rowsBetween(-(window - 1), 0))}, segment
    )


def steps_array(total: Column, n: int, min_step: int = 0) -> Column:
    """Evenly spaced step indices (half-to-even rounding, equal neighbours once)."""
    total = total.cast("long")
    start = F.greatest(F.lit(0).cast("long"), F.least(F.lit(min_step).cast("long"), total - 1))
    span = total - start
    count = max(1, n)
    last = F.array(total - 1)
    if count == 1:
        return last
    every = F.sequence(start, total - 1)
    gap = (span - 1) / F.lit(float(count - 1))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.least(total - 1, F.greatest(start, start + F.bround(i * gap).cast("long"))))
    return F.when(span <= 1, last).when(F.lit(count) >= span, every).otherwise(F.array_distinct(spaced))


def select_steps(frames: DataFrame, keys: Sequence[str], t: str, n: int, min_step: int = 0) -> DataFrame:
    """Rows at the selected steps of each stream."""
    sizes = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    want = sizes.select(*keys, F.explode(steps_array(F.col("_n"), n, min_step)).alias(t))
    return frames.join(want, [*keys, t], "left_semi")


def corrupt_range(frames: DataFrame, kind: str, severity: float, start: int, end: int, t: str = "timestep", identity: Sequence[str] = ("episode_id", "timestep"), seed: int = 0) -> DataFrame:
    """Corrupt byte pixels in the inclusive step range and tag rows with kind, severity and range."""
    if end < start:
        raise ValueError("corruption range is empty")
    lo = max(0, start)
    inside = F.col(t).between(lo, end)
    unit = F.transform("pixels", lambda v: v / 255.0)
    bad = apply_corruption(kind, unit, F.lit(float(severity)), F.col("h"), F.col("w"), F.col("channels"), seed, [F.col(c) for c in identity])
    as_bytes = F.transform(bad, lambda v: F.least(F.greatest(F.bround(v * 255.0), F.lit(0.0)), F.lit(255.0)))
    return (
        frames.withColumn("pixels", F.when(inside, as_bytes).otherwise(F.transform("pixels", lambda v: v.cast("double"))))
        .withColumn("corruption", F.when(inside, F.lit(kind)).otherwise(F.lit("none")))
        .withColumn("severity", F.when(inside, F.lit(float(severity))).otherwise(F.lit(0.0)))
        .withColumn("corruption_start", F.lit(lo))
        .withColumn("corruption_end", F.lit(end))
        .withColumn("is_corrupt", inside)
    )


def supcon_by_batch(df: DataFrame, row_id: str, label: str, batch_size: int, z: str = "z", temperature: float = 0.07) -> DataFrame:
    """Supervised-contrastive tightness per batch of ``batch_size`` consecutive rows: ``batch, anchors, loss``.

    A batch has at most ``batch_size`` rows by construction and is one small matrix
    product; batches without positives report NULL.
    """
    if batch_size > 8192:
        raise ValueError("a batch is one matrix; keep it at 8192 rows or fewer")
    ranked = rank_in_group(df.select(row_id, label, z), [], [F.col(row_id)], "_k")
    ranked = ranked.withColumn("batch", F.floor(F.col("_k") / batch_size).cast("long"))

    def loss(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.asarray(v, float) for v in pdf[z]])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        y = pdf[label].to_numpy()
        sim = x @ x.T / temperature
        sim = sim - sim.max(axis=1, keepdims=True)
        off = 1.0 - np.eye(len(x))
        pos = (y[:, None] == y[None, :]) * off
        log_prob = sim - np.log((np.exp(sim) * off).sum(axis=1, keepdims=True) + 1e-12)
        cnt = pos.sum(axis=1)
        has = cnt > 0
        value = -((pos * log_prob).sum(axis=1)[has] / (cnt[has] + 1e-12)).mean() if has.any() else None
        return pd.DataFrame({"batch": [pdf["batch"].iloc[0]], "anchors": [int(has.sum())], "loss": [value]})

    return spread(ranked, "batch").groupBy("batch").applyInPandas(loss, "batch long, anchors int, loss double")
