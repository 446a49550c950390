"""Scans along a dense step column that split long streams into segments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lookup import spread
from .tiles import matrix, vectors

SEGMENT = 65_536
BELIEF_SEGMENT = 1 << 20


def segment_of(t: str, size: int | None = None) -> Column:
    size = size or SEGMENT
    return F.floor(F.col(t) / size).cast("long")


def prefix_agg(
    df: DataFrame, keys: Sequence[str], t: str, items: dict[str, tuple[Callable, Column]], size: int | None = None
) -> DataFrame:
    """Running aggregates (``F.sum`` / ``F.max`` / ``F.min``) up to and including each row.

    Segment totals are scanned first (one row per segment), then each segment
    runs its own window and adds its carry.
    """
    keys = list(keys)
    d = df.withColumn("_s", segment_of(t, size))
    for name, (_, expr) in items.items():
        d = d.withColumn(f"_x_{name}", expr)
    seg = d.groupBy(*keys, "_s").agg(*[op(f"_x_{n}").alias(f"_g_{n}") for n, (op, _) in items.items()])
    before = W.partitionBy(*keys).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    carry = seg.select(*keys, "_s", *[op(f"_g_{n}").over(before).alias(f"_c_{n}") for n, (op, _) in items.items()])
    run = W.partitionBy(*keys, "_s").orderBy(t).rowsBetween(W.unboundedPreceding, 0)
    out = d.join(carry, [*keys, "_s"])
    for n, (op, _) in items.items():
        here, past = op(f"_x_{n}").over(run), F.col(f"_c_{n}")
        if op is F.sum:
            both = F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0))
        else:
            both = (F.greatest if op is F.max else F.least)(here, past)
        out = out.withColumn(n, both)
    return out.drop("_s", *[f"_x_{n}" for n in items], *[f"_c_{n}" for n in items])


def halo_window(
    df: DataFrame, keys: Sequence[str], t: str, lookback: int, columns: Callable[[object], dict[str, Column]], size: int | None = None
) -> DataFrame:
    """Evaluate bounded look-back window columns.

    ``columns(window)`` builds the expressions over the ordered window.  The last
    ``lookback`` rows of a segment are copied into the next one, so every frame is
    complete inside its own segment.
    """
    size = max(size or SEGMENT, lookback, 1)
    own = segment_of(t, size)
    tail = F.pmod(F.col(t), F.lit(size)) >= size - lookback
    d = df.withColumn("_s", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))))
    window = W.partitionBy(*keys, "_s").orderBy(t)
    for name, expr in columns(window).items():
        d = d.withColumn(name, expr)
    return d.where(F.col("_s") == own).drop("_s")


def linear_scan(decay: np.ndarray, drive: np.ndarray) -> np.ndarray:
    """Rows of b_i = decay_i b_(i-1) + drive_i; ``decay`` is 0 where a run starts.

    Pairs (decay, drive) compose associatively: each step joins every pair with the one
    that ends ``reach`` rows before it, until no pair depends on an earlier row.
    """
    a, b, reach = decay.copy(), drive.copy(), 1
    while reach < len(a) and a[reach:].any():
        b[reach:] += a[reach:, None] * b[:-reach]  # the right side is complete before it is added
        a[reach:] = a[reach:] * a[:-reach]
        reach *= 2
    return b


def belief_scan(
    df: DataFrame, keys: Sequence[str], t: str, z: str, alpha: float, frozen: Column | None = None, size: int | None = None
) -> DataFrame:
    """Exponential belief: before-row value ``belief`` and after-row value ``belief_next``.

    b0 is the stream's first vector and the first row updates it with itself;
    rows marked ``frozen`` leave the belief unchanged.  Rows are sorted once and scanned
    batch by batch with one carried vector.  Streams longer than a segment are split:
    a segment is summarised by (decay, drive), summaries are chained (a row per segment),
    and the segments run on their own from their start values.  Other columns pass through.
    """
    keys = list(keys)
    size = size or BELIEF_SEGMENT
    d = df.withColumn("_s", segment_of(t, size)).withColumn("_f", F.coalesce(frozen, F.lit(False)) if frozen is not None else F.lit(False))
    d = d.withColumn("_g", F.xxhash64(*keys, "_s"))
    if d.where(F.col("_s") > 0).isEmpty():
        return _replay(d.withColumn("_start", F.lit(None).cast("array<double>")), df, keys, t, z, alpha)

    summary = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)
    live_rows = _sorted(d.select(*keys, "_s", "_g", t, z, "_f"), keys, t)
    seg = live_rows.mapInArrow(lambda batches: _summaries(batches, keys, z, alpha), f"{summary}, _s long, decay double, drive array<double>, head array<double>")

    def chain(batches):
        current, b = None, None
        for pdf in batches:
            starts = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    current, b = key, np.asarray(row.head, dtype=float)
                starts.append(b)
                b = row.decay * b + np.asarray(row.drive, dtype=float)
            out = pdf[keys + ["_s"]].copy()
            out["_start"] = starts
            yield out

    starts = (
        seg.repartition(*keys).sortWithinPartitions(*keys, "_s").mapInPandas(chain, f"{summary}, _s long, _start array<double>")
    )
    return _replay(d.join(starts, [*keys, "_s"]), df, keys, t, z, alpha)


def _sorted(d: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    return spread(d, *keys, "_s").sortWithinPartitions(*keys, "_s", t)


def _runs(batches, z: str):
    """Batches with their vectors, live flags and the flag of rows that start a segment (not continued from the batch before)."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column("_g").to_numpy()
        first = np.concatenate([[last is None or g[0] != last], g[1:] != g[:-1]])
        last = g[-1]
        yield batch, matrix(batch.column(z)), ~batch.column("_f").to_numpy(zero_copy_only=False), first


def _replay(d: DataFrame, df: DataFrame, keys: Sequence[str], t: str, z: str, alpha: float) -> DataFrame:
    """Run every segment from ``_start``, or from the stream's own first vector where that is NULL."""
    names = df.columns

    def run(batches):
        carry = None
        for batch, x, live, first in _runs(batches, z):
            at = np.nonzero(first)[0]
            given = batch.column("_start").take(pa.array(at))
            start = x[at].copy()
            some = given.is_valid().to_numpy(zero_copy_only=False)
            if some.any():
                start[some] = matrix(given.filter(pa.array(some)))
            decay = np.where(live, alpha, 1.0)
            drive = np.where(live, 1 - alpha, 0.0)[:, None] * x
            drive[at] += decay[at, None] * start
            decay[at] = 0.0
            if not first[0]:
                drive[0] += decay[0] * carry
                decay[0] = 0.0
            after = linear_scan(decay, drive)
            before = np.concatenate([after[:1] if carry is None else carry[None, :], after[:-1]])
            before[at] = start
            carry = after[-1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], vectors(before), vectors(after)], [*names, "belief", "belief_next"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return _sorted(d, keys, t).mapInArrow(run, f"{schema}, belief array<double>, belief_next array<double>")


def _summaries(batches, keys: Sequence[str], z: str, alpha: float):
    """One row per segment: its keys, decay, drive (the belief it adds to a zero start) and first vector."""
    held, n_live, drive_end, head = None, 0, None, None

    def done():
        cols = [held.column(k) for k in [*keys, "_s"]]
        return pa.RecordBatch.from_arrays([*cols, pa.array([float(alpha**n_live)]), vectors(drive_end[None, :]), vectors(head[None, :])], [*keys, "_s", "decay", "drive", "head"])

    for batch, x, live, first in _runs(batches, z):
        decay = np.where(live, alpha, 1.0)
        drive = np.where(live, 1 - alpha, 0.0)[:, None] * x
        decay[first] = 0.0
        if not first[0]:
            drive[0] += decay[0] * drive_end
            decay[0] = 0.0
        after = linear_scan(decay, drive)
        edges = [*np.nonzero(first)[0].tolist(), len(x)]
        n_live += int(live[: edges[0]].sum())
        if edges[0]:
            drive_end = after[edges[0] - 1]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if held is not None:
                yield done()
            held, head, n_live, drive_end = batch.slice(lo, 1), x[lo], int(live[lo:hi].sum()), after[hi - 1]
    if held is not None:
        yield done()
