"""Scoring vectors against clean references, family models and registries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.vectors import is_finite
from ..plans.ranks import exact_quantiles, rank_in_group
from ..plans.tiles import cross_tiles, matrix, vectors
from ..session import materialize

# A model of at most this many numbers is shipped to every task; larger ones are joined block by block.
INLINE_VALUES = 4_000_000
LABEL_BLOCK_VALUES = 500_000


def mahalanobis_full(z: str, stats: DataFrame) -> Column:
    """Squared Mahalanobis distance of ``z`` to a one-row clean reference."""
    row = stats.select("mu", "precision").first()
    mu, prec = np.asarray(row["mu"]), np.asarray(row["precision"])

    @arrow_udf("double")
    def md(v: pa.Array) -> pa.Array:
        x = matrix(v) - mu
        return pa.array(np.einsum("ij,ij->i", x @ prec, x) if len(v) else [], pa.float64())

    return md(F.col(z))


def diag_distances(x: np.ndarray, mu: np.ndarray, var: np.ndarray) -> np.ndarray:
    """[n, F] squared Mahalanobis distances under diagonal covariances."""
    out = np.empty((len(x), len(mu)))
    for f in range(len(mu)):
        d = x - mu[f]
        out[:, f] = (d * d) @ (1.0 / var[f])
    return out


def full_distances(x: np.ndarray, mu: np.ndarray, prec: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(mu)))
    for f in range(len(mu)):
        d = x - mu[f]
        out[:, f] = np.einsum("ij,ij->i", d @ prec[f], d)
    return out


def cosine_to(x: np.ndarray, proto: np.ndarray) -> np.ndarray:
    den = np.maximum(np.linalg.norm(x, axis=1)[:, None], 1e-8) * np.maximum(np.linalg.norm(proto, axis=1)[None, :], 1e-8)
    return 1.0 - (x @ proto.T) / den


def l2_to(x: np.ndarray, proto: np.ndarray) -> np.ndarray:
    return np.sqrt(diag_distances(x, proto, np.ones_like(proto)))


def nearest_of_table(
    df: DataFrame,
    table: DataFrame,
    label: str,
    columns: list[str],
    kernel: Callable[..., np.ndarray],
    z: str = "z",
    row_id: str = "vec_id",
    inline_values: int | None = None,
) -> DataFrame:
    """Add ``pred`` and ``min_d``: the table row at the smallest ``kernel`` distance, smaller label first.

    ``kernel(X, *stacked columns) -> [n, F]``.  The table is counted: up to
    ``inline_values`` numbers it travels inside the scoring function (one scan, no
    shuffle); beyond that both sides meet in bounded tiles and minima are merged.
    """
    shape = table.select(*[F.flatten(c) if "array<array" in table.schema[c].dataType.simpleString() else F.col(c) for c in columns])
    width = shape.select(sum((F.size(c) for c in shape.columns), F.lit(0)).alias("w")).first()
    rows = table.count()
    label_type = table.schema[label].dataType.simpleString()
    if width is not None and rows * width["w"] <= (INLINE_VALUES if inline_values is None else inline_values):
        local = table.select(label, *columns).orderBy(label).collect()
        names = [r[label] for r in local]
        arrays = [np.asarray([r[c] for r in local]) for c in columns]

        @arrow_udf(f"struct<pred:{label_type},min_d:double>")
        def score(v: pa.Array) -> pa.Array:
            d = kernel(matrix(v), *arrays) if len(v) else np.zeros((0, len(names)))
            best = d.argmin(axis=1) if len(v) else np.zeros(0, int)
            found = [pa.array([names[i] for i in best]), pa.array(d[np.arange(len(v)), best], pa.float64())]
            return pa.StructArray.from_arrays(found, ["pred", "min_d"])

        return df.withColumn("_s", score(F.col(z))).withColumn("pred", F.col("_s.pred")).withColumn("min_d", F.col("_s.min_d")).drop("_s")

    # Own row numbers: ids may be NULL or repeat.  Stored, as both uses must see the same numbers.
    df = materialize(df.withColumn("_row", F.monotonically_increasing_id()))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows == 0 or b.num_rows == 0:
            return pa.table({"rid": a.column("rid").slice(0, 0), "pred": b.column("lab").slice(0, 0), "min_d": pa.array([], pa.float64())})
        order = np.argsort(np.asarray(b.column("lab").to_pylist(), dtype=object), kind="stable")
        b = b.take(pa.array(order))
        stacked = [np.asarray(b.column(c).to_pylist()) for c in columns]
        d = kernel(matrix(a.column("zz")), *stacked)
        best = d.argmin(axis=1)
        return pa.table(
            {"rid": a.column("rid"), "pred": b.column("lab").take(pa.array(best)), "min_d": pa.array(d[np.arange(len(best)), best])}
        )

    left = df.select(F.col("_row").alias("rid"), F.col(z).alias("zz"))
    right = table.select(F.col(label).alias("lab"), *columns)
    partial = cross_tiles(left, right, "rid", "lab", tile, f"rid long, pred {label_type}, min_d double")
    best = partial.groupBy("rid").agg(F.min(F.struct("min_d", "pred")).alias("b"))
    best = best.select(F.col("rid").alias("_row"), F.col("b.pred").alias("pred"), F.col("b.min_d").alias("min_d"))
    return df.join(best, "_row", "left").drop("_row")


def nearest_family(df: DataFrame, model: DataFrame, family: str = "family", z: str = "z", row_id: str = "vec_id",
                   diag: bool = True, threshold: float | None = None, inline_values: int | None = None) -> DataFrame:
    """Closest family by Mahalanobis distance, and ``is_unseen`` when it lies beyond the threshold."""
    kernel, second = (diag_distances, "var") if diag else (full_distances, "precision")
    scored = nearest_of_table(df, model, family, ["mu", second], kernel, z, row_id, inline_values)
    return with_unseen(scored, threshold)


def classify_few_shot(df: DataFrame, registry: DataFrame, metric: str = "cosine", threshold: float | None = 0.2,
                      z: str = "z", row_id: str = "vec_id", inline_values: int | None = None) -> DataFrame:
    """Closest prototype by cosine or Euclidean distance, with the open-set flag."""
    kernels = {"cosine": cosine_to, "euclidean": l2_to}
    if metric not in kernels:
        raise ValueError(f"unsupported distance metric: {metric}")
    scored = nearest_of_table(df, registry, "family", ["prototype"], kernels[metric], z, row_id, inline_values)
    return with_unseen(scored, threshold)


def with_unseen(scored: DataFrame, threshold: float | None) -> DataFrame:
    flag = F.lit(False) if threshold is None else F.col("min_d") > threshold
    return scored.withColumn("is_unseen", flag)


def finite_only(df: DataFrame, column: str) -> DataFrame:
    return df.where(is_finite(column))


def calibrate_unseen(scored: DataFrame, pct: float = 99.0, column: str = "min_d") -> DataFrame:
    """One row ``unseen_threshold``: exact interpolated percentile of the finite distances; none left fails."""
    if not 0 < pct < 100:
        raise ValueError("percentile must lie in (0, 100)")
    q = exact_quantiles(finite_only(scored, column), column, [pct / 100.0])
    worst = F.when(F.count("value") == 0, F.raise_error(F.lit("no finite distances to calibrate on")).cast("double"))
    return q.agg(worst.otherwise(F.first("value")).alias("unseen_threshold"))


def zero_shot(df: DataFrame, labels: DataFrame, label: str = "label", label_vec: str = "vec", z: str = "z",
              max_values: int | None = None) -> DataFrame:
    """Softmax over normalised dot products with every label vector: ``probs`` by label order, ``pred``, ``prob``.

    Equal scores go to the smaller label.  A label table of at most ``max_values`` numbers
    (counted) goes to every task.  A larger one is cut into blocks in label order; each block
    gives a row's largest score, its sum of exponentials relative to it and the scores, and
    blocks are merged by the largest score of all, so any number of labels comes out right.
    """
    limit = INLINE_VALUES if max_values is None else max_values
    shape = labels.agg(F.sum(F.size(label_vec)).alias("v"), F.max(F.size(label_vec)).alias("w")).first()
    label_type = labels.schema[label].dataType.simpleString()
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    if (shape["v"] or 0) <= limit:
        local = labels.select(label, label_vec).orderBy(label).collect()
        names = [r[label] for r in local]
        w = unit(np.asarray([r[label_vec] for r in local]))

        @arrow_udf(f"struct<probs:array<double>,pred:{label_type},prob:double>")
        def score(v: pa.Array) -> pa.Array:
            s = unit(matrix(v)) @ w.T if len(v) else np.zeros((0, len(names)))
            e = np.exp(s - s.max(axis=1, keepdims=True)) if len(v) else s
            p = e / e.sum(axis=1, keepdims=True) if len(v) else s
            best = p.argmax(axis=1) if len(v) else np.zeros(0, int)
            found = [vectors(p), pa.array([names[i] for i in best]), pa.array(p[np.arange(len(v)), best], pa.float64())]
            return pa.StructArray.from_arrays(found, ["probs", "pred", "prob"])

        out = df.withColumn("_s", score(F.col(z)))
        return out.select(*df.columns, "_s.probs", "_s.pred", "_s.prob")

    # Own row numbers: ids may be NULL or repeat.  Stored, as both uses must see the same numbers.
    df = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    per_block = max(1, LABEL_BLOCK_VALUES // shape["w"])
    ranked = rank_in_group(labels.select(F.col(label).alias("lab"), F.col(label_vec).alias("vec")), [], [F.col("lab")], "at")
    ranked = ranked.withColumn("part", F.floor(F.col("at") / per_block).cast("int"))
    schema = f"rid long, part int, m double, total double, lab {label_type}, scores array<double>"

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        kinds = [("rid", pa.int64()), ("part", pa.int32()), ("m", pa.float64()), ("total", pa.float64()), ("lab", b.schema.field("lab").type), ("scores", pa.list_(pa.float64()))]
        if not a.num_rows or not b.num_rows:
            return pa.schema(kinds).empty_table()
        b = b.sort_by("at")
        s = unit(matrix(a.column("zz"))) @ unit(matrix(b.column("vec"))).T
        best = s.argmax(axis=1)
        top = s[np.arange(len(s)), best]
        cols = [a.column("rid"), pa.array(np.full(len(s), b.column("part")[0].as_py(), np.int32)), pa.array(top), pa.array(np.exp(s - top[:, None]).sum(axis=1))]
        return pa.Table.from_arrays([*cols, b.column("lab").take(pa.array(best)), vectors(s)], schema=pa.schema(kinds))

    left = df.select(F.col("_row").alias("rid"), F.col(z).alias("zz"))
    blocks = -(-ranked.count() // per_block)
    parts = materialize(cross_tiles(left, ranked, "rid", "at", tile, schema, right_block=(F.col("part"), blocks)))
    peak = parts.groupBy("rid").agg(F.max("m").alias("peak"))
    j = parts.join(peak, "rid")
    # a list per row of as many scores as there are labels: the length of its result
    merged = j.groupBy("rid").agg(
        F.sum(F.col("total") * F.exp(F.col("m") - F.col("peak"))).alias("all"), F.first("peak").alias("peak"),
        F.min(F.when(F.col("m") == F.col("peak"), F.struct("part", "lab")))["lab"].alias("pred"),
        F.array_sort(F.collect_list(F.struct("part", "scores"))).alias("lists"),
    )
    scores = F.flatten(F.transform("lists", lambda x: x["scores"]))
    out = merged.select(
        F.col("rid").alias("_row"), F.transform(scores, lambda s: F.exp(s - F.col("peak")) / F.col("all")).alias("probs"), "pred", (1 / F.col("all")).alias("prob")
    )
    return df.join(out, "_row", "left").drop("_row")


def project(z: str, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray | None = None, b2: np.ndarray | None = None) -> Column:
    """Linear layer, or Linear -> GELU (erf form) -> Linear; dropout is off at inference."""
    from math import erf

    gelu_erf = np.vectorize(erf, otypes=[float])

    @arrow_udf("array<double>")
    def apply(v: pa.Array) -> pa.Array:
        if len(v) == 0:
            return pa.array([], pa.list_(pa.float64()))
        y = matrix(v) @ np.asarray(w1).T + b1
        if w2 is not None:
            y = y * 0.5 * (1.0 + gelu_erf(y / np.sqrt(2.0)))
            y = y @ np.asarray(w2).T + b2
        return vectors(y)

    return apply(F.col(z))
