"""Distribution fitting: group means, moments, covariance, precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lookup import spread
from ..plans.tiles import matrix, vectors

PARTIALS = 64


def mean_vector(df: DataFrame, keys: Sequence[str], z: str = "z", name: str = "mu") -> DataFrame:
    """Element-wise mean per group in one map-side-combined pass."""
    return df.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector(z))).alias(name))


def mean_var(df: DataFrame, keys: Sequence[str], z: str = "z") -> DataFrame:
    """Per group: ``n``, ``mu`` and unbiased per-dimension ``var``."""
    s = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(z)).alias("_s")
    return df.groupBy(*keys).agg(s).select(
        *keys,
        F.col("_s.count").alias("n"),
        vector_to_array("_s.mean").alias("mu"),
        vector_to_array("_s.variance").alias("var"),
    )


def key_ddl(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)


# Values of row-wise outer products held at once.
OUTER_VALUES = 2_000_000


def _codes(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """A number per row that is equal where all keys are; NULL equals NULL."""
    out = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        own = batch.column(batch.schema.get_field_index(k)).dictionary_encode("encode").indices.to_numpy()
        out = np.unique(np.stack([out, own]), axis=1, return_inverse=True)[1].ravel() if out.any() else own.astype(np.int64)
    return out


def _runs(n: np.ndarray, mu: np.ndarray, q: np.ndarray | None, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge neighbouring partials (n, mu, q) of each run that begins at ``starts``; without ``q`` they are single rows."""
    ends = np.append(starts[1:], len(n))
    total = np.add.reduceat(n, starts)
    mean = np.add.reduceat(mu * n[:, None], starts) / total[:, None]
    dev = (mu - np.repeat(mean, ends - starts, axis=0)) * np.sqrt(n)[:, None]
    d = mu.shape[1]
    m2 = np.zeros((len(starts), d * d)) if q is None else np.add.reduceat(q, starts)
    if len(starts) * 16 < len(n):  # long runs: one product each
        for i, (lo, hi) in enumerate(zip(starts, ends)):
            m2[i] += (dev[lo:hi].T @ dev[lo:hi]).ravel()
        return total, mean, m2
    run = np.repeat(np.arange(len(starts)), ends - starts)
    step = max(1, OUTER_VALUES // (d * d))
    for lo in range(0, len(n), step):
        part, own = dev[lo : lo + step], run[lo : lo + step]
        at = np.flatnonzero(np.diff(own, prepend=-1))
        m2[own[at]] += np.add.reduceat((part[:, :, None] * part[:, None, :]).reshape(len(part), -1), at)
    return total, mean, m2


def moments(df: DataFrame, keys: Sequence[str] = (), z: str = "z") -> DataFrame:
    """Per group: ``n``, ``mu`` and the flattened centred D x D second moment ``m2``.

    Tasks emit one combined partial per group and batch they see; partials merge through ``PARTIALS``
    intermediate groups, so no task receives more than its share.  Each merge walks its sorted rows with
    many groups at a time, so groups may be as many as rows.
    """
    keys = list(keys)
    names = [*keys, "n", "mu", "m2"]

    def table(source: pa.RecordBatch, at: np.ndarray, n, mu, m2) -> pa.RecordBatch:
        own = source.take(pa.array(at))
        cols = [own.column(own.schema.get_field_index(k)) for k in keys]
        return pa.RecordBatch.from_arrays([*cols, pa.array(n.astype(np.int64)), vectors(mu), vectors(m2)], names=names)

    def partial(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = matrix(batch.column(batch.schema.get_field_index(z))).astype(float)
            rows = max(1024, 4 * OUTER_VALUES // max(1, whole.shape[1] ** 2))  # a row may be a group of its own
            for lo in range(0, len(whole), rows):
                own, x = batch.slice(lo, rows), whole[lo : lo + rows]
                code = _codes(own, keys)
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.diff(code[order], prepend=-1))
                yield table(own, order[starts], *_runs(np.ones(len(x)), x[order], None, starts))

    def combine(batches):
        held = None  # the last group may go on in the next batch
        for batch in batches:
            batch = batch.select(names)
            if not batch.num_rows:
                continue
            if held is not None:
                both = pa.Table.from_batches([held, batch.cast(held.schema)]).combine_chunks()
                batch = both.to_batches()[0]
            starts = np.flatnonzero(np.diff(_codes(batch, keys), prepend=-1))
            n = batch.column("n").to_numpy().astype(float)
            got = table(batch, starts, *_runs(n, matrix(batch.column("mu")), matrix(batch.column("m2")), starts))
            held = got.slice(got.num_rows - 1)
            if got.num_rows > 1:
                yield got.slice(0, got.num_rows - 1)
        if held is not None:
            yield held

    ddl = key_ddl(df, keys) + "n long, mu array<double>, m2 array<double>"
    parts = df.select(*keys, z).mapInArrow(partial, ddl)
    part = F.pmod(F.spark_partition_id(), F.lit(PARTIALS))
    if not keys:
        half = parts.withColumn("_p", part).repartition("_p").mapInArrow(combine, ddl)
        return half.coalesce(1).mapInArrow(combine, ddl)  # a row per task
    salted = parts.withColumn("_p", part)
    half = spread(salted, *keys, "_p").sortWithinPartitions(*keys).mapInArrow(combine, ddl)
    return spread(half, *keys).sortWithinPartitions(*keys).mapInArrow(combine, ddl)


def fit_clean_reference(
    df: DataFrame, z: str = "z", shrinkage: float = 0.01, eps: float = 1e-5, keys: Sequence[str] = ()
) -> DataFrame:
    """Mean, regularised covariance and precision of clean rows (globally or per key).

    cov = (1 - s) * sample cov + s * its diagonal + eps * I.  Fewer than two rows fail.
    """
    if not 0.0 <= shrinkage <= 1.0:
        raise ValueError("shrinkage must lie in [0, 1]")
    if eps <= 0:
        raise ValueError("eps must be positive")
    keys = list(keys)

    def finish(batches):
        for pdf in batches:
            covs, precs = [], []
            for n, mu, m2 in zip(pdf["n"], pdf["mu"], pdf["m2"]):
                if n < 2:
                    raise ValueError("a clean reference needs at least 2 rows")
                d = len(mu)
                s = np.asarray(m2).reshape(d, d) / (n - 1)
                cov = (1 - shrinkage) * s + shrinkage * np.diag(np.diag(s)) + eps * np.eye(d)
                covs.append(cov.tolist())
                precs.append(np.linalg.inv(cov).tolist())
            yield pdf[keys].assign(n=pdf["n"], dim=[len(m) for m in pdf["mu"]], mu=pdf["mu"], cov=covs, precision=precs)

    ddl = key_ddl(df, keys) + "n long, dim int, mu array<double>, cov array<array<double>>, precision array<array<double>>"
    return moments(df, keys, z).mapInPandas(finish, ddl)


def clean_prefix_fit(df: DataFrame, t: str, prefix: int, z: str = "z", keys: Sequence[str] = (), **kw) -> DataFrame:
    """Clean reference of the first ``prefix`` (at least 1) steps, per key or overall."""
    return fit_clean_reference(df.where(F.col(t) < max(1, prefix)), z, keys=keys, **kw)


def fit_family_model(df: DataFrame, family: str = "family", z: str = "z", diag: bool = True, eps: float = 1e-4) -> DataFrame:
    """One Gaussian per family; a single-row family takes unit variance."""
    if eps <= 0:
        raise ValueError("eps must be positive")
    if diag:
        stats = mean_var(df, [family], z)
        var = F.when(F.col("n") >= 2, F.transform("var", lambda v: v + eps)).otherwise(
            F.transform("var", lambda v: F.lit(1.0 + eps))
        )
        out = stats.select(family, "n", "mu", var.alias("var"))
        for c in ("cov", "precision"):
            out = out.withColumn(c, F.lit(None).cast("array<array<double>>"))
    else:

        def finish(batches):
            for pdf in batches:
                rows = []
                for n, mu, m2 in zip(pdf["n"], pdf["mu"], pdf["m2"]):
                    d = len(mu)
                    cov = (np.asarray(m2).reshape(d, d) / (n - 1) if n >= 2 else np.eye(d)) + eps * np.eye(d)
                    rows.append((np.diag(cov).copy(), cov.tolist(), np.linalg.inv(cov).tolist()))
                yield pdf[[family, "n", "mu"]].assign(
                    var=[r[0] for r in rows], cov=[r[1] for r in rows], precision=[r[2] for r in rows]
                )

        ddl = key_ddl(df, [family]) + "n long, mu array<double>, var array<double>, cov array<array<double>>, precision array<array<double>>"
        out = moments(df, [family], z).mapInPandas(finish, ddl)
    return with_model_meta(out, diag, eps)


def with_model_meta(model: DataFrame, diag: bool, eps: float, threshold: float | None = None, source: str = "unset") -> DataFrame:
    return (
        model.withColumn("diag", F.lit(diag))
        .withColumn("eps", F.lit(float(eps)))
        .withColumn("unseen_threshold", F.lit(threshold).cast("double"))
        .withColumn("threshold_source", F.lit(source))
    )


def enroll_family(
    model: DataFrame, family_id, deltas: DataFrame, family: str = "family", z: str = "z",
    allow_update: bool = True, diag: bool | None = None, eps: float | None = None,
) -> DataFrame:
    """Refit one family and replace or append it; diag/eps become model-wide; sorted by id.

    With ``allow_update=False`` an existing id fails.
    """
    if diag is None or eps is None:
        meta = model.select("diag", "eps").first()
        diag, eps = meta["diag"] if diag is None else diag, meta["eps"] if eps is None else eps
    fid = F.lit(family_id).cast(model.schema[family].dataType)
    new = fit_family_model(deltas.withColumn(family, fid), family, z, diag, eps)
    if not allow_update and model.where(F.col(family) == fid).limit(1).count():
        raise ValueError(f"family {family_id} already exists and updates are not allowed")
    kept = model.where(F.col(family) != fid).withColumn("diag", F.lit(diag)).withColumn("eps", F.lit(float(eps)))
    fresh = new.drop("unseen_threshold", "threshold_source")
    meta = model.agg(F.first("unseen_threshold").alias("unseen_threshold"), F.first("threshold_source").alias("threshold_source"))
    fresh = fresh.withColumn("unseen_threshold", meta.select("unseen_threshold").scalar()).withColumn(
        "threshold_source", meta.select("threshold_source").scalar()
    )
    return kept.unionByName(fresh).orderBy(family)


def few_shot_registry(df: DataFrame, family: str = "family", z: str = "z") -> DataFrame:
    """Prototype per family; per-dimension variance only from 10 shots on."""
    return mean_var(df, [family], z).select(
        F.col(family).cast("string").alias("family"),
        F.col("mu").alias("prototype"),
        F.when(F.col("n") >= 10, F.col("var")).alias("diag_var"),
        F.col("n").cast("int").alias("num_shots"),
    )
