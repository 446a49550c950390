"""Column functions on ``array<double>`` vectors (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vec_sum(v) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return vec_sum(F.zip_with(col(a), col(b), lambda x, y: x * y))


def l2_norm(v) -> Column:
    return F.sqrt(vec_sum(F.transform(col(v), lambda x: x * x)))


def l2_normalize(v) -> Column:
    """v divided by its norm, the norm floored at 1e-12."""
    return F.transform(col(v), lambda x: x / F.greatest(l2_norm(v), F.lit(1e-12)))


def align_dim(v, k: int) -> Column:
    """Cut to ``k`` entries or pad with zeros on the right."""
    return F.slice(F.concat(col(v), F.array_repeat(F.lit(0.0), k)), 1, k)


def delta(clean, corrupt) -> Column:
    return F.zip_with(col(corrupt), col(clean), lambda x, y: x - y)


def fuse(a, b, k: int | None = None) -> Column:
    """Concatenate two encoders' vectors, optionally aligned to width ``k``."""
    both = F.concat(col(a), col(b))
    return both if k is None else align_dim(both, k)


def l2_distance(a, b) -> Column:
    return F.sqrt(vec_sum(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y))))


def cosine_distance(a, b) -> Column:
    """1 - cosine; 1.0 when a norm product vanishes."""
    den = l2_norm(a) * l2_norm(b)
    return F.when(den <= 1e-12, F.lit(1.0)).otherwise(1.0 - dot(a, b) / den)


def anchor_distance(v, anchor) -> Column:
    """L2 distance to an anchor vector, NULL while the anchor is missing."""
    return F.when(col(anchor).isNotNull(), l2_distance(v, anchor))


def mahalanobis_diag_sq(v, mu, var) -> Column:
    """Squared Mahalanobis distance under a diagonal covariance."""
    parts = F.zip_with(F.zip_with(col(v), col(mu), lambda x, m: (x - m) * (x - m)), col(var), lambda d, s: d / s)
    return vec_sum(parts)


def jaccard(a, b) -> Column:
    """Shared share of two sets; two empty sets count as identical."""
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(col(a), col(b))) / union)


def topk_dims(v, k: int) -> Column:
    """Positions of the ``k`` largest magnitudes; ties go to the smaller position."""
    keyed = F.transform(col(v), lambda x, i: F.struct((-F.abs(x)).alias("m"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["i"])


def is_finite(x) -> Column:
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def all_finite(v) -> Column:
    return F.forall(col(v), lambda x: is_finite(x))


def vec_mean(v) -> Column:
    return vec_sum(v) / F.size(col(v))


def vec_std_pop(v) -> Column:
    """Population deviation of a vector's own entries."""
    return F.sqrt(vec_sum(F.transform(col(v), lambda x: (x - vec_mean(v)) * (x - vec_mean(v)))) / F.size(col(v)))
