"""Scalar scoring rules, labels and name parsing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import col, vec_sum

# Controller mode names in ordinal order.
MODES = ("clean", "suspect", "persistent", "recovering")

# Target score bands (low, high).
LIDAR_BANDS = {"clean": (0.9, 1.0), "warmup": (0.99, 1.0), 1: (0.6, 0.75), 3: (0.3, 0.5), 5: (0.05, 0.2)}
CAMERA_BANDS = {"clean": (0.95, 1.0), "warmup": (0.99, 1.0), 1: (0.6, 0.7), 3: (0.3, 0.5), 5: (0.05, 0.2)}
# Weights of the final / belief / reference scores in the band penalty.
BAND_WEIGHTS = (1.0, 0.5, 0.25)
# Corruption-length bucket limits.
SHORT_MAX_LEN, MEDIUM_MAX_LEN = 16, 23


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def reliability_a(belief, z, beta: float, bias: float, log_var: list[float] | None = None) -> Column:
    """Belief-versus-evidence reliability; ``log_var`` entries clamp to +-10."""
    sq = F.zip_with(col(z), col(belief), lambda x, b: (x - b) * (x - b))
    if log_var is not None:
        from math import exp

        weights = F.array(*[F.lit(exp(-min(10.0, max(-10.0, v)))) for v in log_var])
        sq = F.zip_with(sq, weights, lambda d, w: d * w)
    return sigmoid(-0.5 * vec_sum(sq) * beta + bias)


def reliability_b(md, temperature: float, bias: float) -> Column:
    return sigmoid(-col(md) / max(float(temperature), 1e-6) + bias)


def score_band(severity, is_corrupt, t, corrupt_start, bands=None) -> Column:
    """struct(low, high): corruption overrides warm-up, warm-up overrides clean."""
    b = bands or LIDAR_BANDS
    sev = col(severity).cast("double")

    def edge(i):
        def lerp(lo, hi, a):
            return (1.0 - a) * b[lo][i] + a * b[hi][i]

        corrupt = (
            F.when(sev <= 1, F.lit(b[1][i]))
            .when(sev >= 5, F.lit(b[5][i]))
            .when(sev <= 3, lerp(1, 3, (sev - 1) / 2))
            .otherwise(lerp(3, 5, (sev - 3) / 2))
        )
        return (
            F.when(col(is_corrupt), corrupt)
            .when(col(t) < col(corrupt_start), F.lit(b["warmup"][i]))
            .otherwise(F.lit(b["clean"][i]))
        )

    return F.struct(edge(0).alias("low"), edge(1).alias("high"))


def band_distance_sq(score, low, high) -> Column:
    below = F.greatest(col(low) - col(score), F.lit(0.0))
    above = F.greatest(col(score) - col(high), F.lit(0.0))
    return below * below + above * above


def length_bucket(n) -> Column:
    return F.when(col(n) <= SHORT_MAX_LEN, "shorter").when(col(n) <= MEDIUM_MAX_LEN, "medium").otherwise("longer")


def severity_block(row_idx, n_clean) -> Column:
    """struct(severity, sample_index) of a row in stacked severity blocks."""
    return F.struct(
        (F.floor(col(row_idx) / col(n_clean)) + 1).cast("int").alias("severity"),
        F.pmod(col(row_idx), col(n_clean)).alias("sample_index"),
    )


def point_id(scope, corruption, severity, sample_index=None) -> Column:
    base = F.format_string("%s|%s|s%d", col(scope).cast("string"), col(corruption).cast("string"), col(severity).cast("int"))
    if sample_index is None:
        return base
    return F.concat(base, F.lit("|i"), col(sample_index).cast("string"))


def parse_frame_name(name) -> Column:
    """struct(stream, sort_key): text before the sensor tag and the zero-padded digits after it."""
    tag = "__LIDAR_TOP__"  # fixed value: sensor tag in frame file names
    n = col(name)
    has_tag = n.contains(tag)
    stream = (
        F.when(has_tag, F.substring_index(n, tag, 1))
        .when(n.contains("__"), F.substring_index(n, "__", 1))
        .otherwise(F.regexp_replace(n, r"(?<=.)\.[^.]*$", ""))
    )
    suffix = F.when(has_tag, F.substring_index(n, tag, -1)).otherwise(n)
    digits = F.regexp_replace(F.regexp_replace(suffix, r"\D", ""), r"^0+", "")
    padded = F.when(F.length(digits) < 20, F.lpad(digits, 20, "0")).otherwise(digits)
    return F.struct(stream.alias("stream"), padded.alias("sort_key"))


def mode_id(mode) -> Column:
    out = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(MODES))):
        out = F.when(col(mode) == name, F.lit(i)).otherwise(out)
    return out


def alarm(suspicious, mode) -> Column:
    return col(suspicious) | (col(mode) != "clean")


def label_phase(t, start, end) -> Column:
    return F.when(col(t) < col(start), "prefix").when(col(t) < col(end), "corrupt").otherwise("recovery")


@dataclass(frozen=True)
class BandWeights:
    final: float = BAND_WEIGHTS[0]
    a: float = BAND_WEIGHTS[1]
    b: float = BAND_WEIGHTS[2]
