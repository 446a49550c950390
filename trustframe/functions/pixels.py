"""Pixel-array expressions and corruption injection.

An image is one flat ``array<double>`` in (row, column, channel) order with
its height, width and channel count in sibling columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import col

# Supported corruption kinds.
CORRUPTIONS = ("gaussian_noise", "brightness_drop", "center_occlusion", "noise_and_occlusion")


def scale_pixels(px) -> Column:
    return F.transform(col(px), lambda v: v / 255.0)


def _clamp(x, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def channel_normalize(px, mean: list[float], std: list[float]) -> Column:
    """Clamp to [0,1], then centre and scale each interleaved channel."""
    c = len(mean)
    means, stds = F.array(*[F.lit(float(m)) for m in mean]), F.array(*[F.lit(float(s)) for s in std])

    def one(v, i):
        ch = F.pmod(i, F.lit(c)) + 1
        return (_clamp(v, 0, 1) - F.element_at(means, ch)) / F.element_at(stds, ch)

    return F.transform(col(px), one)


def ensure_rgb(px, channels) -> Column:
    """Grey images repeat their channel; values clip to whole bytes; other layouts fail."""
    ch = col(channels)
    wide = F.when(ch == 3, col(px)).when(ch == 1, F.flatten(F.transform(col(px), lambda v: F.array_repeat(v, 3))))
    wide = wide.otherwise(F.raise_error(F.concat(F.lit("unsupported channel count "), ch.cast("string"))))
    return F.transform(wide, lambda v: F.floor(_clamp(v, 0, 255)).cast("int"))


def channel_means(px, channels: int) -> Column:
    def mean_of(c):
        return F.aggregate(
            F.filter(F.transform(col(px), lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda s: s["i"] % channels == c),
            F.lit(0.0),
            lambda a, s: a + s["v"],
        ) / (F.size(col(px)) / channels)

    return F.array(*[mean_of(c) for c in range(channels)])


def severity_clamp(s) -> Column:
    return _clamp(col(s).cast("double"), 0, 1)


def hashed_uniforms(*parts) -> tuple[Column, Column]:
    """Two uniforms in (0,1) from one md5 of the joined parts."""
    h = F.md5(F.concat_ws("|", *[col(p).cast("string") for p in parts]))

    def u(start):
        return (F.conv(F.substring(h, start, 8), 16, 10).cast("double") + 0.5) / 4294967296.0

    return u(1), u(9)


def gaussian_noise(px, severity, seed: int, *identity) -> Column:
    """Add N(0, 0.03 + 0.17 s) per pixel by Box-Muller over hashed uniforms, then clamp."""
    sigma = 0.03 + 0.17 * severity_clamp(severity)

    def one(v, i):
        u1, u2 = hashed_uniforms(F.lit(seed), *identity, i)
        return _clamp(v + sigma * F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2), 0, 1)

    return F.transform(col(px), one)


def brightness_drop(px, severity) -> Column:
    factor = F.greatest(F.lit(0.15), 1.0 - 0.75 * severity_clamp(severity))
    return F.transform(col(px), lambda v: _clamp(v * factor, 0, 1))


def center_occlusion(px, severity, h, w, channels) -> Column:
    """Zero a centred patch whose side grows with severity."""
    frac = F.least(F.lit(0.8), 0.18 + 0.42 * severity_clamp(severity))

    def span(dim):
        size = F.greatest(F.lit(1), F.floor(col(dim) * frac))
        first = F.floor((col(dim) - size) / 2)
        return first, first + size

    top, bottom = span(h)
    left, right = span(w)

    def one(v, i):
        cell = F.floor(i / col(channels))
        r, c = F.floor(cell / col(w)), F.pmod(cell, col(w))
        inside = (r >= top) & (r < bottom) & (c >= left) & (c < right)
        return F.when(inside, F.lit(0.0)).otherwise(v)

    return F.transform(col(px), one)


def apply_corruption(kind: str, px, severity, h, w, channels, seed: int = 0, identity=()) -> Column:
    """One named corruption on [0,1] pixels; severity 0 leaves the image unchanged."""
    if kind == "none":
        return col(px)
    clamped = F.transform(col(px), lambda v: _clamp(v, 0, 1))
    if kind == "gaussian_noise":
        out = gaussian_noise(clamped, severity, seed, *identity)
    elif kind == "brightness_drop":
        out = brightness_drop(clamped, severity)
    elif kind == "center_occlusion":
        out = center_occlusion(clamped, severity, h, w, channels)
    elif kind == "noise_and_occlusion":
        noisy = gaussian_noise(clamped, severity, seed, *identity)
        out = center_occlusion(noisy, F.least(F.lit(1.0), severity_clamp(severity) + 0.1), h, w, channels)
    else:
        raise ValueError(f"unknown corruption {kind!r}; choose one of {CORRUPTIONS}")
    return F.when(severity_clamp(severity) == 0, col(px)).otherwise(out)
