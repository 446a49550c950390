"""Encoder plug-ins: user callables that turn frames into token or embedding vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# encode(batch) -> list of [n_tokens, D] arrays (or an [n, D] array), and optionally masks.
Encode = Callable[[pd.DataFrame], object]


@dataclass(frozen=True)
class Encoder:
    """A named encoder.  ``encode`` returns tokens, or (tokens, masks).

    ``belief`` optionally returns one extra feature vector per frame and ``extra`` a
    dict of strings per frame.
    """

    name: str
    encode: Encode
    belief: Callable[[pd.DataFrame], np.ndarray] | None = None
    extra: Callable[[pd.DataFrame], list[dict[str, str]]] | None = None


_REGISTRY: dict[str, Encoder] = {}


def register(encoder: Encoder) -> Encoder:
    _REGISTRY[encoder.name] = encoder
    return encoder


def get(name: str) -> Encoder:
    if name not in _REGISTRY:
        raise ValueError(f"unknown encoder {name!r}; registered: {sorted(_REGISTRY)}")
    return _REGISTRY[name]


def names() -> list[str]:
    return sorted(_REGISTRY)


def _tokens_and_masks(result, n: int) -> tuple[list[np.ndarray], list[np.ndarray] | None]:
    tokens, masks = result if isinstance(result, tuple) else (result, None)
    tokens = [np.atleast_2d(np.asarray(t, float)) for t in tokens]
    if len(tokens) != n or any(t.ndim != 2 for t in tokens):
        raise ValueError("an encoder must return one [tokens, width] array per frame")
    if masks is not None:
        masks = [np.asarray(m, bool) for m in masks]
        if len(masks) != n or any(m.shape != (t.shape[0],) for m, t in zip(masks, tokens)):
            raise ValueError("a token mask must match its frame's token count")
    return tokens, masks


def encode_tokens(frames: DataFrame, encoder: Encoder, item: str, columns: list[str]) -> DataFrame:
    """Token rows ``item, token_idx, vec, mask`` (mask NULL when the encoder gives none)."""
    item_type = frames.schema[item].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens, masks = _tokens_and_masks(encoder.encode(pdf), len(pdf))
            counts = [len(t) for t in tokens]
            yield pd.DataFrame(
                {
                    item: np.repeat(pdf[item].to_numpy(), counts),
                    "token_idx": np.concatenate([np.arange(c) for c in counts]) if counts else [],
                    "vec": [v for t in tokens for v in t],
                    "mask": [None] * sum(counts) if masks is None else [bool(b) for m in masks for b in m],
                }
            )

    need = list(dict.fromkeys([item, *columns]))
    return frames.select(*need).mapInPandas(run, f"{item} {item_type}, token_idx int, vec array<double>, mask boolean")


def encode_frames(frames: DataFrame, encoder: Encoder, columns: list[str], keep: list[str], normalize: bool = True) -> DataFrame:
    """Pooled embedding ``z`` per frame, one Arrow batch at a time.

    The batch size is ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.schema.fields if f.name in keep)
    extra = (", belief_features array<double>" if encoder.belief else "") + (", extras map<string,string>" if encoder.extra else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens, masks = _tokens_and_masks(encoder.encode(pdf), len(pdf))
            out = pdf[keep].copy()
            pooled = []
            for i, t in enumerate(tokens):
                m = np.ones(len(t)) if masks is None else masks[i].astype(float)
                v = (t * m[:, None]).sum(axis=0) / max(m.sum(), 1e-6)
                pooled.append(v / max(np.linalg.norm(v), 1e-12) if normalize else v)
            out["z"] = pooled
            if encoder.belief:
                out["belief_features"] = list(np.asarray(encoder.belief(pdf), float))
            if encoder.extra:
                out["extras"] = [list(d.items()) for d in encoder.extra(pdf)]
            yield out

    need = list(dict.fromkeys([*keep, *columns]))
    return frames.select(*need).mapInPandas(run, f"{kept}, z array<double>{extra}")


def encode_all(frames: DataFrame, encoders: list[str], columns: list[str], keep: list[str]) -> DataFrame:
    """Embeddings of several registered encoders, one after another in an ``encoder`` column."""
    out = None
    for name in encoders:
        one = encode_frames(frames, get(name), columns, keep).withColumn("encoder", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("name at least one encoder")
    return out


def channel_mean_encoder(name: str, channels: int = 3, width: int = 64, pixels: str = "pixels") -> Encoder:
    """Deterministic stand-in: channel means times a seeded Gaussian matrix (seed from the name)."""
    seed = sum(ord(c) for c in name) % 10007  # fixed value: seed modulus
    weights = np.random.default_rng(seed).standard_normal((channels, width), dtype=np.float32).astype(float)

    def encode(pdf: pd.DataFrame):
        means = np.stack([np.asarray(p, float).reshape(-1, channels).mean(axis=0) for p in pdf[pixels]]) if len(pdf) else np.zeros((0, channels))
        return [row[None, :] for row in means @ weights]

    return Encoder(name, encode)


# Names of the default zero-shot encoders; users register their own callables under them.
DEFAULT_NAMES = ("clip_vit", "clip_resnet", "biomedclip_vit", "medclip_vit", "medclip_resnet")
