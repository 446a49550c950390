"""Readers for binary point files, episode archives and labelled image archives.

Every reader scans ``binaryFile`` rows (one file per row) and decodes inside tasks;
archives are never unpickled.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import parse_frame_name
from .archives import member_lengths, read_image_archives, text_array

# Point feature widths tried in order when the preferred one does not divide.
FEATURE_DIMS = (5, 4, 6, 3)
# Fixed value: default clean prefix of an episode archive.
CLEAN_PREFIX = 50
ROWS_PER_FRAME = 4096


def binary_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def infer_feature_dim(length: int, preferred: int) -> int:
    for d in ((preferred,) if preferred > 0 else ()) + FEATURE_DIMS:
        if length % d == 0:
            return d
    raise ValueError(f"no feature width divides a file of {length} values")


def read_lidar_bin(spark: SparkSession, path: str, feature_dim: int = 5) -> DataFrame:
    """``name, stream, sort_key, point_idx, x, y, z, feats`` from flat float32 files.

    Points are aligned to ``feature_dim`` values (cut or zero-padded).
    """
    files = binary_files(spark, path, "*.bin").select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                flat = np.frombuffer(content, dtype="<f4")
                if flat.size == 0:
                    raise ValueError(f"{name}: empty point file")
                pts = flat.reshape(-1, infer_feature_dim(flat.size, feature_dim)).astype(float)
                out = np.zeros((len(pts), max(feature_dim, 3)))
                w = min(out.shape[1], pts.shape[1])
                out[:, :w] = pts[:, :w]
                for lo in range(0, len(out), ROWS_PER_FRAME):
                    part = out[lo : lo + ROWS_PER_FRAME]
                    yield pd.DataFrame(
                        {"name": name, "point_idx": np.arange(lo, lo + len(part)), "x": part[:, 0], "y": part[:, 1], "z": part[:, 2], "feats": list(part[:, 3:])}
                    )

    pts = files.mapInPandas(decode, "name string, point_idx long, x double, y double, z double, feats array<double>")
    parsed = pts.withColumn("_p", parse_frame_name("name"))
    return parsed.select("name", "_p.stream", "_p.sort_key", "point_idx", "x", "y", "z", "feats")


def read_episode_npz(spark: SparkSession, path: str, pattern: str = "*.npz") -> DataFrame:
    """``path, stream, timestep, frame_name, clean_prefix, point_idx, x, y, z, feats`` from episode archives.

    ``points`` must be rank 3.  Missing fields default.  ``frame_names`` stored as objects are read without
    unpickling; an archive whose names hold anything but text is refused.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as npz:
                    pts = np.asarray(npz["points"], float)
                    if pts.ndim != 3:
                        raise ValueError(f"{file}: points must have rank 3, got {pts.ndim}")
                    prefix = int(npz["clean_prefix"]) if "clean_prefix" in npz.files else CLEAN_PREFIX
                    stream = str(npz["stream_name"]) if "stream_name" in npz.files else "unknown"
                names = []
                with zipfile.ZipFile(io.BytesIO(content)) as members:
                    if "frame_names.npy" in members.namelist():
                        names = text_array(members.read("frame_names.npy"))
                for t, frame in enumerate(pts):
                    frame = np.pad(frame, ((0, 0), (0, max(0, 3 - frame.shape[1]))))
                    yield pd.DataFrame(
                        {
                            "path": file, "stream": stream, "timestep": t, "frame_name": names[t] if t < len(names) else None, "clean_prefix": prefix,
                            "point_idx": np.arange(len(frame)), "x": frame[:, 0], "y": frame[:, 1], "z": frame[:, 2], "feats": list(frame[:, 3:]),
                        }
                    )

    schema = "path string, stream string, timestep int, frame_name string, clean_prefix int, point_idx long, x double, y double, z double, feats array<double>"
    return binary_files(spark, path, pattern).select("path", "content").mapInPandas(decode, schema)


IMAGE_SCHEMA = "path string, row_idx long, label array<long>, h int, w int, channels int, pixels array<int>"


def _image_rows(file: str, images: np.ndarray, labels: np.ndarray) -> Iterator[pd.DataFrame]:
    if images.ndim == 3:
        images = images[..., None]
    if images.ndim != 4:
        raise ValueError(f"{file}: images must have 3 or 4 dimensions, got {images.shape}")
    if len(images) != len(labels):
        raise ValueError(f"{file}: {len(images)} images but {len(labels)} labels")
    _, h, w, c = images.shape
    for lo in range(0, len(images), 256):
        part = images[lo : lo + 256]
        yield pd.DataFrame(
            {
                "path": file, "row_idx": np.arange(lo, lo + len(part)), "label": list(labels[lo : lo + len(part)].reshape(len(part), -1).astype(np.int64)),
                "h": h, "w": w, "channels": c, "pixels": list(np.clip(part, 0, 255).astype(np.int32).reshape(len(part), -1)),
            }
        )


def _decode_images(split: str | None):
    """Archive decoder: keys ``images``/``labels``, or ``<split>_images``/``<split>_labels``."""
    ik, lk = ("images", "labels") if split is None else (f"{split}_images", f"{split}_labels")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as npz:
                    images, labels = npz[ik], npz[lk]
                yield from _image_rows(file, images, labels)

    return decode


# File name layouts of the two labelled image sets.
SPLIT_LAYOUT = r"/([^/]+)/([^/]+)/(?:clean|([^/]+)_severity_(\d+))\.npz$"
STACKED_LAYOUT = r"/([^/]+)/([^/]+)\.npz$"


def read_split_images(spark: SparkSession, root: str, wanted: dict[str, list] | None = None) -> DataFrame:
    """Layout ``<modality>/<split>/clean.npz`` and ``<corruption>_severity_<s>.npz``.

    ``modality, split, corruption (NULL when clean), severity, sample_index`` and the image; ``wanted`` lists
    values of the first four by column, and only archives with these are opened.
    """
    return read_image_archives(spark, root, wanted)


def read_clean_archive(spark: SparkSession, root: str, dataset: str, split: str = "test") -> DataFrame:
    """Clean images of ``<dataset>_224.npz``, or ``<dataset>.npz`` when that is absent."""
    for name in (f"{dataset}_224.npz", f"{dataset}.npz"):
        files = binary_files(spark, root, name)
        if files.select("path").limit(1).count():
            rows = files.select("path", "content").mapInPandas(_decode_images(split), IMAGE_SCHEMA)
            return rows.select(F.lit(dataset).alias("dataset"), F.col("row_idx").alias("sample_index"), "label", "h", "w", "channels", "pixels")
    raise FileNotFoundError(f"no clean archive for dataset {dataset} under {root}")


def read_stacked_corruptions(
    spark: SparkSession, root: str, clean_counts: DataFrame, severities: list[int], split: str = "test", corruptions: list[str] | None = None
) -> DataFrame:
    """``<dataset>/<corruption>.npz`` files of stacked severity blocks; only the wanted blocks are read.

    ``clean_counts`` gives ``dataset, n_clean`` (a row per dataset); only archives of these datasets and of the
    ``corruptions`` (None: all) are opened.  A requested block that is short (by the archives' headers) or a severity below 1 fails.
    """
    if any(s < 1 for s in severities):
        raise ValueError("severities start at 1")
    counts = {r["dataset"]: r["n_clean"] for r in clean_counts.collect()}
    wanted = {"modality": sorted(counts)} | ({"corruption": corruptions} if corruptions is not None else {})
    part = lambda i: F.regexp_extract("path", STACKED_LAYOUT, i)
    have = member_lengths(spark, root, f"{split}_labels", wanted).withColumn("dataset", part(1)).withColumn("corruption", part(2))
    short = have.join(clean_counts, "dataset").where(F.col("rows") < F.col("n_clean") * max(severities)).limit(1).collect()
    if short:
        raise ValueError(f"{short[0]['dataset']}/{short[0]['corruption']} holds too few rows for severity {max(severities)}")
    rows = read_image_archives(spark, root, wanted, layout="stacked", split=split, clean_counts=json.dumps(counts), severities=json.dumps(sorted(set(severities))))
    return rows.select(F.col("modality").alias("dataset"), "corruption", "severity", "sample_index", "label", "h", "w", "channels", "pixels")


def discover_catalog(spark: SparkSession, root: str, layout: str = "split") -> DataFrame:
    """``scope, corruption`` pairs found in file names (hidden folders skipped), sorted; no file is read."""
    paths = binary_files(spark, root, "*.npz").select("path")
    pattern = SPLIT_LAYOUT if layout == "split" else STACKED_LAYOUT
    found = paths.select(
        F.regexp_extract("path", pattern, 1).alias("scope"), F.regexp_extract("path", pattern, 3 if layout == "split" else 2).alias("corruption")
    )
    return found.where((F.col("scope") != "") & (F.col("corruption") != "") & ~F.col("scope").startswith(".")).distinct().orderBy("scope", "corruption")


def read_frames(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """Parquet frame table, checked: RGB, pixel count = h * w * 3, defaults for missing fields."""
    f = spark.read.parquet(path)
    for need in ("episode_id", "timestep", "h", "w", "pixels"):
        if need not in f.columns:
            raise ValueError(f"frame table lacks column {need}")
    for name, value in (("source_dataset", F.lit("unknown")), ("channels", F.lit(3))):
        if name not in f.columns:
            f = f.withColumn(name, value)
    bad = (F.col("channels") != 3) | (F.size("pixels") != F.col("h") * F.col("w") * 3)
    stop = F.raise_error(F.concat(F.lit("frame is not RGB of its stated size: episode "), F.col("episode_id").cast("string")))
    return f.withColumn("pixels", F.when(bad, stop.cast(f.schema["pixels"].dataType)).otherwise(F.col("pixels")))


def first_episode(frames: DataFrame) -> DataFrame:
    """Frames of the smallest episode id, with its length as ``original_length``."""
    first = frames.agg(F.min("episode_id")).scalar()
    one = frames.where(F.col("episode_id") == first)
    return one.withColumn("original_length", one.agg(F.count(F.lit(1))).scalar())


def list_streams(frames: DataFrame) -> DataFrame:
    return frames.groupBy("stream").agg(F.count_distinct("name").alias("frames"))


def write_bin(path: str, points: np.ndarray) -> None:
    """One flat float32 point file (test fixture helper)."""
    points.astype("<f4").tofile(path)
