"""Labelled image archives as a Spark data source, and text arrays of archives without unpickling.

File names state modality, split, corruption and severity, and the wanted values of these choose the archives
before any is opened; a task opens one, reads its directory and streams the members it needs.  The choice is an
option of the reader: filters pushed to a Python source would stay in force for later queries on the same table
in Spark 4.1.
"""

from __future__ import annotations

import json
import os
import pickletools
import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# File name layouts of the two labelled image sets.
SPLIT_NAME = re.compile(r"(?:^|/)([^/]+)/([^/]+)/(?:clean|([^/]+)_severity_(\d+))\.npz$")
STACKED_NAME = re.compile(r"(?:^|/)([^/]+)/([^/]+)\.npz$")
CHUNK_ROWS = 256
PATH_COLUMNS = ("modality", "split", "corruption", "severity")


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a file or folder; local paths may be written ``file:/...``."""
    local = re.match(r"file:/*(/.*)", uri)
    if local or "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(local[1] if local else uri)
    return fs.FileSystem.from_uri(uri)


def list_archives(root: str) -> list[str]:
    """Paths of all ``.npz`` files below ``root``, hidden folders left out."""
    system, path = place(root)
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    names = [f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".npz")]
    return sorted(n for n in names if not any(p.startswith(".") for p in n[len(path) :].split("/")))


# ---- members ------------------------------------------------------------------------------


def header(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, column order and type of an array file, from its first bytes."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    return read(f)


def member_rows(archive: zipfile.ZipFile, member: str, start: int, stop: int | None) -> Iterator[np.ndarray]:
    """Rows ``start`` to ``stop`` of a member, some at a time; rows before are skipped, rows behind not read."""
    with archive.open(member + ".npy") as f:
        shape, by_column, kind = header(f)
        if kind.hasobject:
            raise ValueError(f"{member}: objects are not read")
        if not shape:
            raise ValueError(f"{member}: a single value, not rows")
        n = shape[0] if stop is None else stop
        if n > shape[0]:
            raise ValueError(f"{member} holds too few rows: {shape[0]}, {n} are needed")
        size = prod(shape[1:]) * kind.itemsize
        if by_column:
            whole = np.frombuffer(f.read(shape[0] * size), kind).reshape(shape[::-1]).T
            for lo in range(start, n, CHUNK_ROWS):
                yield whole[lo : min(lo + CHUNK_ROWS, n)]
            return
        f.seek(start * size, os.SEEK_CUR)
        for lo in range(start, n, CHUNK_ROWS):
            rows = min(CHUNK_ROWS, n - lo)
            yield np.frombuffer(f.read(rows * size), kind).reshape(rows, *shape[1:])


# The only names that the pickle of an array of text refers to.
ARRAY_NAMES = {("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy", "ndarray"), ("numpy", "dtype"), ("_codecs", "encode")}
PLAIN = {"BINUNICODE", "SHORT_BINUNICODE", "BINUNICODE8", "BININT", "BININT1", "BININT2", "LONG1", "SHORT_BINBYTES", "BINBYTES", "BINSTRING", "SHORT_BINSTRING", "UNICODE"}
FIXED = {"NONE": None, "NEWTRUE": True, "NEWFALSE": False, "EMPTY_TUPLE": ()}


class _Refused(ValueError):
    pass


def text_array(raw: bytes) -> list[str]:
    """The strings of a one-dimensional array file of text, object arrays included.

    The pickle of an object array is read as data: its opcodes may build strings, numbers, tuples, lists and
    one array header from a few known names.  Nothing is imported or called; anything else is refused.
    """
    f = BytesIO(raw)
    shape, _, kind = header(f)
    if not kind.hasobject:
        return [str(x) for x in np.load(BytesIO(raw), allow_pickle=False).ravel()]
    stack: list = []
    marks: list[int] = []
    memo: dict[int, object] = {}

    def since_mark() -> list:
        at = marks.pop()
        items = stack[at:]
        del stack[at:]
        return items

    try:
        for op, arg, _ in pickletools.genops(f):
            name = op.name
            if name in ("PROTO", "FRAME"):
                pass
            elif name in PLAIN:
                stack.append(arg)
            elif name in FIXED:
                stack.append(FIXED[name])
            elif name == "EMPTY_LIST":
                stack.append([])
            elif name == "MARK":
                marks.append(len(stack))
            elif name == "TUPLE":
                stack.append(tuple(since_mark()))
            elif name in ("TUPLE1", "TUPLE2", "TUPLE3"):
                n = int(name[-1])
                stack[-n:] = [tuple(stack[-n:])]
            elif name in ("APPEND", "APPENDS"):
                items = [stack.pop()] if name == "APPEND" else since_mark()
                if not isinstance(stack[-1], list):
                    raise _Refused
                stack[-1].extend(items)
            elif name in ("GLOBAL", "STACK_GLOBAL"):
                where = tuple(arg.split(" ", 1)) if name == "GLOBAL" else tuple(stack[-2:])
                if name == "STACK_GLOBAL":
                    del stack[-2:]
                if where not in ARRAY_NAMES:
                    raise _Refused
                stack.append(("name", *where))
            elif name in ("MEMOIZE", "BINPUT", "LONG_BINPUT", "PUT"):
                memo[len(memo) if name == "MEMOIZE" else int(arg)] = stack[-1]
            elif name in ("BINGET", "LONG_BINGET", "GET"):
                stack.append(memo[int(arg)])
            elif name == "REDUCE":  # what the call would make is stood for by a holder of its arguments
                args, made = stack.pop(), stack.pop()
                if not (isinstance(made, tuple) and made[:1] == ("name",)):
                    raise _Refused
                stack.append({"made": made[2], "args": args, "state": None})
            elif name == "BUILD":
                state = stack.pop()
                if not isinstance(stack[-1], dict):
                    raise _Refused
                stack[-1]["state"] = state
            elif name == "STOP":
                break
            else:
                raise _Refused
        (array,) = stack
        values = array["state"][-1]
        if array["made"] != "_reconstruct" or not isinstance(values, list) or len(values) != prod(shape):
            raise _Refused
    except (_Refused, IndexError, KeyError, TypeError, ValueError, AttributeError):
        raise ValueError("an object array may hold nothing but text") from None
    if not all(isinstance(v, str) for v in values):
        raise ValueError("an object array may hold nothing but text")
    return values


# ---- the data source ----------------------------------------------------------------------


class Part(InputPartition):
    """One archive, or one severity block of it."""

    def __init__(self, path: str, modality: str, split: str, corruption: str | None, severity: int | None, start: int, stop: int | None):
        self.path, self.facts, self.start, self.stop = path, (modality, split, corruption, severity), start, stop


class ImageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.split = options["path"], options.get("split", "test")
        self.stacked = options.get("layout", "split") == "stacked"
        self.counts = {k: int(v) for k, v in json.loads(options.get("clean_counts", "{}")).items()}
        self.severities = json.loads(options.get("severities", "[]"))
        self.wanted = {k: set(v) for k, v in json.loads(options.get("wanted", "{}")).items()}

    def _wanted(self, facts: tuple) -> bool:
        known = dict(zip(PATH_COLUMNS, facts))
        return all(known[c] in values for c, values in self.wanted.items())

    def partitions(self):
        out = []
        for path in list_archives(self.root):
            m = (STACKED_NAME if self.stacked else SPLIT_NAME).search(path)
            if m and self.stacked:
                n = self.counts.get(m[1])
                out += [Part(path, m[1], self.split, m[2], s, (s - 1) * n, s * n) for s in self.severities if n]
            elif m:
                out.append(Part(path, m[1], m[2], m[3], int(m[4]) if m[4] else None, 0, None))
        return [p for p in out if self._wanted(p.facts)] or [Part("", "", "", None, None, 0, 0)]

    def read(self, part):
        if not part.path:
            return
        keys = [f"{self.split}_images", f"{self.split}_labels"] if self.stacked else ["images", "labels"]
        system, path = place(part.path) if "://" in self.root else (fs.LocalFileSystem(), part.path)
        with system.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
            sizes = []
            for k in keys:
                with archive.open(k + ".npy") as m:
                    sizes.append(header(m)[0][0])
            if sizes[0] != sizes[1]:
                raise ValueError(f"{part.path}: {sizes[0]} images but {sizes[1]} labels")
            at = 0
            for images, labels in zip(*(member_rows(archive, k, part.start, part.stop) for k in keys)):
                yield self._batch(part, at, images[..., None] if images.ndim == 3 else images, labels)
                at += len(images)

    def _batch(self, part: Part, at: int, images: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
        if images.ndim != 4:
            raise ValueError(f"{part.path}: images must have 3 or 4 dimensions, got {images.shape}")
        n, h, w, c = images.shape
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))
        cols = [pa.array([v] * n, k) for v, k in zip(part.facts, (pa.string(), pa.string(), pa.string(), pa.int32()))]
        cols += [pa.array(np.arange(at, at + n)), lists(labels.reshape(n, -1).astype(np.int64), pa.int64())]
        cols += [pa.array([v] * n, pa.int32()) for v in (h, w, c)]
        cols.append(lists(np.clip(images, 0, 255).astype(np.int32).reshape(n, -1), pa.int32()))
        return pa.RecordBatch.from_arrays(cols, schema=ARROW)


SCHEMA = "modality string, split string, corruption string, severity int, sample_index long, label array<long>, h int, w int, channels int, pixels array<int>"
ARROW = pa.schema(
    [("modality", pa.string()), ("split", pa.string()), ("corruption", pa.string()), ("severity", pa.int32()), ("sample_index", pa.int64()),
     ("label", pa.list_(pa.int64())), ("h", pa.int32()), ("w", pa.int32()), ("channels", pa.int32()), ("pixels", pa.list_(pa.int32()))]
)


class ImageArchives(DataSource):
    """``spark.read.format("image_archives").load(root)``; options ``layout``, ``split``, ``clean_counts``, ``severities``, ``wanted``."""

    @classmethod
    def name(cls) -> str:
        return "image_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ImageReader:
        return ImageReader(dict(self.options))


def read_image_archives(spark: SparkSession, root: str, wanted: dict[str, list] | None = None, **options: str) -> DataFrame:
    """Images below ``root``; ``wanted`` lists values of path columns, and other archives are not opened.

    ``layout="split"`` (default): ``<modality>/<split>/clean.npz`` and ``<corruption>_severity_<s>.npz``, NULL (None in
    ``wanted``) corruption and severity for clean ones.  ``layout="stacked"``: ``<modality>/<corruption>.npz`` of severity
    blocks, with the rows of a block by modality in ``clean_counts`` and the ``severities``, both JSON; a short block fails.
    """
    unknown = set(wanted or {}).difference(PATH_COLUMNS)
    if unknown:
        raise ValueError(f"archives are chosen by {', '.join(PATH_COLUMNS)}, not by {', '.join(sorted(unknown))}")
    spark.dataSource.register(ImageArchives)
    return spark.read.format("image_archives").options(**options, wanted=json.dumps(wanted or {})).load(root)


def member_lengths(spark: SparkSession, root: str, member: str, wanted: dict[str, list]) -> DataFrame:
    """``path, rows`` of a member in the wanted stacked archives below ``root``, from the members' headers."""

    def lengths(batches):
        for batch in batches:
            paths, rows = batch.column("path").to_pylist(), []
            for p in paths:
                system, local = place(p) if "://" in root else (fs.LocalFileSystem(), p)
                with system.open_input_file(local) as f, zipfile.ZipFile(f) as archive, archive.open(member + ".npy") as m:
                    rows.append(header(m)[0][0])
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(rows, pa.int64())], ["path", "rows"])

    facts = [(p, m) for p in list_archives(root) if (m := STACKED_NAME.search(p))]  # one name per archive
    names = [(p,) for p, m in facts if all({"modality": m[1], "corruption": m[2]}[c] in v for c, v in wanted.items())]
    return spark.createDataFrame(names, "path string").repartition(max(1, len(names))).mapInArrow(lengths, "path string, rows long").select(F.col("path"), "rows")
