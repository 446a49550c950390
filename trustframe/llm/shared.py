"""Files in the cluster's shared folder, written and read inside tasks."""

from __future__ import annotations

import ctypes
import re
import sys

import pyarrow as pa
from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file; local paths may be written ``file:/...``."""
    local = re.match(r"file:/*(/.*)", uri)
    if local or uri.startswith("/"):
        return fs.LocalFileSystem(), local[1] if local else uri
    return fs.FileSystem.from_uri(uri)


def attempt_name(stem: str) -> str:
    """A name that no other task attempt uses, so that a repeated or lost attempt cannot damage a file."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return f"{stem}-{ctx.taskAttemptId() if ctx else 0}"


def partition_id() -> int:
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


def forget() -> None:
    """Free the word ids that an earlier token stage left in this Python worker, and give unused memory back.

    Workers are reused and idle ones stay alive; what they freed would otherwise still count.
    """
    sys.modules.pop("_word_id_memo", None)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def make_folder(uri: str) -> None:
    system, path = place(uri)
    system.create_dir(path, recursive=True)


def read_range(uri: str, offset: int, length: int) -> bytes:
    system, path = place(uri)
    with system.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length)
