"""Block-wise evaluation of all-pairs work.

Points are hashed into blocks of bounded size.  Each block meets each other
block once in a tile; a tile holds at most two blocks, computes its distance
matrix with BLAS and returns aggregates only.  No pair row ever exists.

Kernels that walk their tile in steps of ``BLOCK_ROWS`` rows take large blocks:
as large as memory allows, but no larger than it takes to keep all cores busy.
A point is then copied into few tiles and leaves one partial result in each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .lookup import attach_facts, spread

BLOCK_ROWS = 1024
# Bytes that a large block may hold.
BLOCK_BYTES = 32 << 20
# So many tasks keep a small cluster busy.
TILE_TASKS = 96


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrow list column of equal-length vectors as a 2-D array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def vectors(m: np.ndarray) -> pa.Array:
    """2-D array as an Arrow list column."""
    n, d = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(m, dtype=float).ravel()))


def with_blocks(df: DataFrame, scope: Sequence[str], row_id: str, block_rows: int, row_bytes: Column | None = None) -> DataFrame:
    """Add ``_blk`` and ``_nblk`` (per scope) so that a block holds about ``block_rows`` rows.

    With ``row_bytes``, an aggregate, blocks are large: about ``BLOCK_BYTES``, or as many
    as give twice as many tiles as there are shuffle partitions, of which ``TILE_TASKS`` or eight
    a core are enough: each further block means one more copy of every row.
    """
    n = F.count(F.lit(1))
    blocks = F.ceil(n / block_rows)
    if row_bytes is not None:
        spark = df.sparkSession
        enough = max(TILE_TASKS, 8 * spark.sparkContext.defaultParallelism)
        busy = ceil(sqrt(4 * min(int(spark.conf.get("spark.sql.shuffle.partitions")), enough)))
        blocks = F.greatest(F.ceil(n * row_bytes / BLOCK_BYTES), F.least(blocks, F.lit(busy)))
    sizes = df.groupBy(*scope).agg(blocks.cast("int").alias("_nblk"))
    out = attach_facts(df, sizes, scope, [row_id])
    return out.withColumn("_blk", F.pmod(F.xxhash64(row_id), F.col("_nblk")).cast("int"))


def self_tiles(
    df: DataFrame,
    scope: Sequence[str],
    row_id: str,
    kernel: Callable[[tuple, pa.Table, pa.Table | None], pa.Table],
    schema: str,
    block_rows: int | None = None,
    row_bytes: Column | None = None,
) -> DataFrame:
    """Run ``kernel(scope values, block, other block or None)`` on every unordered block pair.

    ``row_bytes`` asks for large blocks, which the kernel must walk in steps.
    """
    scope = list(scope)
    d = with_blocks(df, scope, row_id, block_rows or BLOCK_ROWS, row_bytes)
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nblk") - 1)))
    d = d.withColumn("_lo", F.least("_blk", "_o")).withColumn("_hi", F.greatest("_blk", "_o")).drop("_o", "_nblk")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        values = tuple(k.as_py() for k in key)
        lo, hi = values[-2:]
        blk = table.column("_blk").to_numpy()
        first = table.filter(pa.array(blk == lo))
        second = None if lo == hi else table.filter(pa.array(blk == hi))
        return kernel(values[:-2], first, second)

    return spread(d, *scope, "_lo", "_hi").groupBy(*scope, "_lo", "_hi").applyInArrow(run, schema)


# Rows of both sides that meet in one task, in as many whole tiles as it takes.
PACKED_ROWS = 65_536


def scoped_cross_tiles(
    left: DataFrame,
    right: DataFrame,
    scope: Sequence[str],
    left_id: str,
    right_id: str,
    kernel: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    left_rows: int,
    right_rows: int,
) -> DataFrame:
    """Run ``kernel(left block, right block)`` on every block combination of two tables inside each scope.

    Only scopes of more than one block look up their numbers of blocks.  Small tiles share a task's call,
    which costs far more than a small tile does.
    """
    scope = list(scope)
    count = lambda df, rows, name: df.groupBy(*scope).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
    sizes = count(left, left_rows, "_ln").join(count(right, right_rows, "_rn"), scope)
    several = sizes.where((F.col("_ln") > 1) | (F.col("_rn") > 1))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = materialize(several)

    def numbered(df: DataFrame, own_id: str) -> DataFrame:
        for s in scope:
            df = df.where(F.col(s).isNotNull())
        d = attach_facts(df, some, scope, [own_id], "left")
        return d.withColumns({n: F.coalesce(n, F.lit(1)) for n in ("_ln", "_rn")})

    lx = numbered(left, left_id).withColumn("_i", block(left_id, "_ln")).withColumn("_j", cells("_rn")).drop("_ln", "_rn")
    rx = numbered(right, right_id).withColumn("_j", block(right_id, "_rn")).withColumn("_i", cells("_ln")).drop("_ln", "_rn")
    key = [*scope, "_i", "_j"]
    n = max(left.count() // PACKED_ROWS, right.count() // PACKED_ROWS, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tile = F.pmod(F.xxhash64(*key), F.lit(n)).alias("_tile")
    lx, rx = lx.select("*", tile), rx.select("*", tile)
    rx = rx.toDF(*rx.columns)  # both sides may stem from one table

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            (a, a_at), (b, b_at) = _by_key(a, key), _by_key(b, key)
            for k in a_at.keys() & b_at.keys():
                found.append(kernel(a.slice(*a_at[k]), b.slice(*b_at[k])))
        return pa.concat_tables(found) if found else kernel(a.slice(0, 0), b.slice(0, 0))

    return spread(lx, "_tile").groupBy("_tile").cogroup(spread(rx, "_tile").groupBy("_tile")).applyInArrow(lambda a, b: run(a, b), schema)


def _by_key(t: pa.Table, key: Sequence[str]) -> tuple[pa.Table, dict[tuple, tuple[int, int]]]:
    """The table in order of ``key`` with the place and length of each key's rows."""
    t = t.sort_by([(k, "ascending") for k in key]).combine_chunks()
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in key:
        own = t.column(k).combine_chunks().dictionary_encode().indices.to_numpy()
        new[1:] |= own[1:] != own[:-1]
    starts = np.flatnonzero(new)
    values = t.select(list(key)).take(pa.array(starts)).to_pydict()
    ends = np.append(starts[1:], t.num_rows)
    return t, {k: (int(lo), int(hi - lo)) for k, lo, hi in zip(zip(*values.values()), starts, ends)}


def cross_tiles(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    kernel: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    block_rows: int | None = None,
    right_block: tuple[Column, int] | None = None,
) -> DataFrame:
    """Run ``kernel(left block, right block)`` on every block combination of two tables.

    Blocks are cut by hash; ``right_block`` gives the right side's own block numbers and how many there are.
    """
    block_rows = block_rows or BLOCK_ROWS
    ln = max(1, -(-left.count() // block_rows))
    own, rn = right_block or (None, max(1, -(-right.count() // block_rows)))
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lx = left.withColumn("_i", F.pmod(F.xxhash64(left_id), F.lit(ln)).cast("int")).withColumn("_j", cells(rn))
    own = F.pmod(F.xxhash64(right_id), F.lit(rn)) if own is None else own
    rx = right.withColumn("_j", own.cast("int")).withColumn("_i", cells(ln))
    return spread(lx, "_i", "_j").groupBy("_i", "_j").cogroup(spread(rx, "_i", "_j").groupBy("_i", "_j")).applyInArrow(lambda a, b: kernel(a, b), schema)
