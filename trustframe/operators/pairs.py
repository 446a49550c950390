"""Family-separation metrics over all pairs of points, without pair rows.

Input points: ``scope columns, pid (long), family (string), z``.  Cosine means,
spreads, silhouettes and permutation margins have closed forms in family sums
and take one linear pass.  Everything that needs individual distances runs in
bounded tiles that return aggregates.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator, Sequence
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.vectors import jaccard, l2_normalize
from ..plans.lookup import attach_facts, same_key_join, spread
from ..plans.ranks import ordered_counts, rank_in_group
from ..plans.shuffles import places, round_keys
from ..plans import tiles
from ..plans.tiles import matrix, scoped_cross_tiles, self_tiles
from ..session import materialize
from .fit import key_ddl, moments

# Pairs whose distances may leave the tiles of one pass, packed (about 4 bytes each): so many, or for more points than
# ``PASS_POINTS`` as many more as there are more points.  Then pairs that one task orders, that
# a tile holds unsorted, and that are sorted at once.
PASS_PAIRS = 250_000_000
PASS_POINTS = 100_000
RANGE_PAIRS = 4_000_000
HELD_PAIRS = 2_000_000
SORT_KEYS = 250_000
# Rows of a step of the passes over all pairs; it has four times as many columns and stays in a core's cache.
STEP_ROWS = 256
# Bins that a tile counts in one array; others are counted apart.
WINDOW_BINS = 1 << 17
# Bits of a distance that a first count leaves out (1,024 bins per power of two), and bits of a refinement.
FIRST_SHIFT, REFINE_BITS = 42, 10
# Bits that a first count of many pairs has more at most.
FINER_BITS = 5


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distance matrix; near-coincident pairs are recomputed from differences."""
    if metric == "cosine":
        na = np.maximum(np.linalg.norm(a, axis=1), 1e-300)
        nb = np.maximum(np.linalg.norm(b, axis=1), 1e-300)
        return np.clip(1.0 - (a / na[:, None]) @ (b / nb[:, None]).T, 0.0, 2.0)
    if metric != "l2":
        raise ValueError(f"unknown metric {metric}")
    sa, sb = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)[None, :]
    d2, cross = sa + sb, a @ b.T
    cross *= 2.0
    d2 -= cross
    np.maximum(d2, 0.0, out=d2)
    if d2.size and not d2.min() >= 1e-7 * (sa.max() + sb.max()):  # else no pair is near-coincident
        i, j = np.nonzero(d2 < 1e-7 * (sa + sb))
        d2[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
    return np.sqrt(d2, out=d2)


def pairwise_steps(a: np.ndarray, b: np.ndarray, metric: str, step: int) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray | None]]:
    """Distances of ``a`` to ``b`` in cache-sized steps, squared for L2: rows, columns, matrix, and which of its cells count.

    A block with itself (``b is a``) has each pair once; where all cells count, that is None.  A matrix is overwritten by the next.
    """
    rows = min(step, STEP_ROWS)
    cols, alone = 4 * rows, b is a
    if metric == "cosine":
        left, right = (x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None] for x in (a, b))
    elif metric == "l2":
        sa, sb = ((x * x).sum(axis=1) for x in (a, b))
        left, right = np.column_stack([-2.0 * a, sa, np.ones(len(sa))]), np.column_stack([b, np.ones(len(sb)), sb])
    else:
        raise ValueError(f"unknown metric {metric}")
    held = np.empty((rows, cols))
    for at in range(0, len(b), cols):
        c = slice(at, at + cols)
        turned = np.ascontiguousarray(right[c].T)
        for lo in range(0, min(at + cols, len(a)) if alone else len(a), rows):
            r = slice(lo, lo + rows)
            full = turned.shape[1] == cols and lo + rows <= len(a)
            d = np.matmul(left[r], turned, out=held if full else None)
            if metric == "cosine":
                np.subtract(1.0, d, out=d)
                np.clip(d, 0.0, 2.0, out=d)
            elif not d.min() >= 1e-7 * (sa[r].max() + sb[c].max()):  # else no pair is near-coincident
                i, j = np.nonzero(d < 1e-7 * (sa[r, None] + sb[c]))
                d[i, j] = ((a[r][i] - b[c][j]) ** 2).sum(axis=1)
                np.maximum(d, 0.0, out=d)
            inside = alone and lo + rows > at
            yield r, c, d, np.arange(lo, lo + len(d))[:, None] < np.arange(at, at + d.shape[1]) if inside else None


def pack(keys: np.ndarray, base: int = 0) -> tuple[bytes, int]:
    """Sorted keys from ``base`` on as bytes, and how many steps from key to key these hold.

    Short steps take 4 bytes each; else the steps to distinct keys, and counts where keys repeat, are stored byte plane
    by byte plane to compress well.
    """
    steps = keys - base
    steps[1:] -= steps[:-1].copy()
    if len(steps) and steps.max() < 1 << 32:
        return steps.astype(np.uint32).tobytes(), len(keys)
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    planes = lambda v: np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes()
    out = planes(np.diff(keys[at], prepend=np.int64(base)))
    return out if len(at) == len(keys) else out + planes(np.diff(at, append=len(keys)).astype(np.int64)), len(at)


def unpack(data: bytes, steps: int, base: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """Distinct keys and their counts; None where no key repeats."""
    flat = np.frombuffer(data, np.uint8)
    if len(flat) == 4 * steps:
        short = flat.view(np.uint32)
        keys, counts = short.astype(np.int64), None
        np.cumsum(keys, out=keys)
        if steps > 1 and not short[1:].min():
            first = short != 0
            first[:1] = True
            at = np.flatnonzero(first)
            keys, counts = keys[at], np.diff(at, append=steps)
    else:
        lists = [np.ascontiguousarray(x.reshape(8, -1).T).view(np.int64).ravel() for x in (flat[: 8 * steps], flat[8 * steps :])]
        keys, counts = np.cumsum(lists[0]), lists[1] if len(lists[1]) else None
    keys += base
    return keys, counts


def merged(parts: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts in order, and how often each occurs."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = np.concatenate([k for k, _ in parts])
    if all(c is None for _, c in parts):
        keys.sort()
        counts = None
    else:
        counts = np.concatenate([np.ones(len(k), np.int64) if c is None else c for k, c in parts])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    if first.all():
        return keys, np.ones(len(keys), np.int64) if counts is None else counts
    at = np.flatnonzero(first)
    return keys[at], np.diff(at, append=len(keys)) if counts is None else np.add.reduceat(counts, at)


class TileSums:
    """Sums of one tile, fed with the distance matrices of its steps."""

    def __init__(self, kinds: set[str], a: dict, b: dict, k: int, shift: int, parents: tuple | None):
        self.kinds, self.a, self.b, self.k, self.shift, self.parents = kinds, a, b, k, shift, parents
        self.names, codes = np.unique(np.concatenate([a["family"], b["family"]]).astype(str), return_inverse=True)
        self.codes = {"a": codes[: len(a["family"])], "b": codes[len(a["family"]) :]}
        self.alone = b is a  # the tile of a block with itself
        if self.alone:
            self.codes["b"] = self.codes["a"]
        self.by_same = {kind: np.zeros((2, 3)) for kind in ("mom", "jac")}
        self.hist: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.fam = {s: np.zeros((len(self.codes[s]), len(self.names))) for s in ("a", "b")} if "fam" in kinds else {}
        self.best = {s: [] for s in ("a", "b")}
        self.dist: dict[bool, list[np.ndarray]] = {True: [], False: []}
        self.sent: list[dict] = []
        self.window, self.base = None, 0
        self.perm = np.zeros(a["labels"].shape[1]) if "perm" in kinds else None
        self.n_codes = 1 + int(max((x["labels"].max() for x in (a, b) if x["labels"].size), default=0)) if "perm" in kinds else 0

    def add(self, rows: slice, cols: slice, d: np.ndarray) -> None:
        inside = self.alone and rows.start == cols.start
        ca, cb = self.codes["a"][rows], self.codes["b"][cols]
        same = ca[:, None] == cb[None, :]
        used = np.triu(np.ones(d.shape, bool), 1) if inside else None
        for kind in self.kinds & {"mom", "jac"}:
            v = d if kind == "mom" else self._overlap(rows, cols)
            for flag in (0, 1):
                m = same if flag else ~same
                x = v[m if used is None else m & used]
                self.by_same[kind][flag] += len(x), x.sum(), (x * x).sum()
        if "hist" in self.kinds:
            self._count(d.ravel() if used is None else d[used], same.ravel() if used is None else same[used])
        if "dist" in self.kinds:
            self._gather(d.ravel() if used is None else d[used], same.ravel() if used is None else same[used])
        if "fam" in self.kinds:
            free = d * ~np.eye(len(d), dtype=bool) if inside else d
            self.fam["a"][rows] += free @ np.eye(len(self.names))[cb]
            if not inside:
                self.fam["a" if self.alone else "b"][cols] += free.T @ np.eye(len(self.names))[ca]
        if "nn" in self.kinds:
            self._near("a", rows, d, self.a["pid"][rows], self.b["pid"][cols], cb)
            if not inside:
                self._near("a" if self.alone else "b", cols, d.T, self.b["pid"][cols], self.a["pid"][rows], ca)
        if "perm" in self.kinds:
            self._permuted(d if used is None else d * used, self.a["labels"][rows], self.b["labels"][cols])

    def _permuted(self, d: np.ndarray, la: np.ndarray, lb: np.ndarray) -> None:
        """Sums over equal labels, slot by slot."""
        flat = d.ravel()
        for p in range(len(self.perm)):
            self.perm[p] += flat @ (la[:, p][:, None] == lb[:, p][None, :]).ravel().astype(float)

    def step(self, rows: slice, cols: slice, d: np.ndarray, used: np.ndarray | None, metric: str) -> None:
        """Take a step of ``pairwise_steps`` into what ``hist`` or ``dist`` asks for."""
        same = self.codes["a"][rows, None] == self.codes["b"][cols]
        if "dist" in self.kinds:
            ends = [float(np.int64(k).view(np.float64)) for k in (self.parents[0][0], self.parents[1][-1])]
            ends = [x * x for x in ends] if metric == "l2" else ends
            near = (d >= ends[0] * (1 - 1e-12)) & (d <= ends[1] * (1 + 1e-12))  # rows() keeps to the very ends
            if used is not None:
                near &= used
            at = np.flatnonzero(near)
            d, same = d.ravel()[at], same.ravel()[at]
            key = (np.sqrt(d) if metric == "l2" else d).view(np.int64)
            self.dist[True].append(key[same])
            self.dist[False].append(key[~same])
            self.held += len(key)
            if self.held >= HELD_PAIRS:
                self._send()
            return
        if metric == "l2":
            np.sqrt(d, out=d)
        if self.parents is not None or not self.shift:
            self._count(d.ravel() if used is None else d[used], same.ravel() if used is None else same[used])
            return
        code = d.view(np.int64) >> self.shift
        code *= 2
        code += same
        code = code.ravel() if used is None else code[used]
        if not len(code):
            return
        low, high = int(code.min()), int(code.max())
        if self.window is None:
            self.base = max(0, (high >> 1) - WINDOW_BINS * 7 // 8) * 2
            self.window = np.zeros(2 * WINDOW_BINS, np.int64)
        if low < self.base or high >= self.base + len(self.window):
            inside = (code >= self.base) & (code < self.base + len(self.window))
            u, n = np.unique(code[~inside], return_counts=True)
            self._hold(u, n)
            code = code[inside]
            if not len(code):
                return
            low = int(code.min())
        code -= low
        n = np.bincount(code)
        self.window[low - self.base : low - self.base + len(n)] += n

    def _hold(self, code: np.ndarray, n: np.ndarray) -> None:
        """Counts by twice the bin, and one more for the same family."""
        same = code & 1 == 1
        self.hist.append((code >> 1, np.where(same, n, 0), np.where(same, 0, n)))
        self.held += len(code)
        if self.held > 4_000_000 and len(self.hist) > 1:
            self.hist = [self._folded()]
            self.held = len(self.hist[0][0])

    def _send(self) -> None:
        """Pack the held distances range by range."""
        for same, parts in self.dist.items():
            keys = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
            starts, ends = (np.searchsorted(keys, x) for x in (self.parents or ((), ())))
            some = np.flatnonzero(ends > starts)
            if len(some):
                packed = [pack(keys[starts[i] : ends[i]], self.parents[0][i]) for i in some]
                self.sent.append({
                    "kind": "dist", "key": some, "n": ends[some] - starts[some], "s1": np.full(len(some), float(same)),
                    "s2": np.array([m for _, m in packed], float), "data": [x for x, _ in packed],
                })
            parts.clear()
        self.held = 0

    def _gather(self, d: np.ndarray, same: np.ndarray) -> None:
        """Keep the distances between the outer ends of the wanted ranges."""
        lows, highs = self.parents
        key = (d + 0.0).view(np.int64)
        inside = (key >= lows[0]) & (key < highs[-1])
        self.dist[True].append(key[inside & same])
        self.dist[False].append(key[inside & ~same])

    def _overlap(self, rows: slice, cols: slice) -> np.ndarray:
        sa, sb = self.a["top"][rows], self.b["top"][cols]
        common, kk = sa @ sb.T, sa[:1].sum()
        return common / (2 * kk - common)

    def _count(self, d: np.ndarray, same: np.ndarray) -> None:
        """Count by leading bits: non-negative doubles sort like the integers with their bits."""
        key = (d + 0.0).view(np.int64)
        if self.parents is not None:
            at, known = self.parents
            own = key >> at
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            inside = known[place] == own
            key, same = key[inside], same[inside]
        key = key >> self.shift
        low = key.min() if len(key) else 0
        if len(key) and key.max() - low < 4 * len(key):
            key -= low
            total, hit = np.bincount(key), np.bincount(key[same], minlength=int(key.max()) + 1)
            at = np.flatnonzero(total)
            u, total, hit = at + low, total[at], hit[at]
        else:
            u, at = np.unique(key, return_inverse=True)
            total = np.bincount(at, minlength=len(u))
            hit = np.bincount(at, weights=same, minlength=len(u)).astype(np.int64)
        self.hist.append((u, hit, total - hit))
        self.held += len(u)
        if self.held > 4_000_000 and len(self.hist) > 1:
            self.hist = [self._folded()]
            self.held = len(self.hist[0][0])

    def _folded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, at = np.unique(np.concatenate([h[0] for h in self.hist]), return_inverse=True)
        sums = []
        for k in (1, 2):
            out = np.zeros(len(u), np.int64)
            np.add.at(out, at, np.concatenate([h[k] for h in self.hist]))
            sums.append(out)
        return u, *sums

    def _near(self, side: str, rows: slice, d: np.ndarray, pid: np.ndarray, oid: np.ndarray, fam: np.ndarray) -> None:
        """Keep the k nearest of each row; equal distances go to the smaller id."""
        d = np.where(pid[:, None] == oid[None, :], np.inf, d)
        limit = np.partition(d, self.k - 1, axis=1)[:, self.k - 1] if self.k < d.shape[1] else np.full(len(d), np.inf)
        r, c = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
        self.best[side].append(self._first(r + rows.start, d[r, c], oid[c], fam[c]))
        if sum(len(x[0]) for x in self.best[side]) > 8 * self.k * len(self.codes[side]):
            self.best[side] = [self._first(*[np.concatenate(x) for x in zip(*self.best[side])])]

    def _first(self, r, d, oid, fam) -> tuple[np.ndarray, ...]:
        order = np.lexsort((oid, d, r))
        r = r[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < self.k
        return r[keep], *[x[order][keep] for x in (d, oid, fam)]

    def rows(self) -> list[dict]:
        out = []
        if self.window is not None:
            at = np.flatnonzero(self.window)
            self._hold(at + self.base, self.window[at])
        for kind in sorted(self.kinds & {"mom", "jac"}):
            v = self.by_same[kind]
            some = np.nonzero(v[:, 0])[0]
            out.append({"kind": kind, "key": some, "n": v[some, 0], "s1": v[some, 1], "s2": v[some, 2]})
        if self.hist:
            u, hit, miss = self._folded()
            out.append({"kind": "hist", "key": u, "n": hit, "s1": miss})
        if "dist" in self.kinds:
            self._send()
            out += self.sent
        for side, total in self.fam.items():
            if side == "b" and self.alone:
                continue
            other = self.codes["a" if self.alone or side == "b" else "b"]
            n = np.tile(np.bincount(other, minlength=len(self.names)), (len(total), 1))
            if self.alone:
                n[np.arange(len(total)), self.codes["a"]] -= 1
            r, c = np.nonzero(n)
            out.append({"kind": "fam", "pid": (self.a if side == "a" else self.b)["pid"][r], "fam": self.names[c], "n": n[r, c], "s1": total[r, c]})
        for side, parts in self.best.items():
            if parts:
                r, d, oid, fam = self._first(*[np.concatenate(x) for x in zip(*parts)])
                out.append({"kind": "nn", "pid": (self.a if side == "a" else self.b)["pid"][r], "key": oid, "fam": self.names[fam], "n": np.ones(len(r)), "s1": d})
        if self.perm is not None:
            out.append({"kind": "perm", "key": np.arange(len(self.perm)), "n": np.zeros(len(self.perm)), "s1": self.perm})
        return out


def equal_label_sums(a: dict, b: dict, codes: int, step: int) -> np.ndarray:
    """Per label slot the sum of L2 distances over pairs with equal labels; a block with itself (``b is a``) has each pair once.

    One product gives squared distances, one with label columns adds up each row's distances by label for
    all slots.  The steps are small enough for their distances to stay in a core's cache.
    """
    rows = min(step, LABEL_ROWS)
    cols = 4 * rows
    la, lb = a["labels"], b["labels"]
    slots, alone = la.shape[1], b is a
    out, base = np.zeros(slots), np.arange(slots) * codes
    sa, sb = ((x * x).sum(axis=1) for x in (a["x"], b["x"]))
    left = np.column_stack([-2.0 * a["x"], sa, np.ones(len(sa))])
    right = np.column_stack([b["x"], np.ones(len(sb)), sb])
    several = max(1, LABEL_CELLS // (codes * cols))
    for at in range(0, len(sb), cols):
        c = slice(at, at + cols)
        turned, most = np.ascontiguousarray(right[c].T), sb[c].max()
        for first in range(0, slots, several):
            own = slice(first, first + several)
            shift = base[own] - first * codes
            onehot = np.zeros((turned.shape[1], len(shift) * codes))
            onehot[np.arange(len(onehot))[:, None], lb[c, own] + shift] = 1.0
            for lo in range(0, min(at + cols, len(sa)) if alone else len(sa), rows):
                r = slice(lo, lo + rows)
                d = left[r] @ turned
                if not d.min() >= 1e-7 * (sa[r].max() + most):  # else no pair is near-coincident
                    i, j = np.nonzero(d < 1e-7 * (sa[r, None] + sb[c]))
                    d[i, j] = ((a["x"][r][i] - b["x"][c][j]) ** 2).sum(axis=1)
                    np.maximum(d, 0.0, out=d)
                np.sqrt(d, out=d)
                got = np.take_along_axis(d @ onehot, la[r, own] + shift, axis=1).sum(axis=0)
                out[own] += 0.5 * got if alone and lo >= at else got  # inside a block's own columns a pair is met twice
    return out


def top_signature(x: np.ndarray, topk: int) -> np.ndarray:
    """0/1 rows marking the ``topk`` entries of largest size, smaller index first."""
    top = np.lexsort((np.broadcast_to(np.arange(x.shape[1]), x.shape), -np.abs(x)), axis=1)[:, : min(topk, x.shape[1])]
    out = np.zeros(x.shape)
    np.put_along_axis(out, top, 1.0, axis=1)
    return out


def tile_stats(
    points: DataFrame,
    scope: Sequence[str],
    metric: str,
    kinds: Iterable[str],
    k: int = 5,
    topk: int = 50,
    block_rows: int | None = None,
    labels: str | None = None,
    shift: int = 0,
    parents: tuple[int, dict[tuple, np.ndarray]] | None = None,
    ranges: dict[tuple, tuple[np.ndarray, np.ndarray]] | None = None,
) -> DataFrame:
    """Long table of tile aggregates: ``scope, kind, pid, key, fam, n, s1, s2``.

    mom   key=same family (1/0)           n, sum d, sum d^2
    hist  key=bits of d >> shift          n=same count, s1=other count
    fam   pid, fam                         n, sum of distances from pid to that family
    nn    pid, key=neighbour, fam          s1=distance (the k nearest inside the tile)
    jac   key=same family (1/0)           n, sum of top-dimension overlap
    perm  key=slot of ``labels``           sum d over pairs whose labels in this slot are equal
    dist  key=position in ``ranges``        n, s1=same family (1/0), s2=steps, data=packed bits of the distances

    ``parents`` = (bits, sorted prefixes by scope) counts only distances under these prefixes.  ``ranges`` = by scope
    the sorted ends [low, high) of the bits of wanted distances; the column ``data`` exists for ``dist`` only.
    """
    kinds = frozenset(kinds)
    wanted = ranges if ranges is not None else parents[1] if parents is not None else None
    sent = points.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None
    parent_bits = parents[0] if parents is not None else 0
    step_rows = tiles.BLOCK_ROWS
    names = [*scope, "kind", "pid", "key", "fam", "n", "s1", "s2", *(["data"] if "dist" in kinds else [])]

    def side(block: pa.Table) -> dict:
        x = matrix(block.column("z"))
        return {
            "x": x, "family": np.asarray(block.column("family").to_pylist(), dtype=object), "pid": block.column("pid").to_numpy(),
            "top": top_signature(x, topk) if "jac" in kinds else None, "labels": matrix(block.column(labels)) if labels else None,
        }

    def kernel(scope_values: tuple, first: pa.Table, second: pa.Table | None) -> pa.Table:
        known = None
        if sent is not None:
            mine = sent.value.get(scope_values)
            if mine is None or not len(mine[0] if ranges is not None else mine):
                return pa.Table.from_arrays([pa.array([], f) for f in types], names=names)
            known = mine if ranges is not None else (parent_bits, mine)
        if kinds <= {"hist", "dist"}:  # in one order whenever the tile is met, as the last bits of a product depend on its place
            first, second = (t if t is None else t.sort_by("pid") for t in (first, second))
        a = side(first)
        b = a if second is None else side(second)
        sums = TileSums(set(kinds), a, b, k, shift, known)
        step = block_rows or step_rows
        if "perm" in kinds and metric == "l2" and sums.n_codes <= DENSE_LABELS:
            sums.perm += equal_label_sums(a, b, sums.n_codes, step)
            sums.kinds.discard("perm")
        if sums.kinds and sums.kinds <= {"hist", "dist"}:
            for part in pairwise_steps(a["x"], b["x"], metric, step):
                sums.step(*part, metric)
            sums.kinds -= {"hist"}
        for lo in range(0, len(a["x"]) if sums.kinds - {"dist"} else 0, step):
            for at in range(lo if second is None else 0, len(b["x"]), step):
                rows, cols = slice(lo, lo + step), slice(at, at + step)
                sums.add(rows, cols, distances(a["x"][rows], b["x"][cols], metric))
        tables = []
        for part in sums.rows():
            n = len(part["n"])
            values = [*scope_values, part.pop("kind"), *[part.get(c) for c in names[len(scope) + 1 :]]]
            values[names.index("s2")] = part.get("s2", 0.0)
            cols_ = [pa.array(v, f) if isinstance(v, (np.ndarray, list)) else pa.array([v] * n, f) for v, f in zip(values, types)]
            tables.append(pa.Table.from_arrays(cols_, names=names))
        return pa.concat_tables(tables) if tables else pa.Table.from_arrays([pa.array([], f) for f in types], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(points.schema[s].dataType) for s in scope]
    types += [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), *([pa.binary()] if "dist" in kinds else [])]
    keep = [*scope, "pid", "family", "z"] + ([labels] if labels else [])
    schema = key_ddl(points, scope) + "kind string, pid long, key long, fam string, n long, s1 double, s2 double" + (", data binary" if "dist" in kinds else "")
    bytes_ = 8 * F.max(F.size("z")) * (2 if "jac" in kinds else 1)
    if "fam" in kinds:
        bytes_ = bytes_ + 16 * F.approx_count_distinct("family")
    if labels:
        bytes_ = bytes_ + 8 * F.max(F.size(labels))
    return self_tiles(points.select(*keep), scope, "pid", kernel, schema, block_rows, bytes_)


# ---- moments of within / between distances -------------------------------------------------


def pair_moments(points: DataFrame, scope: Sequence[str], metric: str, stats: DataFrame | None = None, block_rows: int | None = None) -> DataFrame:
    """``scope, same, n, s1, s2``: count, sum and square sum of pair distances by family equality.

    Cosine needs no pair work: with unit vectors u and M = sum u u', the pair sums
    of u.v and (u.v)^2 are (|sum u|^2 - n)/2 and (|M|_F^2 - n)/2.
    """
    scope = list(scope)
    if metric != "cosine":
        stats = stats if stats is not None else tile_stats(points, scope, metric, {"mom"}, block_rows=block_rows)
        m = stats.where("kind = 'mom'")
        return m.groupBy(*scope, F.col("key").alias("same")).agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))

    units = points.withColumn("u", l2_normalize("z")).withColumn("live", F.exists("z", lambda x: x != 0).cast("double"))
    per = moments(units, [*scope, "family"], "u")
    live = units.groupBy(*scope, "family").agg(F.sum("live").alias("live"))

    def sums(n, mu, m2, live_n):
        total = n * mu
        raw = np.asarray(m2).reshape(len(mu), len(mu)) + n * np.outer(mu, mu)
        return total, raw, live_n

    ddl = key_ddl(points, scope) + "family string, n long, live double, total array<double>, raw array<double>, w1 double, w2 double"

    def finish(batches):
        for pdf in batches:
            rows = [sums(n, np.asarray(mu), m2, lv) for n, mu, m2, lv in zip(pdf["n"], pdf["mu"], pdf["m2"], pdf["live"])]
            yield pdf[[*scope, "family", "n", "live"]].assign(
                total=[r[0] for r in rows], raw=[r[1].ravel() for r in rows],
                w1=[(r[0] @ r[0] - r[2]) / 2 for r in rows], w2=[((r[1] ** 2).sum() - r[2]) / 2 for r in rows],
            )

    fam = materialize(per.join(live, [*scope, "family"]).select(*scope, "family", "n", "live", "mu", "m2").mapInPandas(finish, ddl))
    # Per scope: add the family vectors up again (one row per family, entry-wise sums).
    entry = fam.select(*scope, F.posexplode("raw").alias("i", "v")).groupBy(*scope, "i").agg(F.sum("v").alias("v"))
    norm2 = entry.groupBy(*scope).agg(F.sum(F.col("v") * F.col("v")).alias("m_sq"))
    head = fam.select(*scope, F.posexplode("total").alias("i", "v")).groupBy(*scope, "i").agg(F.sum("v").alias("v"))
    norm1 = head.groupBy(*scope).agg(F.sum(F.col("v") * F.col("v")).alias("t_sq"))
    agg = fam.groupBy(*scope).agg(
        F.sum("n").alias("n"), F.sum("live").alias("live"), F.sum("w1").alias("c1"), F.sum("w2").alias("c2"),
        F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("nw"),
    )
    if scope:
        both = agg.join(norm1, scope).join(norm2, scope)
    else:
        both = agg.withColumn("t_sq", norm1.scalar()).withColumn("m_sq", norm2.scalar())
    all_pairs = F.col("n") * (F.col("n") - 1) / 2
    a1, a2 = (F.col("t_sq") - F.col("live")) / 2, (F.col("m_sq") - F.col("live")) / 2

    def row(flag, n, c1, c2):
        return F.struct(
            F.lit(flag).cast("long").alias("same"), n.cast("long").alias("n"), (n - c1).alias("s1"), (n - 2 * c1 + c2).alias("s2")
        )

    rows = F.array(row(1, F.col("nw"), F.col("c1"), F.col("c2")), row(0, all_pairs - F.col("nw"), a1 - F.col("c1"), a2 - F.col("c2")))
    return both.select(*scope, F.inline(rows)).where("n > 0")


def separation(mom: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Pair counts, within / between means, their margin and Cohen's d (NULL where undefined)."""

    def part(flag, c):
        return F.sum(F.when(F.col("same") == flag, F.col(c)))

    g = mom.groupBy(*scope).agg(
        *[F.coalesce(part(f, "n"), F.lit(0)).alias(f"n{f}") for f in (0, 1)],
        *[part(f, c).alias(f"{c}_{f}") for f in (0, 1) for c in ("s1", "s2")],
    )
    mean = {f: F.when(F.col(f"n{f}") > 0, F.col(f"s1_{f}") / F.col(f"n{f}")) for f in (0, 1)}
    ss = {f: F.greatest(F.col(f"s2_{f}") - F.col(f"n{f}") * mean[f] * mean[f], F.lit(0.0)) for f in (0, 1)}
    pooled = (ss[0] + ss[1]) / (F.col("n0") + F.col("n1") - 2)
    ok = (F.col("n0") >= 2) & (F.col("n1") >= 2) & (pooled > 0)
    return g.select(
        *scope,
        (F.col("n0") + F.col("n1")).alias("pair_count_used"),
        F.col("n1").alias("pair_count_within"),
        F.col("n0").alias("pair_count_between"),
        mean[1].alias("within_mean_distance"),
        mean[0].alias("between_mean_distance"),
        (mean[0] - mean[1]).alias("separation_margin"),
        F.when(ok, (mean[0] - mean[1]) / F.sqrt(pooled)).alias("cohens_d"),
    )


# ---- rank statistics --------------------------------------------------------------------


def rank_counts(points: DataFrame, scope: Sequence[str], metric: str, block_rows: int | None = None, ties: bool = True) -> DataFrame:
    """``scope, pos, neg, before_pos, before_neg, lost, gain`` along the distance: same-family and other pairs, exactly.

    A row is a set of pairs at one distance, one that needs no finer order, or a range that a task has put in
    order; ``before`` counts the nearer pairs.  ``lost`` and ``gain`` are the set's parts of AUROC and AP.
    While the pairs are few, the tiles return their distinct distances.  Else they return counts of bins first,
    and only bins that hold something to order are looked at again.  Bins that fit one task are strung to ranges:
    the tiles send the packed distances of up to ``PASS_PAIRS`` pairs in a pass (of more points, as many more) and
    a task orders each range.  The more pairs, the finer the first bins; bins that are still too large are cut by
    further bits of the distance.  What leaves the tiles in a pass grows with the points, and so do the passes.  Without ``ties`` (enough for AUROC) bins of
    same-family pairs only stay as they are.
    """
    scope = list(scope)
    n = F.count(F.lit(1))
    pairs = points.groupBy(*scope).agg((n * (n - 1) / 2).alias("p")).agg(F.sum("p")).first()[0] or 0
    fits = min(RANGE_PAIRS, PASS_PAIRS)
    ids = points.agg(F.approx_count_distinct("pid")).first()[0] if pairs > fits else 0  # not rows: a point may stand in several scopes
    room = int(PASS_PAIRS * max(1.0, ids / PASS_POINTS))

    def counted(shift: int, parents=None) -> DataFrame:
        t = tile_stats(points, scope, metric, {"hist"}, block_rows=block_rows, shift=shift, parents=parents)
        return t.groupBy(*scope, F.col("key").alias("bin")).agg(F.sum("n").alias("pos"), F.sum("s1").cast("long").alias("neg"))

    def inside(bins: DataFrame, shift: int, above: DataFrame, above_shift: int) -> DataFrame:
        """Add what lies before each bin: before its parent and before it there."""
        key = [*scope, "parent"]
        w = W.partitionBy(*key).orderBy("bin")
        d = bins.withColumn("parent", F.shiftright("bin", above_shift - shift))
        own = {c: (F.sum(c).over(w) - F.col(c)).alias(f"own_{c}") for c in ("pos", "neg")}
        d = d.select("*", *own.values())
        up = above.select(*scope, F.col("bin").alias("parent"), F.col("before_pos").alias("up_pos"), F.col("before_neg").alias("up_neg"))
        d = same_key_join(d, up, key)
        return d.select(*scope, "bin", "pos", "neg", *[(F.col(f"up_{c}") + F.col(f"own_{c}")).alias(f"before_{c}") for c in ("pos", "neg")])

    def judged(d: DataFrame) -> DataFrame:
        here = F.col("before_pos") + F.col("pos")
        lost = F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg") / 2)
        gain = F.when(F.col("pos") > 0, F.col("pos") * (here / (here + F.col("before_neg") + F.col("neg")))).otherwise(0.0)
        return d.select(*scope, "pos", "neg", "before_pos", "before_neg", lost.alias("lost"), gain.alias("gain"))

    shift = 0 if pairs <= fits else FIRST_SHIFT - min(FINER_BITS, max(0, ceil(log2(pairs / fits / 1024))))
    cum = ordered_counts(counted(shift), scope, "bin", ["pos", "neg"], F.shiftright("bin", REFINE_BITS if shift else FIRST_SHIFT))
    level = cum.select(*scope, "bin", "pos", "neg", *[(F.col(f"cum_{c}") - F.col(c)).alias(f"before_{c}") for c in ("pos", "neg")])
    if shift == 0:
        return judged(level)
    level, done = materialize(level), []
    several = (F.col("pos") + F.col("neg") > 1) if ties else (F.col("neg") > 0)
    while True:
        unordered = (F.col("pos") > 0) & several if shift else F.lit(False)
        done.append(judged(level.where(~unordered)))
        small = F.col("pos") + F.col("neg") <= fits
        for ranges in _passes(level, scope, unordered & small, shift, fits, room) if shift else ():
            done.append(materialize(_ordered(points, scope, metric, block_rows, ranges)))
            gc.collect()  # else the pass's shuffle files stay until the driver happens to collect its garbage
            points.sparkSession.sparkContext._jvm.System.gc()
        large = level.where(unordered & ~small)
        known = _prefixes(large, scope)
        if not known:
            break
        finer = max(0, shift - REFINE_BITS)
        level, shift = materialize(inside(counted(finer, (shift, known)), finer, large, shift)), finer
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _passes(level: DataFrame, scope: Sequence[str], wanted: Column, shift: int, fits: int, room: int) -> list[dict[tuple, list[tuple]]]:
    """The wanted bins as ranges of neighbouring bins, (low, high, before_pos, before_neg) by scope, dealt to passes scope by scope."""
    near = [*scope, F.shiftright("bin", REFINE_BITS).alias("_part")]
    w = W.partitionBy(*near).orderBy("bin")
    d = level.withColumn("_island", F.sum(F.when(wanted, 0).otherwise(1)).over(w)).where(wanted)
    place = F.floor((F.col("before_pos") + F.col("before_neg")) / fits).alias("_place")
    found = d.groupBy(*near, "_island", place).agg(
        F.min("bin").alias("low"), (F.max("bin") + 1).alias("high"), F.sum(F.col("pos") + F.col("neg")).alias("size"),
        F.min("before_pos").alias("up_pos"), F.min("before_neg").alias("up_neg"),
    )
    rows = found.orderBy(*scope, "low").collect()  # about one per ``fits`` pairs, and no more than bins
    rounds, before = -(-sum(r["size"] for r in rows) // room), 0
    turns: list[dict[tuple, list[tuple]]] = [{} for _ in range(rounds)]
    for r in rows:
        mine = turns[min(before // room, rounds - 1)]
        mine.setdefault(tuple(r[s] for s in scope), []).append((r["low"] << shift, r["high"] << shift, r["up_pos"], r["up_neg"]))
        before += r["size"]
    return [t for t in turns if t]


# Scopes of a pass that are picked by name; with more of them every scope goes to the tiles.
NAMED_SCOPES = 100


def _ordered(points: DataFrame, scope: Sequence[str], metric: str, block_rows: int | None, ranges: dict[tuple, list[tuple]]) -> DataFrame:
    """One pass: a row per range, its pairs ordered by one task."""
    if scope and len(ranges) <= NAMED_SCOPES:
        here = F.lit(False)
        for values in ranges:
            mine = F.lit(True)
            for name, v in zip(scope, values):
                mine = mine & F.col(name).eqNullSafe(F.lit(v).cast(points.schema[name].dataType))
            here = here | mine
        points = points.where(here)
    ends = {k: tuple(np.array([x[i] for x in v], np.int64) for i in (0, 1)) for k, v in ranges.items()}
    sent = points.sparkSession.sparkContext.broadcast(ranges)
    t = tile_stats(points, scope, metric, {"dist"}, block_rows=block_rows, shift=0, ranges=ends)
    t = t.select(*scope, "key", "n", "s1", "s2", "data")
    names = [*scope, "pos", "neg", "before_pos", "before_neg", "lost", "gain"]

    def order(key: tuple, table: pa.Table) -> pa.Table:
        values = tuple(k.as_py() for k in key)
        low, high, up_pos, up_neg = sent.value[values[:-1]][values[-1]]
        parts: dict[bool, list] = {True: [], False: []}
        for chunk in table.to_batches():
            for same, m, data in zip(chunk.column("s1").to_pylist(), chunk.column("s2").to_pylist(), chunk.column("data")):
                parts[same == 1.0].append(unpack(data.as_buffer(), int(m), low))
        pieces = 1 + sum(len(k) for own in parts.values() for k, _ in own) // SORT_KEYS  # sorted one by one in a core's cache
        cuts = np.array([low + (high - low) * i // pieces for i in range(pieces)] + [high], np.int64)
        cells = [0, 0, up_pos, up_neg, 0.0, 0.0]
        split = {same: [(k, c, np.searchsorted(k, cuts)) for k, c in own] for same, own in parts.items()}
        for i in range(pieces):
            cut = lambda own: [(k[at[i] : at[i + 1]], c if c is None else c[at[i] : at[i + 1]]) for k, c, at in own if at[i] < at[i + 1]]  # noqa: B023, E731
            (pos, p), (neg, q) = merged(cut(split[True])), merged(cut(split[False]))
            upto = np.concatenate([[0], np.cumsum(q)])
            nearer, upto_here = upto[np.searchsorted(neg, pos)], upto[np.searchsorted(neg, pos, "right")]
            here, before = up_pos + cells[0] + np.cumsum(p), up_neg + cells[1]
            cells[4] += float(p.sum()) * before + float((p * (nearer + upto_here)).sum()) / 2
            cells[5] += float((p * (here / (here + before + upto_here))).sum())
            cells[0] += int(p.sum())
            cells[1] += int(q.sum())
        return pa.Table.from_arrays([*[pa.array([v], k.type) for v, k in zip(values, key)][:-1], *[pa.array([c]) for c in cells]], names=names)

    ddl = key_ddl(points, scope) + "pos long, neg long, before_pos long, before_neg long, lost double, gain double"
    return spread(t, *scope, "key").groupBy(*scope, "key").applyInArrow(order, ddl)


def _prefixes(bins: DataFrame, scope: Sequence[str]) -> dict[tuple, np.ndarray]:
    """Sorted bins by scope; a pass holds at most half as many as its pairs."""
    out: dict[tuple, list[int]] = {}
    for r in bins.select(*scope, "bin").toLocalIterator():
        out.setdefault(tuple(r[s] for s in scope), []).append(r["bin"])
    return {k: np.sort(np.array(v, np.int64)) for k, v in out.items()}


def pair_auroc(ranks: DataFrame, scope: Sequence[str]) -> DataFrame:
    """AUROC of 'same family' for the score -distance; NULL when a class is missing.

    A same-family pair beats every farther pair of different families and half of the equal ones.
    """
    both = F.sum(F.col("pos").cast("double")) * F.sum(F.col("neg").cast("double"))
    return ranks.groupBy(*scope).agg(F.when(both > 0, 1 - F.sum("lost") / both).alias("auroc"))


def average_precision(ranks: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Sum over distances (nearest first) of recall gain times precision; NULL when a class is missing."""
    gain = F.sum("gain")
    return ranks.groupBy(*scope).agg(
        F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), gain / F.sum("pos")).alias("average_precision")
    )


# ---- neighbours -------------------------------------------------------------------------


def nearest_neighbours(stats: DataFrame, points: DataFrame, scope: Sequence[str], k: int) -> DataFrame:
    """``scope, pid, family, rank, neighbour, neighbour_family, distance`` for the k nearest others.

    Tiles kept k candidates each; ranking keeps k per point before it shuffles.
    """
    w = W.partitionBy(*scope, "pid").orderBy("s1", "key")
    nn = stats.where("kind = 'nn'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    nn = nn.select(*scope, "pid", "rank", F.col("key").alias("neighbour"), F.col("fam").alias("neighbour_family"), F.col("s1").alias("distance"))
    return nn.join(points.select(*scope, "pid", "family"), [*scope, "pid"])


def knn_purity(nn: DataFrame, sizes: DataFrame, scope: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """Mean and median same-family share among the k nearest; NULL when k is not below the scope size.

    A share takes at most k + 1 values, so the median comes from counts of values.
    """
    same = (F.col("family") == F.col("neighbour_family")).cast("double")
    per = nn.withColumn("same", same).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k")
    share = per.groupBy(*scope, "k", "pid").agg(F.avg("same").alias("share"))
    counts = share.groupBy(*scope, "k", "share").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(*scope, "k")
    cum = counts.withColumn("hi", F.sum("c").over(w.orderBy("share"))).withColumn("tot", F.sum("c").over(w))
    at = lambda pos: F.max(F.when((pos >= F.col("hi") - F.col("c")) & (pos < F.col("hi")), F.col("share")))
    mid = (at(F.floor((F.col("tot") - 1) / 2)) + at(F.ceil((F.col("tot") - 1) / 2))) / 2
    got = cum.groupBy(*scope, "k").agg(
        (F.sum(F.col("share") * F.col("c")) / F.sum("c")).alias("purity_mean"), mid.alias("purity_median")
    )
    spine = sizes.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    valid = (F.col("k") > 0) & (F.col("k") < F.col("n_points"))
    return spine.join(got, [*scope, "k"], "left").select(
        *scope, "k", F.when(valid, F.col("purity_mean")).alias("purity_mean"), F.when(valid, F.col("purity_median")).alias("purity_median")
    )


def misfits(nn: DataFrame) -> DataFrame:
    """Nearest-neighbour rows with ``misfit``: the neighbour belongs to another family."""
    return nn.where("rank = 1").withColumn("misfit", F.col("family") != F.col("neighbour_family"))


def misfit_examples(flags: DataFrame, scope: Sequence[str], limit: int = 25) -> DataFrame:
    """The first ``limit`` misfits per scope by point id."""
    w = W.partitionBy(*scope).orderBy("pid")
    out = flags.where("misfit").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
    return out.select(*scope, "pid", "family", "neighbour", "neighbour_family", "distance")


# ---- centroids and silhouettes -----------------------------------------------------------


def family_sums(points: DataFrame, scope: Sequence[str], unit: bool = False) -> DataFrame:
    """``scope, fam, n, total``: per family row count and vector sum (optionally of unit vectors)."""
    from .fit import mean_var

    src = points.withColumn("z", l2_normalize("z")) if unit else points
    stats = mean_var(src.select(*scope, F.col("family").alias("fam"), "z"), [*scope, "fam"])
    return stats.select(*scope, "fam", "n", F.transform("mu", lambda m: m * F.col("n")).alias("total"))


# A model of at most this many numbers goes to every task; larger ones meet the points block by block.
MAX_FAMILY_VALUES = 4_000_000
MODEL_BLOCK_VALUES = 500_000
POINT_BLOCK_ROWS = 8192


def _scope_tables(sums: DataFrame, scope: Sequence[str], max_values: int) -> dict | None:
    """Family sums per scope as arrays, counted before they leave the cluster; None when there are too many."""
    size = sums.agg(F.sum(F.size("total"))).first()[0] or 0
    if size > max_values:
        return None
    out: dict = {}
    for r in sums.orderBy(*scope, "fam").collect():
        out.setdefault(tuple(r[s] for s in scope), []).append((r["fam"], r["n"], r["total"]))
    return {
        k: ([f for f, _, _ in v], np.array([n for _, n, _ in v], float), np.array([t for _, _, t in v])) for k, v in out.items()
    }


def _with_families(points: DataFrame, scope: Sequence[str], unit: bool, max_values: int, fn, merge: dict[str, Column]) -> DataFrame:
    """Add columns ``_a``, ``_b`` (double) and ``_f`` (family) that ``fn`` finds for each point among its scope's families.

    ``fn(x, own, n, total)`` returns two arrays and a position (-1: none); ``own`` is the position of the point's
    family, -1 where this block of families does not hold it.  ``merge`` joins the blocks' results.
    """
    scope = list(scope)
    sums = materialize(family_sums(points, scope, unit))
    tables = _scope_tables(sums, scope, max_values)
    found = "_a double, _b double, _f string"

    def result(x, fams, names, n, total) -> list[pa.Array]:
        pos = {f: j for j, f in enumerate(names)}
        a, b, best = fn(x, np.array([pos.get(f, -1) for f in fams], int), n, total)
        nan = lambda v: pa.array(v, pa.float64(), mask=np.isnan(v))
        return [nan(a), nan(b), pa.array([names[k] if k >= 0 else None for k in best], pa.string())]

    if tables is not None:

        @arrow_udf(f"struct<{found.replace(' ', ':').replace(',:', ',')}>")
        def look_up(key: pa.Array, fam: pa.Array, z: pa.Array) -> pa.Array:
            keys = list(zip(*[key.field(i).to_pylist() for i in range(key.type.num_fields - 1)])) if key.type.num_fields > 1 else [()] * len(z)
            index: dict = {}
            for i, k in enumerate(keys):
                index.setdefault(k, []).append(i)
            x, own = matrix(z), fam.to_pylist()
            parts, order = [], []
            for k, rows in index.items():
                parts.append(result(x[rows], [own[i] for i in rows], *tables[k]))
                order += rows
            back = pa.array(np.argsort(order, kind="stable"))
            kinds = [pa.float64(), pa.float64(), pa.string()]
            cols = [pa.concat_arrays([p[c] for p in parts]).take(back) if parts else pa.array([], kinds[c]) for c in range(3)]
            return pa.StructArray.from_arrays(cols, ["_a", "_b", "_f"])

        out = points.withColumn("_r", look_up(F.struct(*scope, F.lit(0).alias("_one")), F.col("family"), F.col("z")))
        return out.select(*points.columns, "_r.*")

    # Own row numbers, as ids may repeat; stored, as both uses must see the same numbers.
    by = scope or ["_one"]
    pts = points if scope else points.withColumn("_one", F.lit(0))
    pts = materialize(pts.withColumn("_row", F.monotonically_increasing_id()))
    model = sums if scope else sums.withColumn("_one", F.lit(0))
    width = sums.select(F.max(F.size("total"))).first()[0] or 1

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("_row", pa.int64()), ("_a", pa.float64()), ("_b", pa.float64()), ("_f", pa.string())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        b = b.sort_by("fam")
        got = result(matrix(a.column("z")), a.column("family").to_pylist(), b.column("fam").to_pylist(), b.column("n").to_numpy().astype(float), matrix(b.column("total")))
        return pa.Table.from_arrays([a.column("_row").combine_chunks(), *got], schema=schema)

    parts = scoped_cross_tiles(
        pts.select(*by, "_row", "family", "z"), model, by, "_row", "fam", kernel, f"_row long, {found}", POINT_BLOCK_ROWS, max(1, MODEL_BLOCK_VALUES // width)
    )
    best = parts.groupBy("_row").agg(*[c.alias(name) for name, c in merge.items()])
    return pts.join(best, "_row", "left").select(*points.columns, *merge)


def loo_centroid(points: DataFrame, scope: Sequence[str], metric: str, max_values: int | None = None) -> DataFrame:
    """Nearest family centroid with the point itself left out: adds ``pred`` (NULL if no family is eligible).

    The own centroid is (S - x)/(n - 1); a singleton family is skipped for its own
    member; equal distances go to the family that sorts first.
    """

    def to_rows(x, c):
        if metric == "l2":
            return np.sqrt(((x - c) ** 2).sum(axis=1))
        den = np.linalg.norm(x, axis=1) * np.linalg.norm(c, axis=1)
        return np.where(den <= 1e-12, 1.0, 1.0 - (x * c).sum(axis=1) / np.maximum(den, 1e-300))

    def predict(x, own, n, total):
        mean = total / n[:, None]
        if metric == "l2":
            d = distances(x, mean, "l2")
        else:
            den = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(mean, axis=1)[None, :]
            d = np.where(den <= 1e-12, 1.0, 1.0 - (x @ mean.T) / np.maximum(den, 1e-300))
        mine = np.nonzero(own >= 0)[0]
        f = own[mine]
        rest = np.maximum(n[f] - 1, 1)
        d[mine, f] = np.where(n[f] > 1, to_rows(x[mine], (total[f] - x[mine]) / rest[:, None]), np.inf)
        best = d.argmin(axis=1)
        low = d[np.arange(len(x)), best]
        return np.where(np.isfinite(low), low, np.nan), np.full(len(x), np.nan), np.where(np.isfinite(low), best, -1)

    merge = {"_a": F.min("_a"), "_f": F.min(F.when(F.col("_f").isNotNull(), F.struct("_a", "_f")))["_f"]}
    out = _with_families(points, scope, False, MAX_FAMILY_VALUES if max_values is None else max_values, predict, merge)
    return out.select(*points.columns, F.col("_f").alias("pred"), F.coalesce("_a", F.lit(float("inf"))).alias("pred_distance"))


def accuracy_and_f1(pred: DataFrame, scope: Sequence[str], truth: str = "family", guess: str = "pred") -> DataFrame:
    """Accuracy and macro-F1 (every label seen in truth or prediction counts once)."""
    p = pred.where(F.col(guess).isNotNull())
    conf = p.groupBy(*scope, truth, guess).agg(F.count(F.lit(1)).alias("c"))
    sides = conf.select(
        *scope,
        F.inline(
            F.array(
                F.struct(F.col(truth).alias("lab"), F.when(F.col(truth) == F.col(guess), F.col("c")).otherwise(0).alias("tp"), F.col("c").alias("t"), F.lit(0).cast("long").alias("g")),
                F.struct(F.col(guess).alias("lab"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("t"), F.col("c").alias("g")),
            )
        ),
    )
    per = sides.groupBy(*scope, "lab").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("g").alias("g"))
    f1 = 2 * F.col("tp") / (F.col("t") + F.col("g"))
    return per.groupBy(*scope).agg((F.sum("tp") / F.sum("t")).alias("loo_accuracy"), F.avg(f1).alias("loo_macro_f1"))


def silhouette_values(points: DataFrame, scope: Sequence[str], max_values: int | None = None) -> DataFrame:
    """``points`` with ``_v``, the cosine silhouette of each; 0 for the member of a one-point family and without another family."""

    def score(x, own, n, total):
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        s = u @ total.T
        mean = (n[None, :] - s) / n[None, :]
        a = np.full(len(x), np.nan)
        mine = np.nonzero(own >= 0)[0]
        f = own[mine]
        a[mine] = (n[f] - 1 - (s[mine, f] - (u[mine] * u[mine]).sum(axis=1))) / np.maximum(n[f] - 1, 1)
        mean[mine, f] = np.inf
        b = mean.min(axis=1)
        alone = np.full(len(x), -1)
        alone[mine] = np.where(n[f] == 1, f, -1)
        return a, np.where(np.isfinite(b), b, np.nan), alone

    limit = MAX_FAMILY_VALUES if max_values is None else max_values
    per = _with_families(points, scope, True, limit, score, {"_a": F.max("_a"), "_b": F.min("_b"), "_f": F.max("_f")})
    value = (F.col("_b") - F.col("_a")) / F.greatest("_a", "_b", F.lit(1e-300))
    return per.select(*points.columns, F.when(F.col("_b").isNull() | F.col("_f").isNotNull(), 0.0).otherwise(value).alias("_v"))


def silhouette(points: DataFrame, scope: Sequence[str], metric: str, stats: DataFrame | None = None,
               block_rows: int | None = None, max_values: int | None = None) -> DataFrame:
    """Exact mean silhouette; NULL with fewer than two families or with a singleton family.

    Cosine: mean distance from x to family f is (n_f - x.S_f)/n_f with unit vectors, so
    one linear pass suffices.  L2 adds up per-family distances inside tiles.
    """
    scope = list(scope)
    sizes = points.groupBy(*scope, "family").agg(F.count(F.lit(1)).alias("c"))
    guard = sizes.groupBy(*scope).agg((F.count(F.lit(1)) >= 2).alias("_many"), (F.min("c") >= 2).alias("_full"))
    if metric == "cosine":
        got = silhouette_values(points, scope, max_values).groupBy(*scope).agg(F.avg("_v").alias("silhouette"))
    else:
        stats = stats if stats is not None else tile_stats(points, scope, metric, {"fam"}, block_rows=block_rows)
        means = stats.where("kind = 'fam'").groupBy(*scope, "pid", "fam").agg((F.sum("s1") / F.sum("n")).alias("m"))
        own = points.select(*scope, "pid", "family")
        ab = means.join(own, [*scope, "pid"]).groupBy(*scope, "pid").agg(
            F.max(F.when(F.col("fam") == F.col("family"), F.col("m"))).alias("a"),
            F.min(F.when(F.col("fam") != F.col("family"), F.col("m"))).alias("b"),
        )
        s = F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
        got = ab.groupBy(*scope).agg(F.avg(s).alias("silhouette"))
    ok = F.when(F.col("_many") & F.col("_full"), F.col("silhouette")).alias("silhouette")
    if scope:
        return guard.join(got, scope, "left").select(*scope, ok)
    return guard.withColumn("silhouette", got.scalar()).select(ok)


# ---- overlap of the most affected dimensions -----------------------------------------------


def topk_overlap(stats: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Mean overlap of top dimensions within and between families, and the gap."""
    mean = {f: F.sum(F.when(F.col("key") == f, F.col("s1"))) / F.sum(F.when(F.col("key") == f, F.col("n"))) for f in (0, 1)}
    return stats.where("kind = 'jac'").groupBy(*scope).agg(
        mean[1].alias("jaccard_within_mean"), mean[0].alias("jaccard_between_mean"), (mean[1] - mean[0]).alias("jaccard_gap")
    )


# ---- sampled pairs ----------------------------------------------------------------------


def sampled_pairs(points: DataFrame, max_pairs: int, seed: int, metric: str, topk: int | None = None) -> DataFrame:
    """``max_pairs`` distinct pairs drawn evenly from all i<j pairs, with ``distance`` and ``same``.

    The pair numbers 0 .. n(n-1)/2 - 1 are cut into ``max_pairs`` equal strata and one
    number is drawn per stratum from a hash; each is decoded to (i, j) and joined to the
    two points.  Work is linear in points plus pairs.  Small inputs keep every pair.
    """
    from ..functions.vectors import cosine_distance, l2_distance, topk_dims

    numbered = materialize(rank_in_group(points.select("pid", "family", "z"), [], [F.col("pid")], "i"))
    n = numbered.count()
    if n > 3_000_000_000:
        raise ValueError("pair numbers would overflow a long")
    total = n * (n - 1) // 2
    m = min(max_pairs, total) if max_pairs > 0 else total
    spark = points.sparkSession
    width = total // m if m else 0
    extra = total - width * m if m else 0
    s = F.col("id")
    start = s * width + F.least(s, F.lit(extra))
    size = F.when(s < extra, width + 1).otherwise(width)
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), s.cast("string"))), 1, 15), 16, 10).cast("long")
    code = start + F.pmod(u, size)
    side = 2.0 * n - 1
    guess = F.floor((side - F.sqrt(F.lit(side * side) - 8.0 * F.col("code"))) / 2).cast("long")
    first_of = lambda i: i * (2 * n - i - 1) / 2
    fixed = F.when(first_of(guess) > F.col("code"), guess - 1).when(first_of(guess + 1) <= F.col("code"), guess + 1).otherwise(guess)
    pairs = spark.range(m).select(code.cast("long").alias("code")).withColumn("i", fixed)
    pairs = pairs.withColumn("j", (F.col("code") - first_of(F.col("i")) + F.col("i") + 1).cast("long"))
    left = numbered.select("i", F.col("pid").alias("a_pid"), F.col("family").alias("a_family"), F.col("z").alias("a_z"))
    right = numbered.select(F.col("i").alias("j"), F.col("pid").alias("b_pid"), F.col("family").alias("b_family"), F.col("z").alias("b_z"))
    dist = {"l2": l2_distance, "cosine": cosine_distance}[metric]("a_z", "b_z")
    out = pairs.join(left, "i").join(right, "j")
    cols = [F.col("a_pid"), F.col("b_pid"), dist.alias("distance"), (F.col("a_family") == F.col("b_family")).alias("same")]
    if topk:
        cols.append(jaccard(topk_dims("a_z", topk), topk_dims("b_z", topk)).alias("overlap"))
    return out.select(*cols)


# ---- permutation test -------------------------------------------------------------------


def permuted_labels(points: DataFrame, n_perm: int, seed: int, scope: Sequence[str]) -> DataFrame:
    """Points with ``perm``: array of their family code and ``n_perm`` shuffled ones (family sizes are kept).

    A point's number in its scope, by id, is permuted by arithmetic; the first n_1 places
    get the first family, the next n_2 the second, and so on.
    """
    scope = list(scope)
    keys = round_keys(seed, n_perm)
    numbered = rank_in_group(points.select(*scope, "pid", "family", "z"), scope, [F.col("pid")], "i")
    sizes = points.groupBy(*scope, "family").agg(F.count(F.lit(1)).alias("c"))
    by_name = sizes.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("family", "c"))).alias("s"))  # an entry per family
    facts = by_name.select(*scope, F.col("s.family").alias("names"), F.col("s.c").alias("counts"))
    labelled = attach_facts(spread(numbered, *scope, "pid"), facts, scope, ["pid"])  # numbering may have put all rows in one task

    @arrow_udf("array<long>")
    def shuffled(group: pa.Array, i: pa.Array, counts: pa.Array, code: pa.Array) -> pa.Array:
        own = group.to_numpy()
        out = np.empty((len(own), n_perm + 1), np.int64)
        out[:, 0] = code.to_numpy() - 1
        for g in np.unique(own):
            rows = np.nonzero(own == g)[0]
            edges = np.cumsum(counts[int(rows[0])].as_py())
            out[rows, 1:] = np.searchsorted(edges, places(i.to_numpy()[rows], int(edges[-1]), keys), "right")
        return pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * (n_perm + 1)), pa.array(out.ravel()))

    perm = shuffled(F.xxhash64(*scope), F.col("i"), F.col("counts"), F.array_position("names", F.col("family")))
    return labelled.select(*scope, "pid", "family", "z", F.size("names").alias("n_families"), perm.alias("perm"))


def permutation_pvalue(points: DataFrame, metric: str, n_perm: int, seed: int, block_rows: int | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """Share of label shuffles whose margin reaches the observed one: (count + 1) / (valid + 1), per scope.

    Columns ``scope, valid, count_ge, pvalue``; shuffles stay inside a scope.  Family sizes
    never change, so a shuffle is judged by its within-family distance sum.  Cosine uses
    label sums in one linear pass; L2 uses tiles.  Points are numbered once and no row is
    moved per shuffle.  A scope of one family or of one-point families has no valid shuffle.
    """
    by = list(scope) or ["_one"]
    pts = points if scope else points.withColumn("_one", F.lit(0))
    labelled = materialize(permuted_labels(pts, n_perm, seed, by))
    if metric == "cosine":
        sums = _label_sums(labelled, by)
    else:
        t = tile_stats(labelled, by, metric, {"perm"}, labels="perm", block_rows=block_rows).where("kind = 'perm'")
        sums = t.groupBy(*by, "key").agg(F.sum("s1").alias("within"))
    sums = materialize(sums)  # read twice below, and each reading would walk all pairs again
    sizes = pts.groupBy(*by, "family").agg(F.count(F.lit(1)).alias("c"))
    shape = sizes.groupBy(*by).agg(
        F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("nw"),
        (F.sum("c") * (F.sum("c") - 1) / 2).alias("na"),
    )
    observed = sums.where("key = 0").select(*by, F.col("within").alias("obs"))
    judged = same_key_join(same_key_join(sums.where("key > 0"), observed, by), shape, by)
    # A tolerance keeps shuffles that reproduce the observed split from falling on either side.
    reach = F.col("within") <= F.col("obs") + 1e-9 * F.abs("obs")
    valid = (F.col("nw") > 0) & (F.col("na") > F.col("nw"))
    out = judged.groupBy(*by).agg(F.count(F.when(valid, 1)).alias("valid"), F.count(F.when(valid & reach, 1)).alias("count_ge"))
    out = out.withColumn("pvalue", F.when(F.col("valid") > 0, (F.col("count_ge") + 1) / (F.col("valid") + 1)))
    return out if scope else out.drop("_one")


LABEL_CELLS = 4_000_000
# Rows of a step of label sums; it has four times as many columns.
LABEL_ROWS = 256
# Up to so many families a product with label columns is cheaper than comparing labels pair by pair.
DENSE_LABELS = 32


def _label_sums(labelled: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Per scope and label slot the within-group sum of cosine distances, from unit-vector sums per (slot, code)."""
    scope = list(scope)

    def partial(batches):
        store: dict[int, np.ndarray] = {}
        for batch in batches:
            x = matrix(batch.column("z"))
            if not len(x):
                continue
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            u = np.where(norm > 0, x / np.maximum(norm, 1e-300), 0.0)
            row = np.concatenate([u, np.ones((len(u), 1)), (u * u).sum(axis=1, keepdims=True)], axis=1)
            lab, group, n_fam = matrix(batch.column("perm")), batch.column("g").to_numpy(), batch.column("n_families").to_numpy()
            for g in np.unique(group).tolist():
                mine = np.nonzero(group == g)[0]
                fam = int(n_fam[mine[0]])
                if g not in store:
                    store[g] = np.zeros((lab.shape[1], fam, row.shape[1]))
                several = max(1, LABEL_CELLS // (fam * len(mine)))
                for lo in range(0, lab.shape[1], several):  # many slots in one product
                    codes = lab[mine, lo : lo + several]
                    onehot = np.zeros((codes.shape[1] * fam, len(mine)))
                    onehot[codes + np.arange(codes.shape[1]) * fam, np.arange(len(mine))[:, None]] = 1.0
                    store[g][lo : lo + several] += (onehot @ row[mine]).reshape(codes.shape[1], fam, -1)
            if sum(v.size for v in store.values()) > 16 * LABEL_CELLS:
                yield from flushed(store)
        yield from flushed(store)

    def flushed(store):
        while store:
            g, sums = store.popitem()
            for slot in range(len(sums)):
                code, i = (a.ravel() for a in np.indices(sums[slot].shape))
                cols = [np.full(code.shape, g), np.full(code.shape, slot), code, i, sums[slot].ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["g", "key", "code", "i", "v"])

    group = F.xxhash64(*scope)
    parts = labelled.select(group.alias("g"), "z", "perm", "n_families").mapInArrow(partial, "g long, key long, code long, i long, v double")
    entry = parts.groupBy("g", "key", "code", "i").agg(F.sum("v").alias("v"))
    last = F.max("i").over(W.partitionBy("g", "key", "code"))  # entries of one vector
    e = entry.withColumn("w", last)
    sq = F.sum(F.when(F.col("i") < F.col("w") - 1, F.col("v") * F.col("v")))
    cnt = F.sum(F.when(F.col("i") == F.col("w") - 1, F.col("v")))
    live = F.sum(F.when(F.col("i") == F.col("w"), F.col("v")))
    per = e.groupBy("g", "key", "code").agg((cnt * (cnt - 1) / 2 - (sq - live) / 2).alias("within"))
    sums = per.groupBy("g", "key").agg(F.sum("within").alias("within"))
    names = labelled.select(*scope, group.alias("g")).distinct()  # one row per scope
    return sums.join(names, "g").drop("g")
