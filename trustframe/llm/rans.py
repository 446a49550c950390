"""Static range asymmetric numeral coding of id streams, vectorised over lanes and blocks.

A block holds up to ``BLOCK`` ids; id ``j`` belongs to lane ``j % LANES``.  Each block starts from its own
lane states, so any block decodes alone (a checkpoint).  All blocks of a call run side by side.
"""

from __future__ import annotations

import zlib

import numpy as np

BITS = 20
SCALE = 1 << BITS
LANES = 32
GROUP = 128  # blocks coded side by side
BLOCK = 16_384
LOW = np.uint64(1 << 31)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Scaled frequencies that sum to ``SCALE``; every id that occurs keeps at least 1."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.int64)
    f = np.where(counts > 0, np.maximum(1, np.floor(counts * (SCALE / total)).astype(np.int64)), 0)
    order = np.argsort(-counts, kind="stable")
    spare, k = SCALE - int(f.sum()), 0
    while spare:  # frequent ids carry the rounding
        i = order[k % len(order)]
        step = spare if spare > 0 else -min(-spare, int(f[i]) // 2)
        if f[i] + step >= 1:
            f[i] += step
            spare -= step
        k += 1
    return f


class Table:
    """Shared frequency table: frequencies, cumulative starts and the slot lookup."""

    def __init__(self, f: np.ndarray):
        self.f = f.astype(np.uint64)
        self.start = (np.cumsum(f) - f).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(f), dtype=np.int32), f)
        self.crc = zlib.crc32(f.astype("<u4").tobytes())


def encode(ids: np.ndarray, table: Table) -> list[tuple[int, bytes, bytes, int]]:
    """Blocks (ids, lane states, words, checksum of the ids) of a stream."""
    out = []
    group = GROUP * BLOCK
    for at in range(0, len(ids), group):
        out += _encode(ids[at : at + group], table)
    return out


def _encode(ids: np.ndarray, t: Table):
    n = len(ids)
    blocks = -(-n // BLOCK)
    steps = BLOCK // LANES if blocks > 1 else -(-n // LANES)
    width = steps * LANES
    padded = np.zeros(blocks * width, np.int32)
    padded[:n] = ids
    grid = np.ascontiguousarray(padded.reshape(blocks, steps, LANES).transpose(1, 0, 2))
    live = (np.arange(blocks * width) < n).reshape(blocks, steps, LANES).transpose(1, 0, 2)
    x = np.full((blocks, LANES), LOW, np.uint64)
    words = np.empty((steps, blocks, LANES), np.uint32)
    sent = np.empty((steps, blocks, LANES), bool)
    full = live.all(axis=(1, 2))
    for s in range(steps - 1, -1, -1):
        sym = grid[s]
        f, start = t.f.take(sym), t.start.take(sym)
        if not full[s]:
            f = np.where(live[s], f, np.uint64(1))
        over = x >= (f << np.uint64(63 - BITS))
        if not full[s]:
            over &= live[s]
        sent[s] = over
        words[s] = x
        np.right_shift(x, np.uint64(32), out=x, where=over)
        q = x // f
        y = (q << np.uint64(BITS)) + (x - q * f) + start
        x = y if full[s] else np.where(live[s], y, x)
    out = []
    for b in range(blocks):
        part = ids[b * BLOCK : (b + 1) * BLOCK]
        out.append((len(part), x[b].astype("<u8").tobytes(), words[:, b][sent[:, b]].astype("<u4").tobytes(), zlib.crc32(part.astype("<u4").tobytes())))
    return out


def decode(blocks: list[tuple[int, bytes, bytes, int]], table: Table) -> np.ndarray:
    """The ids of blocks in order; a wrong checksum raises ``ValueError``."""
    out = [_decode(blocks[k : k + GROUP], table) for k in range(0, len(blocks), GROUP)]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _decode(blocks, t: Table) -> np.ndarray:
    counts = np.array([b[0] for b in blocks])
    steps = -(-int(counts.max()) // LANES)
    x = np.stack([np.frombuffer(b[1], "<u8") for b in blocks]).astype(np.uint64)
    words = np.frombuffer(b"".join(b[2] for b in blocks) + bytes(4), "<u4").astype(np.uint64)
    ptr = np.cumsum([0] + [len(b[2]) // 4 for b in blocks[:-1]])
    grid = np.empty((steps, len(blocks), LANES), np.int32)
    lane = np.arange(LANES)
    whole = int(counts.min()) // LANES  # steps that are full in every block
    mask = np.uint64(SCALE - 1)
    for s in range(steps):
        slot = x & mask
        sym = t.slots.take(slot.view(np.int64))
        grid[s] = sym
        y = t.f.take(sym) * (x >> np.uint64(BITS)) + slot - t.start.take(sym)
        need = y < LOW
        if s >= whole:
            live = (s * LANES + lane)[None, :] < counts[:, None]
            need &= live
            y = np.where(live, y, x)
        i, j = np.nonzero(need)  # in block order, lanes ascending: the order of the words
        each = np.bincount(i, minlength=len(blocks))
        at = ptr[i] + np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each)
        y[i, j] = (y[i, j] << np.uint64(32)) | words[at]
        ptr = ptr + each
        x = y
    parts = [grid[:, k].reshape(-1)[:n] for k, n in enumerate(counts)]
    for part, b in zip(parts, blocks):
        if zlib.crc32(part.astype("<u4").tobytes()) != b[3]:
            raise ValueError("block checksum differs")
    return np.concatenate(parts)
