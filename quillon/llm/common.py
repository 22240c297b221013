"""Byte-level hashing and array helpers shared by the operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.operators.graph import connected_components
from quillon.storage import discard, materialize, remove_shuffles

__all__ = ["connected_components", "discard", "materialize", "remove_shuffles"]


_STEADY: list[bool] = []


def steady_memory() -> None:
    """Makes this worker give freed arrays back to the machine at once.

    Workers are kept for later tasks; without this, each holds on to the most
    it ever used, and several of them share an executor's memory.
    """
    if _STEADY:
        return
    _STEADY.append(True)
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        import ctypes

        libc = ctypes.CDLL(None)
        for option, value in ((-3, 2 << 20), (-1, 8 << 20), (-8, 2)):  # mmap and trim thresholds, arenas
            libc.mallopt(option, value)
    except (OSError, AttributeError):  # another C library
        pass


def is_valid_vector(v: Column) -> Column:
    """Not null, not empty, not all zero, no null and no non-finite component."""
    inf = F.lit(float("inf"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


# --------------------------------------------------------------------- bytes

MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POW: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, 1 << 16)
        inv = pow(_BASE, -1, 1 << 64)
        for name, base in (("p", _BASE), ("q", inv)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _POW[name] = np.multiply.accumulate(a)
    return _POW["p"][:n], _POW["q"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s], times the inverse power of s, a hash of data[s:e]."""
    p, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * p, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, q = _powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * q[start] + (end - start).astype(np.uint64))


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + lengths[i] - 1, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def text_chunks(column: pa.Array, limit: int = 1 << 20):
    """Yields (first, last, bytes, offsets) of runs of whole texts of about ``limit`` bytes.

    ``offsets`` has last - first + 1 entries into ``bytes``; a null is an empty
    text.  A text longer than the limit is a run of its own.
    """
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide) if column.type != wide else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if wide == pa.large_binary() else "")
    n = len(column)
    if n == 0:
        return
    _, off_buf, data_buf = column.buffers()
    off = np.frombuffer(off_buf, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in a chunk, and where each text's words begin."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~_SPACE[data]
    begin = inside[1:] & ~inside[:-1]
    finish = ~inside[1:] & inside[:-1]
    # a text's border parts words that touch
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[inside[cut] & inside[cut + 1]] if len(cut) else cut
    begin[cut] = True
    finish[cut] = True
    starts = np.flatnonzero(begin[:n]) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(finish)
    return starts, ends, np.searchsorted(starts, offsets)


def runs_of(batches, n_keys: int):
    """Yields (key, table) for each run of equal values in the first ``n_keys`` integer columns.

    For partitions that are sorted by those columns: a run is held whole, the
    rows of other runs are not.
    """
    key, parts = None, []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        bounds = [0, *cuts.tolist(), n]
        for s, e in zip(bounds[:-1], bounds[1:]):
            k = tuple(keys[s].tolist())
            if k != key and parts:
                yield key, pa.Table.from_batches(parts)
                parts = []
            key = k
            parts.append(batch.slice(s, e - s))
    if parts:
        yield key, pa.Table.from_batches(parts)


def union_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each node's component, for links a[i] - b[i] among 0 .. n-1."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        a, b = a[open_], b[open_]
    return root
