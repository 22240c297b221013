"""Packing token streams into fixed windows by minimum bin slack.

A document's ids are cut into full windows and one remaining piece.  Pieces
wait in a histogram of lengths; a window is opened with the longest, and a
bitset subset-sum dynamic programme over the remaining lengths finds the
multiset that fills it closest to capacity.  The counts of that multiset are
backtracked, and the same pattern is used for as many windows as the
histogram allows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import steady_memory

CAPACITY = 2048
#: Pieces that a task packs at a time; only their numbers are held, not ids.
POOL = 200_000
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
    " sequence_id bigint, offset bigint"
)


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Length -> count, of a multiset from ``counts`` whose sum is largest within ``capacity``.

    Bit s of ``reach`` says that sum s can be made.  Longer lengths come first;
    a length's copies are added in binary portions, so a length costs a few
    shifts.  The states before each length serve to backtrack.
    """
    mask, full = (1 << (capacity + 1)) - 1, 1 << capacity
    reach, states = 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        before, left, portion = reach, min(counts[length], capacity // length), 1
        while left:
            take = min(portion, left)
            reach |= (reach << (length * take)) & mask
            left, portion = left - take, portion * 2
        states.append((length, before))
        if reach & full:
            break
    total, out = reach.bit_length() - 1, {}
    for length, before in reversed(states):
        n = 0
        while not (before >> total) & 1:
            total, n = total - length, n + 1
        if n:
            out[length] = n
    return out


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece (all of 1 .. capacity), and the number of windows."""
    order = np.argsort(lengths, kind="stable")
    values, first, counts = np.unique(lengths[order], return_index=True, return_counts=True)
    left = dict(zip(values.tolist(), counts.tolist()))
    at = dict(zip(values.tolist(), first.tolist()))
    window, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    while left:
        longest = max(left)
        rest = {k: v - (k == longest) for k, v in left.items() if v - (k == longest)}
        pattern = best_fill(rest, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        for _ in range(times):
            pos = 0
            for k in sorted(pattern, reverse=True):
                for _ in range(pattern[k]):
                    i = order[at[k]]
                    window[i], offset[i] = made, pos
                    at[k] += 1
                    pos += k
            made += 1
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return window, offset, made


class Encoder:
    """Ids of the byte-level BPE in ``ranks_path``, with the end-of-text string as one id."""

    def __init__(self, ranks_path: str, pattern: str, special: str = "<|endoftext|>"):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = special
        self.bpe = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={special: len(ranks)}
        )

    def __call__(self, text: str) -> list[int]:
        if self.special in text:
            return self.bpe.encode(text, allowed_special={self.special})
        return self.bpe.encode_ordinary(text)


def pack_documents(
    docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = 1, pool: int = POOL
) -> DataFrame:
    """A row for each piece of each document, with its window and offset.

    Needs doc_id and text; other columns are ignored.  A null or empty text is
    the end id alone.  Rows that repeat are packed each.  Windows are numbered
    from the task's number in the upper bits, so no task waits for another and
    nothing is shuffled; each pool of pieces leaves a few windows unfilled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        from pyspark import TaskContext

        encode = Encoder(ranks_path, pattern)
        base = TaskContext.get().partitionId() << 36
        held: list[tuple] = []  # doc_id, start, length, crc, tokens of pieces

        def flush() -> pa.RecordBatch:
            nonlocal base
            lengths = np.array([x[2] for x in held], dtype=np.int64)
            window, offset, made = pack_lengths(lengths, capacity)
            cols = list(zip(*held))
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in cols] + [pa.array(window + base), pa.array(offset)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            base += made
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array(encode(text.as_py() or ""), dtype="<u4")
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for s in range(0, len(ids), capacity):
                    piece = ids[s : s + capacity]
                    held.append((doc_id, s, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                if len(held) >= pool:
                    yield flush()
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)
