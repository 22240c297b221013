"""Removal of byte strings of ``length`` that occur more than once, by suffix arrays.

1. Routing.  In every window of ``length`` bytes the gram of ``GRAM`` bytes
   with the smallest hash is its anchor.  Equal windows have equal anchors, at
   the same place in the window, so only windows under an anchor that occurs
   twice can repeat, and all of one anchor can meet in one shard.  An
   occurrence's windows are a run; run and reach make its context.  Equal
   contexts are counted before any text moves: a context goes to a shard once,
   with its count.
2. Shards.  A shard's contexts are strings of 8-byte symbols laid from the
   anchor.  Their suffix array comes from Larsson-Sadakane refinement (only
   groups that are not yet sorted are sorted again, by twice the depth), common
   prefixes from Kasai's scan, in step over all contexts.  Suffixes with
   ``length // 8 - 1`` common symbols form groups; the bytes on their two sides
   decide, for each of the eight windows of a suffix, which are equal.
3. Merging.  An anchor with more than ``SHARD_CONTEXTS`` contexts has several
   shards.  Each gives its windows as sorted fingerprints, cut by range; a
   range's arrays are looked up in each other by binary search.
4. Repeated windows go back to their documents as spans, and are cut out.

Two lengths can be asked for at once.  The shorter one is searched first; a
longer window can only repeat where every shorter window in it repeats, so the
longer search reads no more than the runs that the shorter one found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, expand, materialize, mix64, prefix_hash, range_hash, runs_of, steady_memory, text_chunks

LENGTH = 400
#: Bytes that a passage of fifty words exceeds.
PASSAGE = 240
GRAM = 128
SYMBOL = 8
#: Contexts of one anchor that a shard may hold, and bytes that a shard aims at.
SHARD_CONTEXTS = 12_000
SHARD_BYTES = 3 << 20
MERGE_RANGES = 16
#: Low bits of a gram's hash that hold its place; longer texts are scanned in pieces.
PLACE_BITS = 24
#: Keys that a task packs at a time, and rows whose cut texts it holds.
FLUSH_KEYS = 750_000
CUT_ROWS = 500


# ------------------------------------------------------------------- routing


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of windows with one anchor: first window, count, anchor's place, its hash, and the context's."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    prefix = prefix_hash(data)
    at = np.arange(n - gram + 1)
    h = range_hash(prefix, at, at + gram)
    width = length - gram + 1
    # hash first, then place: the leftmost of the smallest; places count from the piece's start, so they fit their bits
    mask = np.uint64((1 << PLACE_BITS) - 1)
    place = np.empty(n - length + 1, np.int64)
    step = (1 << PLACE_BITS) - width + 1
    for s in range(0, len(place), step):
        e = min(s + step, len(place))
        low = h[s : e + width - 1] & ~mask
        low |= np.arange(len(low), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        place[s:e] = (low & mask).astype(np.int64) + s
    # windows that stay in one text
    sizes = np.diff(offsets)
    ok = np.flatnonzero(sizes >= length)
    window = expand(offsets[ok], sizes[ok] - length + 1)
    if not len(window):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    p = place[window]
    cut = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (window[1:] != window[:-1] + 1))))
    first, anchor = window[cut], p[cut]
    count = np.diff(np.concatenate((cut, [len(window)])))
    return first, count, anchor, h[anchor], range_hash(prefix, first, first + count - 1 + length)


def stretches(places: np.ndarray, spans: list, length: int, least: int) -> np.ndarray:
    """(from, to) of the bytes that runs of marked windows cover without a gap; those of ``least`` bytes at least."""
    pieces = [np.zeros((0, 2), np.int64)]
    for p, s in zip(places.tolist(), spans):
        own = np.array([[0, p >> 16 & 0xFFFF]]) if s is None else np.frombuffer(s, np.int32).reshape(-1, 2).astype(np.int64)
        pieces.append(own + (p >> 32))
    x = np.concatenate(pieces)
    x = x[np.argsort(x[:, 0], kind="stable")]
    if not len(x):
        return x
    end = np.maximum.accumulate(x[:, 1])
    new = np.flatnonzero(np.concatenate(([True], x[1:, 0] > end[:-1])))
    out = np.column_stack([x[new, 0], end[np.concatenate((new[1:] - 1, [len(x) - 1]))] + length - 1])
    return out[out[:, 1] - out[:, 0] >= least]


def _stretch_chunks(batch: pa.RecordBatch, shorter: int, length: int):
    """Like ``text_chunks``, of the stretches alone: chunks of rows, bytes, offsets, each piece's row and first byte."""
    held, rows, at, size, first = [], [], [], 0, 0
    for i in range(batch.num_rows):
        raw, marks = batch.column(2)[i].as_py(), batch.column(3)[i].values
        found = stretches(marks.field("place").to_numpy(), marks.field("spans").to_pylist(), shorter, length)
        for a, b in found.tolist():
            held.append(raw[a:b])
            rows.append(i - first)
            at.append(a)
            size += b - a
        if held and (size >= 1 << 19 or i + 1 == batch.num_rows):
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in held])))
            yield first, i + 1, np.frombuffer(b"".join(held), np.uint8), offsets, np.array(rows), np.array(at)
            held, rows, at, size, first = [], [], [], 0, i + 1


def _scan(rows: DataFrame, length: int, gram: int, ranges: int, shorter: int = 0) -> DataFrame:
    """A row per text with its packed runs, and rows of packed (anchor, context, count) by range.

    With ``shorter``, rows carry the marks of that length and only what they cover is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        names = ["r1", "r2", "runs", "part", "keys"]

        def flush() -> pa.RecordBatch:
            keys = np.concatenate(held)  # columns: anchor, context, count
            held.clear()
            keys = combine(keys)
            part = (keys[:, 0] >> np.uint64(40)).astype(np.int64) * ranges >> 24
            cut = np.searchsorted(part, np.arange(ranges + 1))
            own = [(int(r), cut[r], cut[r + 1]) for r in np.flatnonzero(np.diff(cut))]
            none = pa.nulls(len(own), pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    none, none, pa.nulls(len(own), pa.binary()), pa.array([r for r, _, _ in own], pa.int32()),
                    pa.array([keys[a:b].tobytes() for _, a, b in own], pa.binary()),
                ],
                names=names,
            )

        def pieces(batch: pa.RecordBatch):
            if shorter:
                yield from _stretch_chunks(batch, shorter, length)
                return
            for i, j, data, offsets in text_chunks(batch.column(2), 1 << 19):
                yield i, j, data, offsets, np.arange(j - i), np.zeros(j - i, np.int64)

        for batch in batches:
            for i, j, data, offsets, owner, base in pieces(batch):
                first, count, anchor, h, context = anchors(data, offsets, length, gram)
                piece = np.searchsorted(offsets, first, side="right") - 1
                doc, start = owner[piece], offsets[piece] - base[piece]
                packed = np.column_stack(
                    [h.view(np.int64), context.view(np.int64), (first - start) << 32 | count << 16 | (anchor - first)]
                )
                bounds = np.searchsorted(doc, np.arange(j - i + 1))
                blobs = [packed[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                part = batch.slice(i, j - i)
                none = pa.nulls(j - i, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(blobs, pa.binary()), none, pa.nulls(j - i, pa.binary())],
                    names=names,
                )
                held.append(np.column_stack([h, context, np.ones(len(h), np.uint64)]))
                size += len(h)
                if size >= FLUSH_KEYS:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return rows.mapInArrow(run, "r1 bigint, r2 bigint, runs binary, part int, keys binary")


def combine(keys: np.ndarray) -> np.ndarray:
    """Rows (anchor, context, count), sorted, with the counts of equal ones added."""
    keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
    cut = np.flatnonzero(np.concatenate(([True], (keys[1:, :2] != keys[:-1, :2]).any(axis=1))))
    return np.column_stack([keys[cut, 0], keys[cut, 1], np.add.reduceat(keys[:, 2], cut)]) if len(keys) else keys


def _shared(scan: DataFrame) -> DataFrame:
    """Contexts of anchors that occur twice: their count, and the anchor's number of contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        for _, rows in runs_of(batches, 1):
            keys = combine(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, 3) for x in rows.column(1)]))
            cut = np.flatnonzero(np.concatenate(([True], keys[1:, 0] != keys[:-1, 0])))
            kinds = np.diff(np.concatenate((cut, [len(keys)])))
            use = np.repeat(np.add.reduceat(keys[:, 2], cut) > 1, kinds)
            got = keys[use].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(got[:, 0]), pa.array(got[:, 1]), pa.array(got[:, 2]), pa.array(np.repeat(kinds, kinds)[use])],
                names=["h", "context", "copies", "kinds"],
            )

    blobs = scan.filter("part is not null").select("part", "keys")
    schema = "h bigint, context bigint, copies bigint, kinds bigint"
    return blobs.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def _runs(scan: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                each = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 3) for x in part.column(2)]
                n = np.array([len(x) for x in each])
                all_ = np.concatenate(each)
                r1, r2 = (np.repeat(part.column(c).to_numpy(), n) for c in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (r1, r2, all_[:, 0], all_[:, 1], all_[:, 2])], names=["r1", "r2", "h", "context", "place"]
                )

    rows = scan.filter("part is null and length(runs) > 0").select("r1", "r2", "runs")
    return rows.mapInArrow(run, "r1 bigint, r2 bigint, h bigint, context bigint, place bigint")


# ------------------------------------------------------------- suffix arrays


def suffix_array(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Order of the suffixes of strings laid end to end; ``left`` is each suffix's length to its string's end.

    Larsson-Sadakane refinement: after the round of depth d, suffixes with d
    common symbols share a rank.  Only they are sorted again, by the rank d
    further on.  Equal suffixes keep their places.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.concatenate(([True], symbols[order][1:] != symbols[order][:-1])) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    depth, most = 1, int(left.max(initial=0))
    while depth < most:
        bounds = np.flatnonzero(np.concatenate((new, [True])))
        size = np.diff(bounds)
        open_ = np.repeat(size > 1, size)
        slots = np.flatnonzero(open_)
        if not len(slots):
            break
        who = order[slots]
        ahead = np.full(len(who), -1, np.int64)
        far = left[who] > depth
        ahead[far] = rank[who[far] + depth]
        by = np.lexsort((ahead, rank[who]))
        who, ahead = who[by], ahead[by]
        order[slots] = who
        mine = rank[who]
        first = np.concatenate(([True], (mine[1:] != mine[:-1]) | (ahead[1:] != ahead[:-1])))
        new[slots] = first
        rank[who] = slots[np.flatnonzero(first)][np.cumsum(first) - 1]
        depth *= 2
    return order


def common_prefixes(symbols: np.ndarray, left: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Common symbols of each suffix, in the array's order, with the one before it.

    Kasai's scan: the next suffix of a string has one common symbol less at
    least.  All strings are scanned in step, so each step is an array operation.
    """
    n = len(symbols)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    at, common = starts.copy(), np.zeros(len(starts), np.int64)
    live = left[at] > 0
    while live.any():
        at, common = at[live], common[live]
        other = before[at]
        common[other < 0] = 0
        todo = np.flatnonzero(other >= 0)
        while len(todo):
            c = common[todo]
            room = (c < left[at[todo]]) & (c < left[other[todo]])
            todo, c = todo[room], c[room]
            same = symbols[at[todo] + c] == symbols[other[todo] + c]
            todo = todo[same]
            common[todo] += 1
        out[place[at]] = common
        live = left[at] > 1
        at = at + 1
        common = np.maximum(common - 1, 0)
    return out


def repeated_windows(texts: list[bytes], windows: np.ndarray, anchor: np.ndarray, length: int):
    """For each context, which of its windows (numbered over all contexts) start more than once here.

    A context has ``windows`` windows and its anchor at ``anchor``.  Returns the
    flags of all windows, one context's after the other's.
    """
    data = np.frombuffer(b"".join(texts) + bytes(16), np.uint8)
    sizes = np.array([len(t) for t in texts])
    base = np.cumsum(sizes) - sizes
    phase = anchor % SYMBOL
    count = (sizes - phase) // SYMBOL
    at = np.repeat(base + phase, count) + (expand(np.zeros(len(count), np.int64), count)) * SYMBOL

    def word(places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.uint64)
        for k in range(SYMBOL):
            out = out << np.uint64(8) | data[places + k]
        return out

    symbols = word(at)
    first = np.cumsum(count) - count
    left = np.repeat(first + count, count) - np.arange(len(at))
    order = suffix_array(symbols, left)
    common = common_prefixes(symbols, left, order, first[count > 0])
    core = length // SYMBOL - 1
    group = np.cumsum(common < core)
    flags = np.zeros(int(windows.sum()), bool)
    offset = np.cumsum(windows) - windows
    # groups of two suffixes at least
    size = np.bincount(group)
    pick = size[group] > 1
    who, group = order[pick], group[pick]
    text = np.repeat(np.arange(len(texts)), count)[who]
    spot = at[who] - base[text]  # of the suffix in its context
    tail = length - core * SYMBOL  # bytes of a window beside the core
    for e in range(SYMBOL):
        start = spot - e
        use = np.flatnonzero((start >= 0) & (start < windows[text]))
        if not len(use):
            continue
        g, t, p = group[use], text[use], at[who[use]]
        # e bytes before the core and the rest of the window behind it
        sides = np.zeros(len(use), np.uint64)
        more = np.zeros(len(use), np.uint64)
        for k in range(tail):
            byte = data[np.where(k < e, p - e + k, p + core * SYMBOL + k - e)].astype(np.uint64)
            if k < 8:
                sides = sides << np.uint64(8) | byte
            else:
                more = more << np.uint64(8) | byte
        by = np.lexsort((more, sides, g))
        same = (g[by][1:] == g[by][:-1]) & (sides[by][1:] == sides[by][:-1]) & (more[by][1:] == more[by][:-1])
        twin = np.zeros(len(use), bool)
        twin[by[1:][same]] = True
        twin[by[:-1][same]] = True
        hit = use[twin]
        flags[offset[text[hit]] + spot[hit] - e] = True
    return flags, offset


def flag_runs(flags: np.ndarray) -> np.ndarray:
    """First and one past the last of each run of set flags, as pairs."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge.astype(np.int32)


def _search_shards(contexts: DataFrame, length: int) -> DataFrame:
    """h, context, spans (pairs of window numbers), open (fingerprints of the windows of split anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        for (bucket,), rows in runs_of(batches, 1):
            h, context, copies, windows, anchor = (rows.column(c).to_numpy() for c in range(1, 6))
            texts = rows.column(6).to_pylist()
            flags, offset = repeated_windows(texts, windows, anchor, length)
            flags |= np.repeat(copies > 1, windows)
            spans, open_ = [], []
            for i, (a, n) in enumerate(zip(offset, windows)):
                own = flags[a : a + n]
                spans.append(flag_runs(own).tobytes())
                if bucket >= 0:
                    open_.append(None)
                    continue
                data = np.frombuffer(texts[i], np.uint8)
                prefix, at = prefix_hash(data), np.arange(n)
                one = range_hash(prefix, at, at + length)
                two = range_hash(prefix, at + length // 3, at + length)
                open_.append(np.column_stack([one, two, at.astype(np.uint64)]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [rows.column(1).combine_chunks(), rows.column(2).combine_chunks(), pa.array(spans, pa.binary()), pa.array(open_, pa.binary())],
                names=["h", "context", "spans", "open"],
            )

    dealt = contexts.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "h bigint, context bigint, spans binary, open binary")


def _merge_shards(found: DataFrame) -> DataFrame:
    """h, context, spans of windows of split anchors that match in another shard.

    Sorted fingerprints of a range are looked up in the other contexts' by
    binary search.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64).reshape(-1, 3)
                x = x[np.lexsort((x[:, 1], x[:, 0]))]
                part = (x[:, 0] >> np.uint64(32)).astype(np.int64) * MERGE_RANGES >> 32
                cut = np.searchsorted(part, np.arange(MERGE_RANGES + 1))
                own = [r for r in range(MERGE_RANGES) if cut[r] < cut[r + 1]]
                h, context = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([h] * len(own), pa.int64()), pa.array(own, pa.int64()), pa.array([context] * len(own), pa.int64()),
                        pa.array([x[cut[r] : cut[r + 1]].tobytes() for r in own], pa.binary()),
                    ],
                    names=["h", "part", "context", "open"],
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        for (h, _), rows in runs_of(batches, 2):
            each = [np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, 3) for x in rows.column(3)]
            sizes = np.array([len(x) for x in each])
            all_ = np.concatenate(each)
            order = np.lexsort((all_[:, 1], all_[:, 0]))
            one, two = all_[order, 0], all_[order, 1]
            # the range's windows in order; a window's equals lie between its two bounds
            lo, hi = np.searchsorted(one, all_[:, 0], side="left"), np.searchsorted(one, all_[:, 0], side="right")
            hit = np.zeros(len(all_), bool)
            many = np.flatnonzero(hi - lo > 1)
            twin = np.concatenate(([False], (one[1:] == one[:-1]) & (two[1:] == two[:-1])))
            twin |= np.concatenate((twin[1:], [False]))
            hit[order] = twin
            hit &= np.isin(np.arange(len(all_)), many)
            end = np.cumsum(sizes)
            names, spans = [], []
            for i, (a, b) in enumerate(zip(end - sizes, end)):
                at = np.sort(all_[a:b, 2][hit[a:b]]).astype(np.int32)
                if len(at):
                    names.append(rows.column(2)[i].as_py())
                    spans.append(np.column_stack([at, at + 1]).astype(np.int32).tobytes())
            if names:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h] * len(names), pa.int64()), pa.array(names, pa.int64()), pa.array(spans, pa.binary())],
                    names=["h", "context", "spans"],
                )

    rows = found.filter("open is not null").select("h", "context", "open")
    rows = rows.mapInArrow(deal, "h bigint, part bigint, context bigint, open binary")
    rows = rows.repartition("h", "part").sortWithinPartitions("h", "part")
    return rows.mapInArrow(merge, "h bigint, context bigint, spans binary")


# ------------------------------------------------------------------ operator


def find_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_contexts: int = SHARD_CONTEXTS,
    within: tuple[DataFrame, int] | None = None,
) -> DataFrame:
    """r1, r2 and marks (place of a run, spans of its repeated windows) of the texts that have any.

    (r1, r2) are hashes of a row's doc_id and text, so rows that agree in both
    have the same marks.  ``within`` is the result for a shorter length and
    that length: only the texts' stretches that it marks are searched.
    """
    if not 2 * SYMBOL <= gram < length:
        raise ValueError("the gram must be shorter than the length")
    if within is not None and not gram < within[1] <= length:
        raise ValueError("the shorter length must lie between the gram and the length")
    spark = docs.sparkSession
    rows = _keyed(docs)
    ranges = int(min(8192, max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    if within is None:
        scan = _scan(rows, length, gram, ranges)
    else:
        marked = within[0].groupBy("r1", "r2").agg(F.collect_set(F.struct("place", "spans")).alias("marks"))
        scan = _scan(rows.join(marked, ["r1", "r2"]).select("r1", "r2", "text", "marks"), length, gram, ranges, within[1])
    scan = materialize(scan, "repeat-scan", codec="lz4")
    shared = materialize(_shared(scan), "repeat-shared", codec="lz4")
    runs = materialize(_runs(scan).join(shared, ["h", "context"]), "repeat-runs", codec="lz4")
    discard(scan, shared)
    # a context is read from one of its places
    once = runs.filter("kinds > 1").groupBy("h", "context", "copies", "kinds").agg(F.min(F.struct("r1", "r2", "place")).alias("m"))
    windows = F.shiftright("m.place", 16).bitwiseAND(F.lit(0xFFFF).cast("long"))
    once = once.select("h", "context", "copies", "kinds", "m.r1", "m.r2", "m.place", windows.alias("windows"))
    total = once.agg(F.sum(F.col("windows") + length)).first()[0] or 0
    buckets = max(1, -(-int(total) // SHARD_BYTES))
    split = F.pmod(F.xxhash64("h", F.pmod(F.col("context"), F.ceil(F.col("kinds") / F.lit(shard_contexts)).cast("long"))), F.lit(1 << 40))
    bucket = F.when(F.col("kinds") <= shard_contexts, F.pmod(F.xxhash64("h"), F.lit(buckets).cast("long"))).otherwise(-1 - split)
    wanted = (
        once.withColumn("bucket", bucket)
        .groupBy("r1", "r2")
        .agg(F.collect_list(F.struct("bucket", "h", "context", "copies", "place")).alias("wanted"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        names = ["bucket", "h", "context", "copies", "windows", "anchor", "text"]
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(0)[i].as_py()
                asked = batch.column(1)[i].values
                place = asked.field("place").to_numpy()
                start, n, anchor = place >> 32, place >> 16 & 0xFFFF, place & 0xFFFF
                texts = [raw[a : a + w - 1 + length] for a, w in zip(start.tolist(), n.tolist())]
                cols = [asked.field(c) for c in names[:4]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n), pa.array(anchor), pa.array(texts, pa.binary())], names=names)

    asked = rows.join(wanted, ["r1", "r2"]).select("text", "wanted")
    contexts = asked.mapInArrow(
        cut, "bucket bigint, h bigint, context bigint, copies bigint, windows bigint, anchor bigint, text binary"
    )
    found = materialize(_search_shards(contexts, length), "repeat-found", codec="lz4")
    marks = found.select("h", "context", "spans")
    if not found.filter("open is not null").isEmpty():
        marks = marks.unionByName(_merge_shards(found))
    marks = marks.filter("length(spans) > 0")
    # an anchor's only context, met twice, repeats as a whole
    whole = runs.filter("kinds = 1").select("r1", "r2", "place", F.lit(None).cast("binary").alias("spans"))
    some = runs.filter("kinds > 1").select("r1", "r2", "h", "context", "place").join(marks, ["h", "context"])
    out = materialize(whole.unionByName(some.select("r1", "r2", "place", "spans")), "repeat-marks", codec="lz4")
    discard(runs, found)
    return out


def _identity() -> dict:
    """The columns that identify a row: hashes of doc_id and text, and of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return {"__r1": F.xxhash64(F.lit(1), F.col("doc_id").cast("long"), text), "__r2": F.xxhash64(F.lit(2), text)}


def _keyed(docs: DataFrame) -> DataFrame:
    """(r1, r2, text's bytes) of every row; a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = {k[2:]: v for k, v in _identity().items()}
    return docs.select(*[v.alias(k) for k, v in named.items()], text.cast("binary").alias("text"))


def covered(place: np.ndarray, spans: list, length: int) -> np.ndarray:
    """Sorted, disjoint byte spans (pairs) covered by the marked windows."""
    pieces = [np.zeros((0, 2), np.int64)]
    for p, s in zip(place.tolist(), spans):
        start, n = p >> 32, p >> 16 & 0xFFFF
        own = np.array([[0, n]]) if s is None else np.frombuffer(s, np.int32).reshape(-1, 2).astype(np.int64)
        pieces.append(own + [start, start + length - 1])
    x = np.concatenate(pieces)
    x = x[np.argsort(x[:, 0], kind="stable")]
    if not len(x):
        return x
    end = np.maximum.accumulate(x[:, 1])
    new = np.flatnonzero(np.concatenate(([True], x[1:, 0] > end[:-1])))
    return np.column_stack([x[new, 0], end[np.concatenate((new[1:] - 1, [len(x) - 1]))]])


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, keep_text: bool = True, passage: int | None = None, **options
) -> DataFrame:
    """Every row of ``docs`` with its text cut, and n_bytes, n_removed, n_spans, kept_sha256 of the cut.

    A text is its UTF-8 bytes (null: none).  Every byte covered by a string of
    ``length`` bytes that starts at another place too, in any row, is removed;
    strings are judged on the input.  Cutting may part a character's bytes:
    kept_sha256 is of the bytes, the kept text drops such remains.  Columns of
    those four names are replaced, all others kept, whatever their names; a null text stays null.
    Without ``keep_text`` the text is left out.  With ``passage``, a shorter
    length, the text is cut at that length (repeated passages too short for
    ``length`` go as well), while the four columns are still of ``length``.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = docs.drop(*added)
    if passage is None or passage == length:
        cut_at = length
        marks = find_repeats(docs, length, **options).withColumn("short", F.lit(False))
    else:
        cut_at = passage
        fine = find_repeats(docs, passage, **options)
        marks = fine.withColumn("short", F.lit(True))
        whole = find_repeats(docs, length, within=(fine, passage), **options)
        marks = marks.unionByName(whole.withColumn("short", F.lit(False)))
    marks = marks.groupBy("r1", "r2").agg(F.collect_set(F.struct("place", "spans", "short")).alias("marks"))
    marks = marks.select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2"), F.col("marks").alias("__marks"))
    rows = docs.withColumns(_identity()).join(marks, ["__r1", "__r2"], "left").drop("__r1", "__r2")
    names = [c for c in docs.columns if keep_text or c != "text"]
    schema = docs.select(*names).schema
    for c in added:
        schema = schema.add(c, "string" if c == "kept_sha256" else "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        for batch in (b.slice(s, CUT_ROWS) for b in batches for s in range(0, b.num_rows, CUT_ROWS)):
            cols = dict(zip(batch.schema.names, batch.columns))
            out, stats = [], []
            for text, mark in zip(cols["text"], cols["__marks"]):
                text = text.as_py()
                raw = (text or "").encode()
                if not mark.is_valid:
                    stats.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                    if keep_text:
                        out.append(text)
                    continue
                place, spans = mark.values.field("place").to_numpy(), mark.values.field("spans").to_pylist()
                short = mark.values.field("short").to_numpy(zero_copy_only=False)
                kept, x = without(raw, place[~short], [s for s, w in zip(spans, short) if not w], length)
                stats.append((len(raw), len(raw) - len(kept), len(x), hashlib.sha256(kept).hexdigest()))
                if keep_text:
                    if cut_at != length:
                        kept, _ = without(raw, place[short], [s for s, w in zip(spans, short) if w], cut_at)
                    out.append(kept.decode("utf-8", "ignore"))
            if keep_text:
                cols["text"] = pa.array(out, pa.string())
            for c, values in zip(added, zip(*stats) if stats else [[], [], [], []]):
                cols[c] = pa.array(values, pa.string() if c == "kept_sha256" else pa.int64())
            yield pa.RecordBatch.from_arrays([cols[c] for c in [*names, *added]], names=[*names, *added])

    return rows.mapInArrow(run, schema)


def without(raw: bytes, place: np.ndarray, spans: list, length: int) -> tuple[bytes, np.ndarray]:
    """The bytes outside the marked windows, and the spans that were cut."""
    x = covered(place, spans, length)
    return b"".join(raw[a:b] for a, b in zip([0, *x[:, 1]], [*x[:, 0], len(raw)])), x
