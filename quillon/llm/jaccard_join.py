"""Exact Jaccard self-join of shingle sets in the metric space of Jaccard distance.

Unrelated texts all lie at distance 1 from each other, so pivots alone cannot
part a corpus.  A first, exact step parts it into regions: within a size level
the shingles are dealt into more classes than two linked sets can differ in, by
the number wanted and a number to spare, so linked sets agree in that many whole
classes.  Each set leaves out its smallest classes, as many as there are to
spare; of the classes that linked sets agree in, these are the smallest, so the
number wanted is left.  Pairs that agree in so many classes share a region: one
class alone, such as a line that some texts share, would join unrelated texts,
ever more of them as a corpus grows, until regions run together.  Sets that
are joined through the smallest set of their keys are not counted in pairs.
Shingles that many texts share stay out of the classes.  (A set with more empty
classes than there are to spare is also keyed by its first shingles, in hash
order, of which linked sets share one.)  No linked pair is lost, and equal sets
are one set throughout.

Within a region pivots make Voronoi cells by Jaccard distance.  By the triangle
inequality a set can link into the cell of pivot q only if its distance to q is
within its distance to its own pivot plus twice the radius; such boundary sets
are replicated, and cells join recursively until they are small or no longer
shrink.  Sets that share nothing with any pivot are a cell of their own, with
the sets that lie within the radius of distance 1 from all pivots.  In a last cell the sets are ordered by their distance to its pivot;
linked sets' distances differ by the radius at most, so each block of sets meets
the window of that width, where common shingles are counted exactly with
integers.  A region above ``region_shingles`` is dealt into shares and each pair
of shares is a task, so no task holds an unbounded region.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import (
    _LOWER,
    connected_components,
    discard,
    expand,
    materialize,
    mix64,
    prefix_hash,
    range_hash,
    remove_shuffles,
    runs_of,
    steady_memory,
    text_chunks,
    union_roots,
    words_of,
)

SHINGLE = 4
PERCENT = 85
#: Shingles that a task may hold of one region, or of a pair of its shares.
REGION_SHINGLES = 400_000
#: Shingles are common that occur in more texts than this, by counts of those that a buffer of
#: ``COMMON_BUFFER`` shingles holds ``COMMON_LOCAL`` times or more; all tasks get ``MAX_COMMON`` of them at most.
COMMON_LEAST = 40
COMMON_LOCAL = 4
COMMON_BUFFER = 4_000_000
MAX_COMMON = 200_000
#: Low bits of a key that hold its level, and the number there of keys of which one is enough.
LEVEL_BITS = 8
ANY = (1 << LEVEL_BITS) - 1
#: Sets of a key up to which its pairs are counted; above, the sets share a region.
PAIRED = 32
#: Keys that a task packs at a time, and sets whose digests it remembers so as not to send their keys twice.
FLUSH_KEYS = 1_000_000
MAX_SEEN = 500_000
#: Sets up to which a cell is not parted by pivots again.
LEAF = 8
#: Sets of regions up to which they go to all tasks (48 bytes each), so texts stay where they are; above, texts are dealt by id,
#: up to BROADCAST_IDS of them those of these sets alone.
BROADCAST_CANDIDATES = 250_000
#: Ids up to which they go to all tasks; above, rows are dealt by id.
BROADCAST_IDS = 1_000_000
#: Pivots of a cell: as the square root of its sets, within these bounds.
PIVOTS = 8
MAX_PIVOTS = 64
#: Shingles counted by matrix products, and pairs counted at a time, in a leaf.
HEAVY = 2048
BLOCK_PAIRS = 1_000_000


# ------------------------------------------------------------------ shingles


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a chunk, one after the other, and their bounds."""
    starts, ends, first = words_of(data, offsets)
    words = range_hash(prefix_hash(data), starts, ends)
    if len(words) >= k:
        grams = words[: len(words) - k + 1].copy()
        for i in range(1, k):
            grams = mix64(grams) + words[i : len(words) - k + 1 + i]
        grams = mix64(grams)
    out, bounds = [], np.zeros(len(offsets), np.int64)
    for d in range(len(offsets) - 1):
        a, b = first[d], first[d + 1]
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:  # the whole sequence; its length sets it apart from full shingles
            h = np.array([b - a], np.uint64)
            for w in words[a:b]:
                h = mix64(h) + w
            out.append(mix64(h ^ np.uint64(0x5851F42D4C957F2D)))
        else:
            out.append(words[:0])
        bounds[d + 1] = bounds[d] + len(out[-1])
    return (np.concatenate(out) if out else words[:0]), bounds


def set_digests(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, whatever the order of its shingles."""
    out = []
    for salt in (0x1234567, 0x89ABCDE):
        c = np.concatenate(([np.uint64(0)], np.cumsum(mix64(shingles + np.uint64(salt)))))
        out.append(mix64(c[bounds[1:]] - c[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


# ----------------------------------------------------------------- signatures


def size_levels(percent: int) -> np.ndarray:
    """Lower bounds of the size levels: linked sets lie in one level or in two neighbouring ones."""
    out = [1, 2]
    while out[-1] < 1 << 42:
        out.append(max(out[-1] + 1, -(-out[-1] * 5 // 4), -(-out[-1] * 100 // percent)))
    return np.array(out, np.int64)


def class_counts(top, percent: int):
    """Of sets of up to ``top`` shingles: classes in which linked ones agree at least, those to spare, and all."""
    differ = 2 * top * (100 - percent) // (100 + percent)  # linked sets differ in no more shingles
    wanted = np.where(differ > 0, differ // 10 + 2, 1)
    spare = np.where(differ > 0, differ // 2 + 2, 0)
    return wanted, spare, differ + wanted + spare


def signatures(
    shingles: np.ndarray, bounds: np.ndarray, percent: int, common: np.ndarray = np.zeros(0, np.uint64)
) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and the text each belongs to: texts that link share one of level ``ANY``, or as many of one level as it wants.

    The level of a pair is that of its larger set, so a set takes part in its
    own level and, near that level's end, in the next.  The sorted ``common``
    shingles are left out of the classes: without them two sets differ no more
    than with them, and texts that share only these do not meet.
    """
    size, low = np.diff(bounds), size_levels(percent)
    own = np.searchsorted(low, size, side="right") - 1
    rare = np.ones(len(shingles), bool)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rare = common[at] != shingles
    before = np.concatenate(([0], np.cumsum(rare)))[bounds]
    kept, left = shingles[rare], np.diff(before)
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for up in (0, 1):
        here = np.flatnonzero((size > 0) & ((up == 0) | (size * 100 >= percent * low[own + 1])))
        if not len(here):
            continue
        level, n = own[here] + up, left[here]
        top = low[level + 1] - 1
        _, spare, classes = class_counts(top, percent)
        salt = mix64(level.astype(np.uint64) + np.uint64(77))
        base, total = np.cumsum(classes) - classes, int(classes.sum())
        x = mix64(kept[expand(before[here], n)] + np.repeat(salt, n))
        slot = np.repeat(base, n) + (x % np.repeat(classes, n).astype(np.uint64)).astype(np.int64)
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, slot, mix64(x ^ np.uint64(0xA5A5A5A5)))
        count = np.bincount(slot, minlength=total)
        held = count > 0
        of = np.repeat(np.arange(len(here)), classes)
        number = (np.arange(total) - base[of]).astype(np.uint64)
        key = mix64(sums + mix64(salt[of] + number)) & ~np.uint64(ANY) | level[of].astype(np.uint64)
        # classes by their shingles, then by key: two sets put those they agree in into the same order
        order = np.lexsort((key, count, of))
        use = order[held[order] & (np.arange(total) - base[of] >= spare[of])]
        keys.append(key[use])
        owners.append(here[of[use]])
        # the first shingles, by hash and the common ones last, of sets with too many empty classes
        for i in np.flatnonzero(np.bincount(of[~held], minlength=len(here)) > spare):
            own_set = slice(bounds[here[i]], bounds[here[i] + 1])
            ordered = np.concatenate((shingles[own_set][rare[own_set]], shingles[own_set][~rare[own_set]]))
            length = len(ordered) - -(-percent * len(ordered) // 100) + 1
            keys.append(mix64(mix64(ordered[:length] ^ salt[i]) + np.uint64(3)) | np.uint64(ANY))
            owners.append(np.full(length, here[i]))
    return np.concatenate(keys), np.concatenate(owners)


# --------------------------------------------------------------- exact join


class Region:
    """Sets of a region: shingles by set, and sizes."""

    def __init__(self, shingles: np.ndarray, bounds: np.ndarray, percent: int):
        self.shingles, self.bounds, self.percent = shingles, bounds, percent
        self.size = np.diff(bounds)
        values, self.code = np.unique(shingles, return_inverse=True)
        self.width = len(values)

    def rows(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the sets ``docs``, and which of them each belongs to."""
        n = self.size[docs]
        return self.code[expand(self.bounds[docs], n)], np.repeat(np.arange(len(docs)), n)

    def distances(self, docs: np.ndarray, pivot: int, codes, owner) -> np.ndarray:
        member = np.zeros(self.width, bool)
        member[self.code[self.bounds[pivot] : self.bounds[pivot + 1]]] = True
        common = np.bincount(owner[member[codes]], minlength=len(docs))
        return 1 - common / np.maximum(self.size[docs] + self.size[pivot] - common, 1)

    def join(self, side: np.ndarray, weight: np.ndarray, take=None) -> tuple[np.ndarray, np.ndarray]:
        """Links of each set, weighted by the other's ``weight``, and the smallest set of its component.

        Sets of side 0 link with each other, those of sides 1 and 2 with the
        other side.  Pairs are counted as they are found and never held; ``take``
        also gets each batch of them.
        """
        n = len(self.size)
        self.side, self.weight, self.take = side, weight, take
        self.links, self.root = np.zeros(n), np.arange(n)
        self.cells = self.replicas = self.skipped = 0  # cells made, boundary sets sent on, pairs that no window holds
        self._join(np.arange(n), [])
        return self.links, self.root

    def _found(self, i: np.ndarray, j: np.ndarray, homes: list[np.ndarray]) -> None:
        for home in homes:  # a pair is joined in the lower of its two cells
            keep = home[i] | home[j]
            i, j = i[keep], j[keep]
        if not len(i):
            return
        if self.take is not None:
            self.take(i, j)
        n = len(self.size)
        self.links += np.bincount(i, weights=self.weight[j], minlength=n) + np.bincount(j, weights=self.weight[i], minlength=n)
        a, b = self.root[i], self.root[j]
        part = a != b
        if part.any():
            ends = np.unique(a[part] * np.int64(n) + b[part])
            self.root = union_roots(ends // n, ends % n, n)[self.root]

    def _join(self, docs: np.ndarray, homes: list[np.ndarray]) -> None:
        if len(docs) <= LEAF:
            return self._leaf(docs, homes)
        codes, owner = self.rows(docs)
        radius = 1 - self.percent / 100 + 1e-9
        # pivots far from each other, starting with the first set
        chosen, away, table = [0], None, []
        for _ in range(max(PIVOTS, min(MAX_PIVOTS, int(len(docs) ** 0.5)))):
            d = self.distances(docs, int(docs[chosen[-1]]), codes, owner)
            table.append(d)
            away = d if away is None else np.minimum(away, d)
            nxt = int(np.argmax(away))
            if away[nxt] <= 2 * radius:
                break
            chosen.append(nxt)
        table = np.array(table)
        cell = np.argmin(table, axis=0)
        # sets without a shingle in common with any pivot are a cell before all others: what links
        # with them lies within the radius of distance 1 from every pivot
        rest = away >= 1
        cell[rest] = -1
        window = (table <= away + 2 * radius) & ~rest
        parts = [np.flatnonzero(rest | (away >= 1 - radius))] if rest.any() else [np.zeros(0, np.int64)]
        parts += [np.flatnonzero(window[p] & (cell >= p)) for p in range(len(table))]
        del codes, owner, table, window
        if max(map(len, parts)) > 0.9 * len(docs):
            return self._leaf(docs, homes)
        self.cells += sum(len(x) > 0 for x in parts)
        self.replicas += sum(map(len, parts)) - len(docs)
        for p, part in enumerate(parts):
            home = np.zeros(len(self.size), bool)
            home[docs[part[cell[part] == p - 1]]] = True
            if home.any():
                self._join(docs[part], [*homes, home])

    def _leaf(self, docs: np.ndarray, homes: list[np.ndarray]) -> None:
        """Counts the common shingles of the pairs in each block's window of distances to the pivot."""
        m = len(docs)
        codes, owner = self.rows(docs)
        away = self.distances(docs, int(docs[0]), codes, owner)
        by = np.argsort(away, kind="stable")
        docs, away, place = docs[by], away[by], np.empty(m, np.int64)
        place[by] = np.arange(m)
        owner, side, radius = place[owner], self.side[docs], 1 - self.percent / 100 + 1e-9
        order = np.argsort(codes, kind="stable")
        codes, owner = codes[order], owner[order]
        cut = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1], [True])))
        df = np.diff(cut)
        # the most frequent shingles by matrix products, the others by their lists
        heavy = np.flatnonzero(df > max(16, m // 32))
        heavy = heavy[np.argsort(-df[heavy], kind="stable")[:HEAVY]]
        dense = np.zeros((m, len(heavy)), np.uint8)
        for c, h in enumerate(heavy):
            dense[owner[cut[h] : cut[h + 1]], c] = 1
        by_list = df > 1
        by_list[heavy] = False
        group = np.repeat(np.arange(len(df)), df)
        used = np.flatnonzero(by_list[group])
        used = used[np.argsort(owner[used], kind="stable")]
        row, group = owner[used], group[used]
        cost = np.cumsum(np.bincount(row, weights=df[group], minlength=m) + m)
        a = 0
        while a < m:
            b = max(a + 1, int(np.searchsorted(cost, (cost[a - 1] if a else 0) + BLOCK_PAIRS, side="right")))
            # pairs are counted once, so a window starts with its block
            near, far = a, int(np.searchsorted(away, away[b - 1] + radius, side="right"))
            width = far - near
            self.skipped += (b - a) * (m - far)
            lo, hi = np.searchsorted(row, (a, b))
            g = group[lo:hi]
            other, at = owner[expand(cut[g], df[g])], np.repeat((row[lo:hi] - a) * np.int64(width), df[g])
            inside = (other >= near) & (other < far)
            common = np.bincount(at[inside] + other[inside] - near, minlength=(b - a) * width).reshape(b - a, width)
            for c in range(0, len(heavy), 512):
                part = dense[:, c : c + 512].astype(np.float32)
                common += np.rint(part[a:b] @ part[near:far].T).astype(np.int64)
            total = self.size[docs[a:b], None] + self.size[docs[near:far]][None, :]
            i, j = np.nonzero((common > 0) & ((100 + self.percent) * common >= self.percent * total))
            j += near
            up = (i + a < j) & ((side[i + a] == 0) | (side[i + a] != side[j]))
            self._found(docs[i[up] + a], docs[j[up]], homes)
            a = b


# ------------------------------------------------------------------ operator


def _digests(docs: DataFrame, k: int) -> DataFrame:
    """A row per document: its set's size and digest; and rows of shingles that some of a task's texts share, with counts."""
    names = ["doc_id", "n", "h1", "h2", "common"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            often = count >= COMMON_LOCAL
            blob = np.column_stack([value[often], count[often].astype(np.uint64)]).tobytes()
            none = pa.nulls(1, pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array([blob], pa.binary())], names=names)

        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                shingles, bounds = shingle_sets(_LOWER[data], offsets, k)
                h1, h2 = set_digests(shingles, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(h1), pa.array(h2), pa.nulls(j - i, pa.binary())],
                    names=names,
                )
                held.append(shingles)
                size += len(shingles)
                if size >= COMMON_BUFFER:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return docs.mapInArrow(run, "doc_id bigint, n bigint, h1 bigint, h2 bigint, common binary")


def _common(digests: DataFrame) -> np.ndarray:
    """The shingles that many texts share, sorted; ``MAX_COMMON`` at most.

    They only steer which sets meet, never what links, so any choice is right.
    """
    counts = digests.filter("common is not null").select("common").mapInArrow(_unpacked, "shingle bigint, count bigint")
    sums = counts.groupBy("shingle").agg(F.sum("count").alias("count")).filter(F.col("count") > COMMON_LEAST)
    most = sums.orderBy(F.col("count").desc(), "shingle").limit(MAX_COMMON)
    return np.sort(np.array([r.shingle for r in most.select("shingle").collect()], np.int64).view(np.uint64))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0):
            x = np.frombuffer(blob.as_buffer(), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["shingle", "count"])


def pack_keys(key: np.ndarray, node: np.ndarray) -> bytes:
    """Keys grouped by node (they are sorted by it): nodes, keys of each, keys."""
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    counts = np.diff(np.concatenate((first, [len(node)]))).astype(np.int32)
    return np.int64(len(first)).tobytes() + node[first].tobytes() + counts.tobytes() + key.tobytes()


def unpack_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    nodes = np.frombuffer(blob, np.int64, n, 8)
    counts = np.frombuffer(blob, np.int32, n, 8 + 8 * n)
    return np.frombuffer(blob, np.uint64, -1, 8 + 12 * n), np.repeat(nodes, counts)


def _keys(docs: DataFrame, k: int, percent: int, ranges: int, common: np.ndarray) -> DataFrame:
    """Rows of packed keys by range.  They are many bytes, so they are dealt at once and not written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        seen: set = set()
        keys: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            key, node = np.concatenate(keys), np.concatenate(nodes)
            keys.clear()
            nodes.clear()
            part = ((key >> np.uint64(40)).astype(np.int64) * ranges >> 24).astype(np.int32)
            order = np.lexsort((node, part))
            key, node, part = key[order], node[order], part[order]
            cut = np.searchsorted(part, np.arange(ranges + 1))
            rows = np.flatnonzero(np.diff(cut))
            blobs = [pack_keys(key[cut[r] : cut[r + 1]], node[cut[r] : cut[r + 1]]) for r in rows]
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "keys"])

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(1)):
                shingles, bounds = shingle_sets(_LOWER[data], offsets, k)
                h1, h2 = set_digests(shingles, bounds)
                # a set that this task has met has its keys sent
                fresh = np.zeros(len(h1), bool)
                for d, mark in enumerate(zip(h1.tolist(), h2.tolist())):
                    if mark not in seen:
                        if len(seen) >= MAX_SEEN:  # keys sent twice change nothing
                            seen.clear()
                        seen.add(mark)
                        fresh[d] = True
                key, owner = signatures(shingles, bounds, percent, common)
                use = fresh[owner]
                keys.append(key[use])
                nodes.append(h1[owner[use]])
                held += int(use.sum())
                if held >= FLUSH_KEYS:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "part int, keys binary")


def key_pairs(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of nodes with a key in common, and its level; a key of level ``ANY``, or of too many nodes, gives a chain of that level.

    Regions are what enough of these pairs join; ``_regions`` finds them without all pairs.
    """
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))  # keys sent twice
    key, node = key[new], node[new]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((first, [len(key)])))
    level = (key[first] & np.uint64(ANY)).astype(np.int64)
    ahead = np.repeat(first + size, size) - np.arange(len(key)) - 1  # nodes of the key behind this one
    chain = np.repeat((level == ANY) | (size > PAIRED), size)
    n = np.where(chain, np.minimum(ahead, 1), ahead)
    i = np.repeat(np.arange(len(key)), n)
    return node[i], node[expand(np.arange(1, len(key) + 1), n)], np.where(chain, ANY, np.repeat(level, size))[i]


def key_groups(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of two nodes at least: the key, where its nodes begin (one entry more than keys), and the nodes, sorted.

    A key of level ``ANY``, or of too many nodes, becomes keys of that level
    with ``PAIRED`` nodes at most, each of which starts with the last of the one before.
    """
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))  # keys sent twice
    key, node = key[new], node[new]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((first, [len(key)])))
    first, size = first[size > 1], size[size > 1]
    parts = -(-(size - 1) // (PAIRED - 1))
    at = expand(np.zeros(len(parts), np.int64), parts) * (PAIRED - 1)
    begin, many = np.repeat(first, parts) + at, np.minimum(np.repeat(size, parts) - at, PAIRED)
    name = key[begin]
    name[np.repeat(parts > 1, parts)] |= np.uint64(ANY)
    return name, np.concatenate(([0], np.cumsum(many))), node[expand(begin, many)]


def _regions(blobs: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the digests of sets that share as many keys as linked sets do, through others or at once.

    Of a key's sets each is first counted with the smallest alone, as near
    copies agree in key after key and all pairs of each key would grow with the
    square of their number.  What that links is one component; only sets of a
    key that are of different components are then counted in pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        for _, rows in runs_of(batches, 1):
            key, node = map(np.concatenate, zip(*(unpack_keys(blob.as_buffer()) for blob in rows.column(1))))
            order = np.argsort(key, kind="stable")
            key, node = key[order], node[order]
            same = np.concatenate(([False], key[1:] == key[:-1]))
            same |= np.concatenate((same[1:], [False]))
            if not same.any():
                continue
            name, bounds, nodes = key_groups(key[same], node[same])
            if len(name):
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(nodes))
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), lists], names=["key", "nodes"])

    groups = blobs.repartition("part").sortWithinPartitions("part").mapInArrow(run, "key bigint, nodes array<bigint>")
    groups = materialize(groups, "jaccard-shared", codec="lz4")
    level = F.col("key").bitwiseAND(F.lit(ANY).cast("long")).cast("int").alias("level")
    wanted = class_counts(size_levels(percent)[1:] - 1, percent)[0].tolist()
    enough = (F.col("level") == ANY) | (F.col("n") >= F.get(F.array(*[F.lit(int(x)) for x in wanted]), F.col("level")))

    def counted(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a", "b", "level").agg(F.count(F.lit(1)).alias("n"))

    hub = F.get("nodes", F.lit(0))
    stars = groups.select(hub.alias("a"), F.explode(F.slice("nodes", 2, PAIRED)).alias("b"), level)
    stars = materialize(counted(stars), "jaccard-stars")
    links = stars.filter(enough).select("a", "b")
    known = connected_components(links, "jaccard-near")

    def placed(rows: DataFrame, node: str, component: str) -> DataFrame:
        by = known.select(F.col("node").alias(node), F.col("component").alias("_of"))
        return rows.join(by, node, "left").withColumn(component, F.coalesce("_of", node)).drop("_of")

    # keys with a set that lies apart from their first
    apart = placed(placed(stars.filter(~enough).select("a", "b").distinct(), "a", "at"), "b", "other").filter("at <> other")
    holds = (hub == F.col("a")) & F.array_contains("nodes", F.col("b"))
    rest = groups.filter(level != ANY).join(apart.select("a", "b"), holds, "left_semi").select("key", F.explode("nodes").alias("node"))
    rest = materialize(placed(rest, "node", "at"), "jaccard-apart", codec="lz4")
    one, two = (rest.select("key", F.col("node").alias(x), F.col("at").alias(f"at_{x}")) for x in "ab")
    pairs = one.join(two, "key").filter("a < b and at_a <> at_b").select("a", "b", level)
    out = connected_components(links.unionAll(counted(pairs).filter(enough).select("a", "b")), "jaccard-regions")
    discard(groups, stars, rest)
    return out


def _join_regions(sets: DataFrame, percent: int) -> DataFrame:
    """rep, root, links: spanning forest and link counts from rows (region, lo, hi, own, rep, copies, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        for (_, lo, hi), rows in runs_of(batches, 3):
            own, rep, copies = (rows.column(c).to_numpy() for c in (3, 4, 5))
            each = [x.as_py() for x in rows.column(6)]
            once = list(dict(zip(zip(rep.tolist(), each), range(len(each)))).values())  # rows that repeat
            own, rep, copies = own[once], rep[once], copies[once]
            each = [np.frombuffer(each[x], np.uint64) for x in once]
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in each])))
            if lo == hi:
                side = np.zeros(len(rep), int)
            else:
                side = np.where(own == lo, 1, 2)
            links, root = Region(np.concatenate(each), bounds, percent).join(side, copies)
            used = np.flatnonzero(links)
            if not len(used):
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[used]), pa.array(rep[root[used]]), pa.array(links[used].astype(np.int64))],
                names=["rep", "root", "links"],
            )

    keys = ["region", "lo", "hi"]
    return sets.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "rep bigint, root bigint, links bigint")


def jaccard_classes(
    docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, region_shingles: int = REGION_SHINGLES
) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of (doc_id, text).

    Words are runs without ASCII white space, A-Z lowered; a text of fewer than
    ``k`` words has its whole sequence as one shingle; a text without words, or
    null, has none and links with nothing.  Sets link if 100 * common >=
    percent * union.  component_id is the smallest doc_id reached by links.
    Rows that repeat a doc_id are one node; rows without a doc_id take no part
    and their component is null.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = int(min(8192, max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    digests = materialize(_digests(rows, k), "jaccard-sizes")
    each = digests.filter("common is null").select("doc_id", "n", "h1", "h2")
    regions = _regions(_keys(rows, k, percent, ranges, _common(digests)), percent)
    known = each.filter("n > 0 and doc_id is not null")
    sets = materialize(
        known.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")),
        "jaccard-sets",
    )
    # sets of regions of two or more, and the shares of large regions
    cand = sets.join(regions.select(F.col("node").alias("h1"), F.col("component").alias("region")), "h1")
    totals = cand.groupBy("region").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    shares = F.when(F.col("total") <= region_shingles, F.lit(1)).otherwise(F.ceil(F.col("total") * 2 / F.lit(region_shingles)))
    cand = cand.join(totals.select("region", shares.cast("long").alias("shares")), "region")
    cand = materialize(cand.select("rep", "h1", "h2", "copies", "region", "shares"), "jaccard-candidates")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(6)):
                found, bounds = shingle_sets(_LOWER[data], offsets, k)
                h1, h2 = set_digests(found, bounds)
                # rows that repeat the representative's doc_id with another text are dropped here
                part = batch.slice(i, j - i)
                ok = np.flatnonzero((h1 == part.column(1).to_numpy()) & (h2 == part.column(2).to_numpy()))
                blobs = pa.array([found[bounds[d] : bounds[d + 1]].tobytes() for d in ok], pa.binary())
                cols = [part.column(c).take(pa.array(ok)) for c in (0, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays([*cols, blobs], names=["rep", "copies", "region", "shares", "shingles"])

    remove_shuffles(spark)  # the keys', before texts are dealt
    texts, many = rows.filter("doc_id is not null"), cand.count()
    if many <= BROADCAST_CANDIDATES:
        cand = F.broadcast(cand)
    elif many <= BROADCAST_IDS:  # texts of other sets stay where they are
        texts = texts.join(F.broadcast(cand.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi")
    texts = texts.join(cand, F.col("doc_id") == F.col("rep"))
    texts = texts.select("rep", "h1", "h2", "copies", "region", "shares", "text")
    held = texts.mapInArrow(shingled, "rep bigint, copies bigint, region bigint, shares bigint, shingles binary")
    held = held.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("shares")))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    held = held.select(
        "region", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "copies", "shingles"
    )
    found = materialize(_join_regions(held, percent), "jaccard-links")
    classes = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "jaccard-classes")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_set = (
        sets.join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .join(linked, "rep", "left")
        .select(
            "h1", "h2", F.coalesce("component", "rep").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    out = each.join(by_set, ["h1", "h2"], "left")
    alone = F.col("n") == 0
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))).alias("component_id"),
        F.when(alone | F.col("doc_id").isNull(), F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose class has a smaller doc_id.

    Of rows that repeat doc_id and text one stays; rows without a doc_id stay.
    """
    classes = materialize(jaccard_classes(docs, k, percent).select("doc_id", "component_id"), "jaccard-out")
    known = classes.filter("doc_id is not null")
    dropped = known.filter("doc_id <> component_id").select("doc_id").distinct()
    again = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    small = dropped.count() <= BROADCAST_IDS  # checked: 8 MB at most
    out = docs.join(F.broadcast(dropped) if small else dropped, "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return out
    twice = out.join(again, "doc_id", "left_semi").withColumn("_text_key", F.xxhash64("text"))
    once = twice.dropDuplicates(["doc_id", "_text_key"]).select(*docs.columns)
    return out.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
