"""Near-duplicate vectors by collision-counting projections.

Vectors are projected on many random lines, and each line's projections are
sorted.  Two vectors collide on a line if one's rank lies in the window centred
at the other, whose bounds come from binary search.  Pairs that collide on at least a
calibrated number of lines are verified by their cosine in double precision.
The count's threshold is the one that a pair at the wanted cosine passes with
``recall`` at least, by the binomial law of its collisions.

Counting over all pairs would be quadratic, so counting runs within cells: the
first lines, ``g`` at a time, form the cells of ``L`` tables, where g grows
with the logarithm of the number of vectors and L is what the recall needs.
Equal vectors are one vector with a multiplicity.  A cell above ``cell_rows``
is dealt into shares, and each pair of shares is a task's work, so no task
holds an unbounded cell.  A pair is counted only in the first table where it
meets, and a cell gives row counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import connected_components, is_valid_vector, materialize, runs_of, steady_memory, union_roots

LINES = 48
WINDOW = 2.2  # half-width of a window, in deviations of a wanted pair's distance on a line
CELL = 7.5  # width of a cell, in the same unit
CELL_ROWS = 4000
#: Windows that are counted at a time, and lines between two looks at which pairs are left.
ROWS = 256
STEP = 6
RECALL = 0.995
TABLE_RECALL = 0.99


def _phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def calibrated_count(lines: int, window: float, recall: float) -> int:
    """Largest T such that a binomial (lines, chance of one collision) is T or more with ``recall``."""
    p = 2 * _phi(window) - 1
    tail = 0.0
    for t in range(lines, 0, -1):
        tail += math.comb(lines, t) * p**t * (1 - p) ** (lines - t)
        if tail >= recall:
            return t
    return 0


@lru_cache(maxsize=64)
def plan(n: int, threshold: float, dim: int, seed: int) -> dict:
    """Lines, cells and counts for ``n`` vectors: a pure function, so every task has the same for a dimension."""
    rng = np.random.default_rng([seed, dim])
    sd = math.sqrt(max(2 - 2 * threshold, 1e-9))  # of a wanted pair on a standard normal line
    g = max(2, round(0.8 * math.log2(max(n, 4))))
    # a cell of width w parts a pair at distance x on the line with chance |x| / w
    same = 1 - math.sqrt(2 / math.pi) / CELL
    tables = max(2, math.ceil(math.log(1 - TABLE_RECALL) / math.log(1 - same**g)))
    return {
        "lines": rng.standard_normal((dim, LINES)),
        "cells": rng.standard_normal((tables, dim, g)),
        "shift": rng.uniform(0, CELL * sd, (tables, g)),
        "keys": rng.integers(1, 1 << 62, (tables, g)) | 1,
        "width": CELL * sd,
        "half": WINDOW * sd,
        "least": calibrated_count(LINES, WINDOW, RECALL),
        "threshold": threshold,
        "tables": tables,
    }


def cells_of(x: np.ndarray, p: dict, tables: int | None = None) -> np.ndarray:
    """The cell of each row in each table, or in the first ``tables``."""
    tables = p["tables"] if tables is None else tables
    out = np.empty((len(x), tables), np.int64)
    for t in range(tables):
        at = np.floor((x @ p["cells"][t] + p["shift"][t]) / p["width"]).astype(np.int64)
        out[:, t] = (at * p["keys"][t]).sum(axis=1) + t
    return out


class Lines:
    """The sorted projections of some vectors on each line, for windows centred at others."""

    def __init__(self, x: np.ndarray, p: dict):
        at = x @ p["lines"]
        order = np.argsort(at, axis=0, kind="stable")
        self.sorted = np.take_along_axis(at, order, axis=0)
        # ranks and window bounds as small unsigned numbers: rank - lo < hi - lo, wrapping, is one comparison
        self.kind = np.uint16 if len(x) < 1 << 16 else np.uint32
        self.rank = np.empty(order.shape, self.kind, order="F")
        np.put_along_axis(self.rank, order, np.arange(len(x), dtype=self.kind)[:, None], axis=0)

    def windows(self, y: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
        """First rank and number of ranks of the window of each row of ``y`` on each line, by binary search."""
        at, half = y @ p["lines"], p["half"]
        lo, size = np.empty(at.shape, self.kind, order="F"), np.empty(at.shape, self.kind, order="F")
        for j in range(at.shape[1]):
            first = np.searchsorted(self.sorted[:, j], at[:, j] - half, side="left")
            lo[:, j] = first
            size[:, j] = np.searchsorted(self.sorted[:, j], at[:, j] + half, side="right") - first
        return lo, size


def colliding(lo: np.ndarray, size: np.ndarray, rank: np.ndarray, least: int):
    """Yields index pairs (window, vector) that collide on ``least`` lines at least.

    A pair that has missed more lines than it may is done with: lines are
    counted for all pairs of a block of windows while many are left, and then
    for those that are.
    """
    n_lines, may = rank.shape[1], rank.shape[1] - least
    for s in range(0, len(lo), ROWS):
        l, z = lo[s : s + ROWS], size[s : s + ROWS]
        missed = np.zeros((len(l), len(rank)), np.uint8)
        i = j = None
        for a in range(0, n_lines, STEP):
            lines = range(a, min(a + STEP, n_lines))
            if i is None:
                for k in lines:
                    missed += (rank[None, :, k] - l[:, None, k]) >= z[:, None, k]
                left = missed <= may
                if np.count_nonzero(left) * 5 < left.size or lines.stop == n_lines:
                    i, j = np.nonzero(left)
                    count = missed[i, j]
            else:
                for k in lines:
                    count += (rank[j, k] - l[i, k]) >= z[i, k]
                keep = count <= may
                i, j, count = i[keep], j[keep], count[keep]
        yield i + s, j


def links_between(xa, xb, table: int, p: dict, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two sets that pass count and cosine and meet in no earlier table."""
    ca, cb = cells_of(xa, p, table), cells_of(xb, p, table)
    lines, found = Lines(xb, p), []
    for i, j in colliding(*lines.windows(xa, p), lines.rank, p["least"]):
        if same:
            i, j = i[i < j], j[i < j]
        for a in range(0, len(i), 50_000):
            z = slice(a, a + 50_000)
            ok = np.einsum("ij,ij->i", xa[i[z]], xb[j[z]]) >= p["threshold"]
            if table:
                ok &= ~(ca[i[z]] == cb[j[z]]).any(axis=1)
            found.append((i[z][ok], j[z][ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, cell_rows: int = CELL_ROWS, seed: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do vectors of different length.  Rows that repeat a
    vector are linked with each other; rows without a vec_id take no part and
    their component is null.
    """
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    ok = F.col("vec_id").isNotNull() & is_valid_vector(F.col("embedding"))
    # 0.0 and -0.0 are one value
    plain = F.transform("embedding", lambda x: x + F.lit(0).cast("float" if kind == "<f4" else "double"))
    ids = materialize(
        rows.select(
            "vec_id",
            F.when(ok, F.xxhash64(F.lit(1), plain)).alias("h1"),
            F.when(ok, F.xxhash64(F.lit(2), plain)).alias("h2"),
            F.when(ok, F.size("embedding")).alias("dim"),
            F.when(ok, plain).alias("x"),
        ),
        "vec-rows",
    )
    reps = materialize(
        ids.filter("h1 is not null").groupBy("h1", "h2", "dim").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("x").alias("x")
        ),
        "vec-reps",
    )
    n_all = reps.count()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        for batch in batches:
            dims, rep, copies = (batch.column(c).to_numpy() for c in range(3))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = batch.column(3).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                y = x.astype(float)
                y /= np.linalg.norm(y, axis=1)[:, None]
                cells = cells_of(y, plan(n_all, threshold, int(d), seed))
                blobs = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
                for t in range(cells.shape[1]):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), d, np.int64)), pa.array(np.full(len(at), t, np.int64)),
                            pa.array(cells[:, t]), pa.array(rep[at]), pa.array(copies[at]), blobs,
                        ],
                        names=["dim", "tab", "cell", "rep", "copies", "x"],
                    )

    dealt = reps.select(F.col("dim").cast("long"), "rep", "copies", "x").mapInArrow(
        deal, "dim bigint, tab bigint, cell bigint, rep bigint, copies bigint, x binary"
    )
    dealt = materialize(dealt, "vec-cells")
    keys = ["dim", "tab", "cell"]
    full = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    work = dealt.join(full, keys)
    shares = F.ceil(F.col("n") / F.lit(cell_rows)).cast("long")
    work = work.withColumn("shares", shares).withColumn("own", F.pmod(F.xxhash64("rep", F.lit(9)), F.col("shares")))
    work = work.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    work = work.select(
        "dim", "tab", "cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        "own", "rep", "copies", "x",
    )
    key = ["dim", "tab", "cell", "lo", "hi"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        for (d, t, _, lo, hi), rows in runs_of(batches, 5):
            own, rep, copies = (rows.column(c).to_numpy() for c in (5, 6, 7))
            x = np.frombuffer(b"".join(rows.column(8).to_pylist()), kind).reshape(len(rep), d).astype(float)
            x /= np.linalg.norm(x, axis=1)[:, None]
            a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            if not len(a) or not len(b):
                continue
            i, j = links_between(x[a], x[b], t, plan(n_all, threshold, d, seed), lo == hi)
            if not len(i):
                continue
            i, j = a[i], b[j]
            n = len(rep)
            links = np.bincount(i, weights=copies[j], minlength=n) + np.bincount(j, weights=copies[i], minlength=n)
            root = union_roots(i, j, n)
            used = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[used]), pa.array(rep[root[used]]), pa.array(links[used].astype(np.int64))],
                names=["rep", "root", "links"],
            )

    found = work.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "rep bigint, root bigint, links bigint")
    found = materialize(found, "vec-links")
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vec-cc")
    # the smallest vec_id of a component is that of one of its representatives
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_rep = (
        reps.select("h1", "h2", "dim", "rep", "copies")
        .join(linked, "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "h1", "h2", "dim",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    out = ids.select("vec_id", "h1", "h2", "dim").join(by_rep, ["h1", "h2", "dim"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
