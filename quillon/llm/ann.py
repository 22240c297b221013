"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Each vector is rotated; the signs of the rotated direction are its code.  With
o the unit vector and b the code as a unit vector, <b, q> / <b, o> estimates
<o, q>, off by at most ``eps * sqrt((1 - <b,o>^2) / <b,o>^2 / (d - 1))`` for a
unit q, but for a chance that falls quickly with ``eps``.  Vectors whose
upper bound reaches the k-th best so far (at first the k-th best lower bound)
are reranked by the exact inner product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import is_valid_vector, materialize, mix64, runs_of, steady_memory

BLOCK = 4096
#: Queries that meet an index block at once.  A block holds 4 bits and its vector's own bytes for each dimension, and
#: travels once for each of these, so what is shuffled is (vectors / QUERY_BLOCK) x queries blocks.  Vectors fetched
#: later by id would travel once for each query that reranks them, which is more from one rerank in some 300 vectors on.
QUERY_BLOCK = 16_384
EPS = 2.8
#: Bits of a code for each dimension: vectors are padded with zeros before the rotation.
BITS = 4
INDEX = "block bigint, ids binary, codes binary, norms binary, fixes binary, vectors binary"


def rotation(dim: int, seed: int, bits: int | None = None) -> np.ndarray:
    """A random rotation, after padding with zeros to ``bits``: dim x bits, rows orthonormal."""
    bits = bits or BITS * dim
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return q.T


def encode(x: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, norms, and <b, o> of each row."""
    norms = np.linalg.norm(x, axis=1)
    turned = (x / norms[:, None]) @ rot
    bits = turned > 0
    fixes = np.abs(turned).sum(axis=1) / np.sqrt(rot.shape[1])
    return np.packbits(bits, axis=1), norms, fixes


def estimate(codes: np.ndarray, norms, fixes, queries: np.ndarray, rot: np.ndarray, eps: float):
    """Estimates of <x, q> for all rows and queries, and how far off they may be."""
    bits = rot.shape[1]
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
    turned = (queries @ rot).astype(np.float32)
    raw = turned @ signs.T / np.float32(np.sqrt(bits))
    off = np.sqrt(np.maximum(1 - fixes**2, 0)) / fixes / np.sqrt(max(bits - 1, 1)) * eps * norms
    return raw * (norms / fixes).astype(np.float32), np.linalg.norm(queries, axis=1), off.astype(np.float32)


def query_marks(q: np.ndarray) -> np.ndarray:
    """A hash of each row, which sets queries of one vec_id apart."""
    out = np.zeros(len(q), np.uint64)
    for c in (q + 0.0).view(np.uint64).T:
        out = mix64(out) + c
    return mix64(out).view(np.int64)


class Best:
    """The ``k`` best of each query so far; their worst score bounds what later blocks must reach."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int, rot: np.ndarray, eps: float):
        self.q_ids, self.q, self.k, self.rot, self.eps = q_ids, q, k, rot, eps
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)
        self.scores = np.full((len(q), k), -np.inf)

    def add(self, x_ids, x, codes, norms, fixes) -> None:
        k = self.k
        for s in range(0, len(self.q), 256):
            z = slice(s, s + 256)
            est, q_norm, off = estimate(codes, norms, fixes, self.q[z], self.rot, self.eps)
            own = x_ids[None, :] == self.q_ids[z][:, None]
            est[own] = -np.inf
            reach = q_norm[:, None].astype(np.float32) * off[None, :]
            least = self.scores[z, -1]
            if est.shape[1] > k and np.isinf(least).any():
                least = np.maximum(least, np.partition(est - reach, -k, axis=1)[:, -k])
            est += reach
            qi, xi = np.nonzero((est >= least[:, None]) & ~own)
            score = np.empty(len(qi))
            for a in range(0, len(qi), 100_000):
                c = slice(a, a + 100_000)
                score[c] = np.einsum("ij,ij->i", self.q[z][qi[c]], x[xi[c]])
            good = score >= self.scores[z, -1][qi]
            qi, ids, score = qi[good], x_ids[xi[good]], score[good]
            for row in np.unique(qi):
                lo, hi = np.searchsorted(qi, (row, row + 1))
                i = np.concatenate((self.ids[s + row], ids[lo:hi]))
                v = np.concatenate((self.scores[s + row], score[lo:hi]))
                top = np.lexsort((i, -v))[:k]
                self.ids[s + row], self.scores[s + row] = i[top], v[top]

    def rows(self) -> pa.RecordBatch:
        keep = ~np.isinf(self.scores)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.q_ids, keep.sum(axis=1))), pa.array(np.repeat(query_marks(self.q), keep.sum(axis=1))),
                pa.array(self.ids[keep]), pa.array(self.scores[keep]),
            ],
            names=["query_id", "query_mark", "vec_id", "score"],
        )


def _kind(vectors: DataFrame) -> str:
    return "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"


def build_index(vectors: DataFrame, dim: int, seed: int = 5, block: int = BLOCK) -> DataFrame:
    """Blocks of codes, correction scalars and vectors (in their own precision) of all rows of (vec_id, embedding)."""
    kind = _kind(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        from pyspark import TaskContext

        rot, n = rotation(dim, seed), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_numpy()
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
            x = flat.reshape(len(ids), dim)
            for s in range(0, len(ids), block):
                part = x[s : s + block]
                codes, norms, fixes = encode(part, rot)
                blobs = [np.ascontiguousarray(a).tobytes() for a in (ids[s : s + block], codes, norms, fixes, part.astype(kind))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n]), *(pa.array([b], pa.binary()) for b in blobs)],
                    names=["block", "ids", "codes", "norms", "fixes", "vectors"],
                )
                n += 1

    return vectors.mapInArrow(run, INDEX)


def query_blocks(queries: DataFrame, dim: int, n_blocks: int) -> DataFrame:
    """Different queries (vec_id, embedding) dealt by hash into blocks 0 .. n_blocks-1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        for (qb,), t in runs_of(batches, 1):
            ids = t.column(1).to_numpy()
            x = t.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
            yield pa.RecordBatch.from_arrays(
                [pa.array([qb], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())],
                names=["qb", "q_ids", "q"],
            )

    dealt = queries.select(
        F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n_blocks)).cast("int").alias("qb"), "vec_id", "embedding"
    )
    return dealt.repartition("qb").sortWithinPartitions("qb").mapInArrow(run, "qb int, q_ids binary, q binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, eps: float = EPS, seed: int = 5,
            spread: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each query, ties to the smaller vec_id.

    Both inputs have (vec_id, embedding); rows that are null, zero or hold null
    or non-finite components take no part, nor do those of another length than
    the valid vector of smallest vec_id.  Rows with the query's vec_id are its
    own row.  Query rows that repeat vec_id and vector are one query; a vec_id
    with several vectors is a query for each, all ranked from 1.  Every other
    row is a candidate, repeated ones each.  Blocks of queries meet blocks of
    vectors by keys (query block, share of the index), so neither side is ever
    broadcast or held whole.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        return df.filter(F.col("vec_id").isNotNull() & is_valid_vector(F.col("embedding")))

    valid = clean(vectors)
    first = valid.select("vec_id", F.size("embedding").alias("d")).orderBy("vec_id", "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if first is None:
        return spark.createDataFrame([], schema)
    dim = first.d
    same = F.size("embedding") == dim
    index = materialize(build_index(valid.filter(same), dim, seed), "ann-index")
    kind = _kind(valid)
    asked = clean(queries).filter(same).distinct()
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    blocks = query_blocks(asked, dim, n_blocks)
    # fragment and replicate: every index block goes to each query block once
    if spread is None:  # tasks for each block of queries: more as the index grows, as each holds the queries
        spread = max(8, min(int(spark.conf.get("spark.sql.shuffle.partitions")), index.count() // 8))
    width = min(n_blocks * spread, 100_000)
    wide = index.withColumn("s", F.pmod(F.xxhash64("block"), F.lit(spread)).cast("int"))
    pairs = wide.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).repartition(width, "qb", "s")
    copies = blocks.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).repartition(width, "qb", "s")
    pairs = pairs.join(copies.hint("merge"), ["qb", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        rot, key, best = rotation(dim, seed), None, None
        for batch in batches:
            for i in range(batch.num_rows):
                at = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                cell = [batch.column(c)[i].as_buffer() for c in range(2, 9)]
                if at != key:
                    if best is not None:
                        yield best.rows()
                    q_ids = np.frombuffer(cell[5], "<i8")
                    best, key = Best(q_ids, np.frombuffer(cell[6]).reshape(len(q_ids), dim), k, rot, eps), at
                ids, norms, fixes = np.frombuffer(cell[0], "<i8"), np.frombuffer(cell[2]), np.frombuffer(cell[3])
                codes = np.frombuffer(cell[1], np.uint8).reshape(len(ids), -1)
                best.add(ids, np.frombuffer(cell[4], kind).reshape(len(ids), dim).astype(float), codes, norms, fixes)
        if best is not None:
            yield best.rows()

    near = pairs.select("qb", "s", "ids", "codes", "norms", "fixes", "vectors", "q_ids", "q").mapInArrow(
        run, "query_id bigint, query_mark bigint, vec_id bigint, score double"
    )
    by = Window.partitionBy("query_id", "query_mark").orderBy(F.col("score").desc(), "vec_id")
    return (
        near.withColumn("rank", F.row_number().over(by))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
