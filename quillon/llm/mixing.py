"""Mixing sources to target weights by fixed-length blocks.

A source's documents, in a fixed order, form one run of tokens that is cut into
blocks of ``block`` tokens.  The mix is a sequence of output shards of
``shard_blocks`` slots.  How many slots of a shard each source gets is a
multinomial draw whose totals over all shards are held at the sources' quotas:
the range of shards is halved again and again, and each half's counts are a
multivariate hypergeometric draw seeded by the node, so any task computes the
counts of its shards, and each source's slots before them, by itself.  The k-th
slot of a source takes block ``perm(k mod blocks)`` of its epoch ``k div
blocks``, where perm is a keyed Feistel permutation.  Slots and blocks are
joined by (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize, steady_memory, words_of

BLOCK = 64
SHARD_BLOCKS = 4096
CYCLE = (5.0, 2.0, 1.0)
MOST_COPIES = 3.0
#: The table of sources is held by the driver and sent to all tasks; more is an error.
MAX_SOURCES = 100_000
BUCKETS = 64
SLOTS = "shard bigint, slot bigint, source_no int, block bigint"
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def resolve_targets(sizes: list[int], weights: list[float], most: float = MOST_COPIES) -> list[float]:
    """Shares of the whole by weight, none above ``most`` times its size; the excess is shared by weight."""
    left, target = float(sum(sizes)), [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ = [i for i in open_ if i not in set(over)]
    return target


def quotas(sizes: list[int], targets: list[float], block: int) -> tuple[list[int], list[int]]:
    """Blocks of each source, and slots it gets: the target in blocks of the source's mean length."""
    blocks = [-(-s // block) for s in sizes]
    slots = [
        0 if not b else min(int(MOST_COPIES) * b, max(0, round(t * b / s))) for s, b, t in zip(sizes, blocks, targets)
    ]
    return blocks, slots


def shard_draws(first: int, last: int, n_shards: int, capacity: int, slots: np.ndarray, seed: int):
    """Yields (shard, counts, slots of each source before it) for shards first .. last-1."""

    def walk(lo: int, hi: int, counts: np.ndarray, before: np.ndarray):
        if hi <= first or lo >= last or not counts.sum():
            return
        if hi - lo == 1:
            yield lo, counts, before
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        room = min(int(counts.sum()), (mid - lo) * capacity)
        head = _draw(rng, counts, room)
        yield from walk(lo, mid, head, before)
        yield from walk(mid, hi, counts - head, before + head)

    yield from walk(0, n_shards, slots.astype(np.int64), np.zeros(len(slots), np.int64))


def _draw(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the ``counts`` slots without replacement: a multinomial draw held to what is left."""
    out, left, total = np.zeros_like(counts), n, int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        rest = total - c
        if total < 1_000_000_000:
            k = int(rng.hypergeometric(c, rest, left)) if left and total else 0
        else:  # beyond the generator's range: its normal limit
            p = c / total
            sd = np.sqrt(max(left * p * (1 - p) * (1 - left / total), 0))
            k = round(left * p + sd * rng.standard_normal())
        k = max(min(k, c, left), left - rest)
        out[i], left, total = k, left - k, rest
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def block_at(k: np.ndarray, epoch: np.ndarray, n: int, seed: int, source: int) -> np.ndarray:
    """The block that rank ``k`` takes in ``epoch``: a permutation of 0 .. n-1 for each epoch."""
    rows = int(np.ceil(np.sqrt(n))) or 1
    cols = -(-n // rows)
    key = (np.uint64(seed) << np.uint64(48)) ^ (epoch.astype(np.uint64) << np.uint64(32)) ^ np.uint64(source)

    def step(x: np.ndarray, key: np.ndarray) -> np.ndarray:
        left, right = x // cols, x % cols
        for r in range(4):
            if r % 2 == 0:
                f = _mix(_mix(key + np.uint64(r * 77 + 1)) ^ right.astype(np.uint64)) % np.uint64(rows)
                left = (left + f.astype(np.int64)) % rows
            else:
                f = _mix(_mix(key + np.uint64(r * 77 + 1)) ^ left.astype(np.uint64)) % np.uint64(cols)
                right = (right + f.astype(np.int64)) % cols
        return left * cols + right

    x = step(k.astype(np.int64), key)
    while (out := x >= n).any():
        x[out] = step(x[out], key[out])
    return x


class Mix:
    """A mix of ``docs`` (doc_id, text, source): its sources, slots and blocks.

    Null text has no tokens; a null source is a source of its own, last in
    order; sources of no tokens get nothing.  Rows that repeat are documents
    each.  Extra columns are ignored.  An empty table has an empty mix.
    """

    def __init__(self, docs: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = 17,
                 cycle: tuple[float, ...] = CYCLE):
        spark = docs.sparkSession
        self.block, self.shard_blocks, self.seed = block, shard_blocks, seed
        sized = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            token_count(F.col("text").cast("string")).alias("size"),
            F.xxhash64(F.col("text").cast("string")).alias("text_key"),
        )
        # counting words reads all texts: done once
        sized = materialize(
            sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(BUCKETS)).cast("int")), "mix-sizes"
        )
        # sources x BUCKETS rows
        totals = sized.groupBy("source", "bucket").agg(F.sum("size").alias("tokens"))
        rows = totals.groupBy("source").agg(F.sum("tokens").alias("tokens")).limit(MAX_SOURCES + 1).collect()
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        rows.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
        names = [r.source for r in rows]
        sizes = [int(r.tokens) for r in rows]
        self.targets = resolve_targets(sizes, [cycle[i % len(cycle)] for i in range(len(sizes))])
        self.n_blocks, self.slots_of = quotas(sizes, self.targets, block)
        self.n_shards = -(-sum(self.slots_of) // shard_blocks)
        table = [(i, n, s, t, b) for i, (n, s, t, b) in enumerate(zip(names, sizes, self.targets, self.n_blocks))]
        self.sources = spark.createDataFrame(
            table, "source_no int, source_name string, source_size long, target double, n_blocks long"
        )
        # tokens of a source before each document: buckets first, then documents in a bucket
        by = Window.partitionBy("source").orderBy("bucket")
        ahead = totals.select(
            F.col("source").alias("s"), F.col("bucket").alias("b"), (F.sum("tokens").over(by) - F.col("tokens")).alias("ahead")
        )
        inner = Window.partitionBy("source", "bucket").orderBy("doc_id", "text_key").rowsBetween(Window.unboundedPreceding, 0)
        placed = sized.withColumn("upto", F.sum("size").over(inner))
        placed = placed.join(F.broadcast(ahead), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        placed = placed.join(F.broadcast(self.sources), F.col("source").eqNullSafe(F.col("source_name")))
        self.documents = placed.select(
            "doc_id", "text_key", "source", "source_no", "size", "source_size", "target",
            (F.col("ahead") + F.col("upto") - F.col("size")).alias("start"),
        )

    def slots(self) -> DataFrame:
        """shard, slot, source_no, block: the mix itself, in order."""
        spark = self.documents.sparkSession
        n, m, seed = self.n_shards, self.shard_blocks, self.seed
        quota, n_blocks = np.array(self.slots_of, np.int64), self.n_blocks

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for shard in batch["id"].tolist():
                    for _, counts, before in shard_draws(shard, shard + 1, n, m, quota, seed):
                        who, what = [], []
                        for s in np.flatnonzero(counts):
                            k = before[s] + np.arange(counts[s])
                            who.append(np.full(len(k), s, np.int32))
                            what.append(block_at(k % n_blocks[s], k // n_blocks[s], n_blocks[s], seed, int(s)))
                        who, what = np.concatenate(who), np.concatenate(what)
                        order = np.random.default_rng([seed, shard, n]).permutation(len(who))
                        yield pd.DataFrame(
                            {"shard": shard, "slot": np.arange(len(who)), "source_no": who[order], "block": what[order]}
                        )

        width = max(1, min(n, 8 * spark.sparkContext.defaultParallelism))
        return spark.range(0, n, 1, width).mapInPandas(run, SLOTS)

    def spans(self) -> DataFrame:
        """A row for each block that a document touches: its columns, block, and tokens there."""
        first = F.call_function("div", F.col("start"), F.lit(self.block).cast("long"))
        last = F.call_function("div", F.col("start") + F.col("size") - 1, F.lit(self.block).cast("long"))
        out = self.documents.withColumn(
            "block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last)))
        )
        lo = F.greatest(F.col("start"), F.col("block") * self.block)
        hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * self.block)
        return out.withColumns({"within": lo - F.col("start"), "tokens": hi - lo})

    def uses(self) -> DataFrame:
        return self.slots().groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("uses"))

    def taken(self) -> DataFrame:
        """Each document with the tokens that the mix takes of it, repeats counted."""
        uses = self.uses()
        keys = ["doc_id", "text_key", "source", "source_no", "size", "source_size", "target", "start"]
        # documents of no tokens share their start with others of none: they skip the join
        spans = self.spans()
        # the planner cannot know how many slots there are, and must not send them to all tasks
        some = spans.filter("size > 0").join(uses.hint("merge"), ["source_no", "block"], "left")
        some = some.groupBy(*keys).agg(F.sum(F.col("tokens") * F.coalesce("uses", F.lit(0))).cast("long").alias("taken"))
        none = spans.filter("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
        return some.unionByName(none)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document."""
    return Mix(docs, **options).taken().select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``: for each copy that the mix takes of a document, a row with the text it takes.

    The first copy holds the blocks that are taken once at least, the second
    those taken twice, and so on; gaps between blocks become a line break.
    Documents of which nothing is taken have no row.  n_chars, if there, is
    that of the new text.  Rows that agree in doc_id, text and source are taken
    as one document.
    """
    mix = Mix(docs, **options)
    spans = mix.spans().filter("size > 0").join(mix.uses().hint("merge"), ["source_no", "block"])
    spans = spans.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("source").alias("_source")).agg(
        F.array_sort(F.collect_list(F.struct("within", "tokens", "uses"))).alias("_spans")
    )
    keyed = docs.withColumn("_text_key", F.xxhash64(F.col("text").cast("string")))
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
        & (F.col("_text_key") == F.col("_key"))
        & F.col("source").cast("string").eqNullSafe(F.col("_source"))
    )
    joined = keyed.join(spans.hint("merge"), same).select(*[keyed[c] for c in docs.columns], "_spans")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        for batch in batches:
            rows, texts = [], []
            for i in range(batch.num_rows):
                raw = batch.column(at)[i].as_py().encode()
                data = np.frombuffer(raw, np.uint8)
                starts, ends, _ = words_of(data, np.array([0, len(data)]))
                own = batch.column(batch.num_columns - 1)[i].values
                within, tokens, uses = (own.field(c).to_numpy() for c in ("within", "tokens", "uses"))
                for copy in range(int(uses.max())):
                    pieces: list[list[int]] = []
                    for w, t in zip(within[uses > copy].tolist(), tokens[uses > copy].tolist()):
                        if pieces and pieces[-1][1] == w:
                            pieces[-1][1] = w + t
                        else:
                            pieces.append([w, w + t])
                    rows.append(i)
                    texts.append(b"\n".join(raw[starts[a] : ends[b - 1]] for a, b in pieces).decode())
            out = batch.take(pa.array(rows, pa.int64())).select(range(batch.num_columns - 1))
            yield out.set_column(at, out.schema.field(at), pa.array(texts, out.schema.field(at).type))

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
