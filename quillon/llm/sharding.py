"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Only DataFrame functions.  A row's global number comes from hash buckets of its
content: the rows of a bucket are numbered in order, and the buckets' sizes (a
table of ``n_buckets`` rows at most) give each bucket's first number.  The
number is then permuted by a Feistel network over ``rows x cols >= N`` with
cycle walking back into ``0..N-1``.  Shard and slot follow from the permuted
number alone, and the shards' sizes differ by one row at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Passes of the network; four make a pseudorandom permutation of a pseudorandom round function.
ROUNDS = 4
#: Steps of cycle walking.  rows * cols exceeds N by less than rows, so a walk is
#: shorter than rows (at most 64 for N <= 4096), and beyond that each step leaves
#: 0..N-1 with a chance under 1/64.
WALK = 64


def _keyed(x: Column, key: int, modulus: Column) -> Column:
    return F.pmod(F.xxhash64(x, F.lit(key).cast("long")), modulus)


def feistel_step(x: Column, rows: Column, cols: Column, seed: int) -> Column:
    """One pass of the network: a bijection of 0 .. rows * cols - 1."""
    left, right = F.call_function("div", x, cols), F.pmod(x, cols)
    for r in range(ROUNDS):
        if r % 2 == 0:
            left = F.pmod(left + _keyed(right, seed * 1000 + r, rows), rows)
        else:
            right = F.pmod(right + _keyed(left, seed * 1000 + r, cols), cols)
    return left * cols + right


def permute(x: Column, n: Column, rows: Column, cols: Column, seed: int) -> Column:
    """The permuted number of ``x`` in 0 .. n-1."""
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        feistel_step(x, rows, cols, seed),
        lambda acc, _: F.when(acc < n, acc).otherwise(feistel_step(acc, rows, cols, seed)),
    )
    first = feistel_step(x, rows, cols, seed)
    return F.when(first < n, first).otherwise(walk)


def global_row_numbers(df: DataFrame, order: list[Column], n_buckets: int = 4096) -> DataFrame:
    """Adds ``_row`` (0 .. N-1) and ``_n`` (N).

    Rows equal in all of ``order`` may change places among themselves; all
    else is the same in every run, whatever the partitions.
    """
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n_buckets)).cast("int"))
    sizes = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    by = Window.orderBy("_bucket")
    sizes = sizes.select(
        F.col("_bucket").alias("_b"),
        (F.sum("_size").over(by) - F.col("_size")).alias("_first"),
        F.sum("_size").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"),
    )
    numbered = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    out = numbered.join(F.broadcast(sizes), F.col("_bucket") == F.col("_b"))  # n_buckets rows at most
    return out.withColumn("_row", F.col("_first") + F.col("_rn") - 1).drop("_bucket", "_b", "_first", "_rn")


def feistel_shards(
    df: DataFrame, order: list[Column], n_shards: int, seed: int = 1, n_buckets: int = 4096
) -> DataFrame:
    """Adds ``shard`` (0 .. n_shards-1) and ``slot`` (gapless from 0 in each shard).

    ``order`` identifies a row: columns whose values decide its global number.
    Existing columns of these names are replaced.  An empty input stays empty;
    nulls in ``order`` are values like others.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    out = global_row_numbers(df.drop("shard", "slot"), order, n_buckets)
    rows = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("_n").cast("double"))).cast("long"))
    out = out.withColumn("_rows", rows)
    out = out.withColumn("_cols", F.call_function("div", F.col("_n") + F.col("_rows") - 1, F.col("_rows")))
    out = out.withColumn("_at", permute(F.col("_row"), F.col("_n"), F.col("_rows"), F.col("_cols"), seed))
    return (
        out.withColumn("shard", F.pmod(F.col("_at"), F.lit(n_shards)).cast("int"))
        .withColumn("slot", F.call_function("div", F.col("_at"), F.lit(n_shards).cast("long")))
        .drop("_row", "_n", "_rows", "_cols", "_at")
    )


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    The law is ``rows``: shards' counts are at most one apart.  A null text has
    16 bytes and the checksum of nothing.  Rows that agree in doc_id, size and
    checksum may change places among themselves.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    digest = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw).cast("long") + 16).alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    out = feistel_shards(digest, [F.col("doc_id"), F.col("size"), F.col("text_crc32")], n_shards, seed)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
