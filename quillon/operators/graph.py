"""Connected components by star contractions, and lens assignment of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.storage import discard, materialize


def connected_components(edges: DataFrame, label: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); component is the smallest node.

    Alternates large-star and small-star contractions: each node's row count
    stays near its degree, so a hub only ever holds a star, and the rounds grow
    with the logarithm of the path length.  Every round is a written table.
    Rows with a null or equal ends are ignored, an empty input gives no rows.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = edges.filter("a is not null and b is not null and a <> b")
    cur = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-0"
    )
    if cur.isEmpty():
        return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    done = False
    for i in range(1, max_rounds + 1):
        # large star: every larger neighbour of u goes to the smallest of u's neighbourhood
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        )
        nxt = materialize(small.filter("u <> v").distinct(), f"{label}-{i}")
        # finished when every node points once and no target points further
        stats = nxt.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("d")).first()
        if stats.n == stats.d and nxt.join(nxt.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            done = True
        discard(cur)
        cur = nxt
        if done:
            break
    if not done:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def star_edges(members: DataFrame, group: str, node: str) -> DataFrame:
    """Links (a, b) from each group's smallest member to its others: as many rows as members."""
    first = members.groupBy(group).agg(F.min(node).alias("a"))
    return members.join(first, group).filter(F.col(node) != F.col("a")).select("a", F.col(node).alias("b")).distinct()


def component_sizes(nodes: DataFrame, node: str, edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component) of every node, those without links alone."""
    found = connected_components(edges, label).withColumnRenamed("node", node)
    return nodes.select(node).distinct().join(found, node, "left").withColumn("component", F.coalesce("component", node))


def component_summary(components: DataFrame) -> DataFrame:
    """Number of components and the largest size; (0, null) without nodes."""
    each = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.count(F.lit(1)).alias("component_count"), F.max("n").alias("largest"))


def lenses_of(name: Column) -> Column:
    """The lenses that a name counts for: its own by prefix, else both."""
    return (
        F.when(name.startswith("lens0/"), F.array(F.lit(0)))
        .when(name.startswith("lens1/"), F.array(F.lit(1)))
        .otherwise(F.array(F.lit(0), F.lit(1)))
    )
