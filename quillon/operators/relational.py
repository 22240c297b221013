"""Set comparisons, keyed lookups, upserts and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.functions.numeric import coverage_ratio
from quillon.functions.strings import base_name


def in_both(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_semi")


def missing_from(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")


def coverage_of(left: DataFrame, right: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Per group: left rows, those with a match, the ratio, and whether all have one (false without rows)."""
    marked = left.join(right.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
    out = marked.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_hit")).alias("covered"))
    return out.withColumns(
        {"coverage": coverage_ratio("covered", "total"), "complete": (F.col("total") > 0) & (F.col("covered") == F.col("total"))}
    )


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the last in order."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, as (side, ...): empty if the sets are equal.  Duplicates count once."""
    a = left.distinct().exceptAll(right.distinct()).withColumn("side", F.lit("left"))
    b = right.distinct().exceptAll(left.distinct()).withColumn("side", F.lit("right"))
    return a.unionByName(b)


def name_sets(expected: DataFrame, registered: DataFrame, by: list[str], name: str) -> DataFrame:
    """Per group: expected, registered, missing and unexpected names, distinct on both sides."""
    e = expected.select(*by, name).distinct().withColumn("_e", F.lit(1))
    r = registered.select(*by, name).distinct().withColumn("_r", F.lit(1))
    both = e.join(r, [*by, name], "full")
    return both.groupBy(*by).agg(
        F.count("_e").alias("expected"), F.count("_r").alias("registered"),
        F.count_if(F.col("_r").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("unexpected"),
    )


def complete_rigs(expected: DataFrame, registered: DataFrame, frame: str, lens: str) -> DataFrame:
    """One row: frames with any lens registered, and those whose two lenses are both expected and registered."""
    e = expected.select(frame, lens).distinct().groupBy(frame).agg(F.count(lens).alias("_e"))
    r = registered.select(frame, lens).distinct().groupBy(frame).agg(F.count(lens).alias("_r"))
    both = e.join(r, frame, "left").fillna(0, ["_r"])
    return both.agg(
        F.count(F.lit(1)).alias("expected_frames"),
        F.count_if(F.col("_r") > 0).alias("any_lens"),
        F.count_if((F.col("_e") == 2) & (F.col("_r") == 2)).alias("complete"),
    )


def prefix_match(files: DataFrame, rules: DataFrame, name: str, prefix: str) -> DataFrame:
    """Files with the first rule, in order of its prefix, that starts their name.

    Rules meet files by the prefix lengths that occur (a handful), so this is
    an equi-join on the name's first characters.
    """
    sized = rules.withColumn("_len", F.length(prefix))
    # a file has a row for each length; the lengths are no more than the longest prefix has characters
    lengths = [r[0] for r in sized.select("_len").distinct().collect()]
    if not lengths:
        return files.join(rules, F.lit(False), "left")
    head = files.withColumn("_len", F.explode(F.array(*[F.lit(n) for n in lengths])))
    head = head.withColumn("_head", F.substring(name, F.lit(1), F.col("_len")))
    both = head.join(sized.withColumnRenamed("_len", "_l2"), (F.col("_head") == F.col(prefix)) & (F.col("_len") == F.col("_l2")))
    w = Window.partitionBy(name).orderBy(prefix)
    best = both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_len", "_l2", "_head")
    return files.join(best.select(name, *rules.columns), name, "left")


def pair_siblings(files: DataFrame, path: str) -> DataFrame:
    """Files of two marker roles paired by name: the last ``_00_`` or ``_10_`` decides the role and the key."""
    low = F.lower(F.col(path))
    role = F.regexp_extract(low, r"^.*_([01]0)_", 1)
    key = F.regexp_replace(low, r"^(.*)_[01]0_", "$1_xx_")
    rows = files.select(F.col(path).alias("path"), F.nullif(role, F.lit("")).alias("role"), key.alias("pair_key"))
    rows = rows.filter("role is not null")
    a = rows.filter("role = '00'").select("pair_key", F.col("path").alias("lens0"))
    b = rows.filter("role = '10'").select("pair_key", F.col("path").alias("lens1"))
    return a.join(b, "pair_key", "full")


def schema_issues(df: DataFrame, expected: StructType) -> list[str]:
    """Missing columns and other types; empty if the frame fits.  More columns are allowed."""
    have = {f.name: f.dataType for f in df.schema}
    out = [f"missing {f.name}" for f in expected if f.name not in have]
    return out + [f"type of {f.name}" for f in expected if f.name in have and have[f.name] != f.dataType]


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], ident: str, keep: dict[str, Column], values: list[str],
           defaults: dict[str, Column]) -> DataFrame:
    """``target`` with ``changes`` (keys, values) applied: values are replaced, other columns kept.

    ``keep`` says which of a row's old columns stay; new rows take ``defaults``
    and the next numbers after the largest, in order of their keys.  A key that
    is in the target twice is an error at run time.
    """
    both = target.withColumn("_t", F.lit(1)).join(
        changes.select(*keys, *[F.col(v).alias(f"_{v}") for v in values], F.lit(1).alias("_c")), keys, "full"
    )
    twice = Window.partitionBy(*keys)
    both = both.withColumn(
        "_ok", F.when((F.count("_t").over(twice) > 1) & F.col("_c").isNotNull(), F.raise_error(F.lit("ambiguous key"))).otherwise(F.lit(True))
    ).filter("_ok is null or _ok")
    new = F.col("_t").isNull()
    for v in values:
        both = both.withColumn(v, F.when(F.col("_c").isNotNull(), F.col(f"_{v}")).otherwise(F.col(v)))
    for c, rule in keep.items():
        both = both.withColumn(c, F.when(new | F.col("_c").isNull(), F.col(c)).otherwise(rule))
    for c, value in defaults.items():
        both = both.withColumn(c, F.when(new, value).otherwise(F.col(c)))
    # numbers for the new rows alone: buckets' counts, then the place in a bucket
    most = target.agg(F.coalesce(F.max(ident), F.lit(0)).alias("_most"))
    added = both.filter(new)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(256))
    sizes = added.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n"))  # 256 rows
    added = added.withColumn("_b", bucket).withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy(*keys)))
    added = added.join(F.broadcast(sizes), "_b").join(F.broadcast(most))
    added = added.withColumn(ident, (F.col("_most") + F.col("_before") + F.col("_k")).cast(target.schema[ident].dataType))
    cols = target.columns
    return both.filter(~new).select(*cols).unionByName(added.select(*cols))


def set_flag(target: DataFrame, accepted: DataFrame, key: str, flag: str) -> DataFrame:
    """``flag`` = 1 on the rows whose key is accepted; others keep theirs."""
    hit = accepted.select(key).distinct().withColumn("_hit", F.lit(1))
    return target.join(hit, key, "left").withColumn(flag, F.coalesce("_hit", flag)).drop("_hit").select(*target.columns)


def emptied(*tables: DataFrame) -> list[DataFrame]:
    """The tables without rows, schemas kept."""
    return [t.limit(0) for t in tables]


def write_checked(df: DataFrame, path: str, checks: list[tuple[str, DataFrame]]) -> int:
    """All or nothing: every check must be without rows before the one write; the result is read back and compared.

    Returns the rows written.  A check's first rows are in the error.
    """
    for name, bad in checks:
        rows = bad.limit(5).collect()
        if rows:
            raise ValueError(f"{name}: {rows}")
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    want, got = (x.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*x.columns).cast("decimal(38,0)"))).first() for x in (df, back))
    if tuple(want) != tuple(got):
        raise ValueError(f"{path} does not hold what was written")
    return got[0]


def any_row(df: DataFrame, where: Column) -> bool:
    return not df.filter(where).limit(1).isEmpty()


def unique_ignoring_case(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The first of each value, whatever its case, in order."""
    w = Window.partitionBy(*by, F.lower(F.trim(value))).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def marker(gravity: DataFrame, focal: DataFrame) -> DataFrame:
    """One row of two reports of one row each, and whether both wrote something."""
    both = gravity.join(focal)  # one row with one row
    return both.withColumn("complete", (F.col("gravity_rows") > 0) & (F.col("focal_rows") > 0))


def project_state(events: DataFrame, by: list[str], order: str, status: str) -> DataFrame:
    """Each project's first and last event, its last status, and the number of events."""
    return events.groupBy(*by).agg(
        F.min(order).alias("created"), F.max(order).alias("updated"), F.max_by(status, order).alias("status"), F.count(F.lit(1)).alias("revisions")
    )


def fingerprints(inputs: DataFrame, by: list[str], order: str, part: Column, settings: str) -> DataFrame:
    """A digest of the settings and of each group's inputs in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p"))))
    said = F.concat(F.lit(f"{settings}|"), F.array_join(F.transform(parts, lambda e: e["p"]), ","))
    return inputs.groupBy(*by).agg(F.sha2(said, 256).alias("fingerprint"))


def reusable(now: DataFrame, before: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``reused``: whether the earlier run had the same fingerprint."""
    old = before.select(*by, F.col("fingerprint").alias("_f"))
    return now.join(old, by, "left").withColumn("reused", F.coalesce(F.col("_f") == F.col("fingerprint"), F.lit(False))).drop("_f")


def selected(rows: DataFrame, paths: list[str], flag: str = "selected") -> DataFrame:
    """The selected rows, with the base names of their paths."""
    return rows.filter(F.coalesce(F.col(flag), F.lit(False))).withColumns({p: base_name(p) for p in paths})
