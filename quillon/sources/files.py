"""Listings, documents and tool output as tables, and the sinks that publish reports."""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.functions import strings as S
from quillon.functions.numeric import fraction, is_finite
from quillon.storage import scratch_path


def listing(spark: SparkSession, root: str, recursive: bool = True, glob: str = "*") -> DataFrame:
    """(path, name, length, modified) of files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob)
    out = files.load(root).select("path", F.col("length").alias("length"), F.col("modificationTime").alias("modified"))
    clean = root.rstrip("/").removeprefix("file:").replace("//", "/")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^/*{clean.lstrip('/')}/?", "")
    return out.withColumn("name", S.slashes(relative))


def images(files: DataFrame, extensions: tuple[str, ...] = S.IMAGE_EXTENSIONS) -> DataFrame:
    """Image files with their sequence number, ranked by lower-cased name."""
    out = files.filter(S.has_extension("name", extensions)).withColumn("sequence", S.trailing_number(S.stem("name")))
    return out.withColumn("sort_key", F.lower("name"))


def mask_targets(files: DataFrame) -> DataFrame:
    """Images with their mask's name, and whether another image has the same."""
    out = images(files).withColumn("mask", S.mask_path("name"))
    return out.withColumn("conflict", F.count(F.lit(1)).over(Window.partitionBy("mask")) > 1)


def model_folder(names: DataFrame) -> DataFrame:
    """One row: the folder of the model among relative file names: sparse/0, else the first below sparse, else sparse."""
    below = F.regexp_extract("name", r"^sparse/([^/]+)/", 1)
    found = names.agg(
        F.max(below == "0").alias("zero"), F.min(F.nullif(below, F.lit(""))).alias("first"), F.max(F.col("name").startswith("sparse/")).alias("any")
    )
    folder = F.when(F.col("zero"), F.lit("sparse/0")).when(F.col("first").isNotNull(), F.concat(F.lit("sparse/"), "first"))
    return found.select(F.coalesce(folder, F.when(F.col("any"), F.lit("sparse"))).alias("folder"))


def json_documents(spark: SparkSession, path: str, schema: StructType | str, lines: bool = False) -> DataFrame:
    """One document a file, or with ``lines`` a line, by a given schema; what does not fit is null."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).option("mode", "PERMISSIVE").json(path)


def still_valid(cached: DataFrame, schema_version: int, revision: str) -> Column:
    """Whether an exported document still stands for its source: versions, size, time, and any samples."""
    c = F.col
    return (
        (c("schema_version") == schema_version) & (c("parser_revision") == revision) & (c("source_size") == c("size"))
        & (c("source_modified") == c("modified"))
        & (F.greatest(*[F.coalesce(c(n), F.lit(0)) for n in ("gyro_samples", "accel_samples", "attitude_samples")]) > 0)
    )


def expand_samples(frames: DataFrame, samples: str, ts: str, duration: str, offset: float = 0.0) -> DataFrame:
    """A row for each sample of a frame, stamped evenly over the frame's duration."""
    n = F.greatest(F.size(samples), F.lit(1))
    out = frames.withColumn("_n", n).select("*", F.posexplode(samples).alias("sample_index", "sample"))
    return out.withColumn("sample_ts", F.col(ts) + (F.col("sample_index") - offset) / F.col("_n") * F.col(duration)).drop("_n", samples)


def key_values(lines: DataFrame, value: str = "value", separator: str = "=") -> DataFrame:
    """(key, value) of ``KEY=value`` or ``Marker: value`` lines; quotes around a value go."""
    at = F.instr(F.col(value), separator)
    rows = lines.filter(at > 0)
    key = F.trim(F.substring(F.col(value), F.lit(1), at - 1))
    rest = F.trim(F.substring(F.col(value), at + len(separator), F.length(value)))
    return rows.select(key.alias("key"), F.regexp_replace(rest, "^\"(.*)\"$", "$1").alias("value"))


def device_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(index, name) of ``index, name`` lines."""
    index = F.trim(F.substring_index(F.col(value), ",", 1)).try_cast("int")
    name = F.trim(F.regexp_replace(F.col(value), "^[^,]*,", ""))
    return lines.select(index.alias("index"), name.alias("name")).filter("index is not null and name <> ''")


def device_labels(devices: DataFrame, name: str, order: str) -> DataFrame:
    """Names that occur more than once get their ordinal."""
    w = Window.partitionBy(name)
    n, k = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(order))
    return devices.withColumn("label", F.when(n > 1, F.format_string("%s #%d", F.col(name), k)).otherwise(F.col(name)))


def has_option(lines: DataFrame, option: str, negative: str | None = None, value: str = "value") -> Column:
    """An aggregate: whether help text names the option as a word of its own; a negative marker wins."""
    named = F.bool_or(F.coalesce(F.col(value).rlike(rf"(^|[\s,\[(=|]){option}($|[\s,=\])|:<])"), F.lit(False)))
    if negative is None:
        return named
    return named & ~F.bool_or(F.coalesce(F.lower(F.col(value)).contains(negative), F.lit(False)))


# --------------------------------------------------------------------- sinks

#: Rows of a comparison, each a column of its table.
MOST_COLUMNS = 1000


def write_document(df: DataFrame, path: str) -> None:
    """A report as one JSON document a row; the writer's commit makes it appear whole or not at all."""
    df.write.mode("overwrite").json(path)


def markdown_table(df: DataFrame, label: str, metrics: list[str]) -> str:
    """A comparison of a few rows as a table with a column for each; a missing value is a dash.

    More than ``MOST_COLUMNS`` rows are an error, not a shorter table.
    """
    rows = df.select(label, *metrics).orderBy(label).limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS:
        raise ValueError(f"a comparison has {MOST_COLUMNS} rows at most")
    lines = ["| metric | " + " | ".join(str(r[label]) for r in rows) + " |", "| --- |" + " --- |" * len(rows)]
    for m in metrics:
        cells = ["-" if r[m] is None else f"{r[m]:g}" if isinstance(r[m], float) else str(r[m]) for r in rows]
        lines.append(f"| {m} | " + " | ".join(cells) + " |")
    return "\n".join(lines)


def artifact_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(name, length, sha256) of files below a folder; order by name when it is shown."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    names = listing(spark, root).select("path", "name")
    return files.select("path", "length", F.sha2("content", 256).alias("sha256")).join(names, "path").drop("path")


def rotation_line(q) -> Column:
    """A similarity of scale one and no shift as a text line of seventeen decimals."""
    return F.concat_ws(" ", F.lit("1"), *[F.format_string("%.17f", c) for c in q], F.lit("0 0 0"))


def event_log(events: DataFrame, path: str, checkpoint: str):
    """A stream of events as JSON lines, each file whole or absent; returns the running query."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finite_samples(samples: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows whose array of three is finite, for each column."""
    ok = {c: F.count_if((F.size(c) == 3) & F.forall(c, is_finite)).alias(c) for c in columns}
    return samples.agg(*ok.values())


def write_pair(first: tuple[DataFrame, str], second: tuple[DataFrame, str]) -> None:
    """Two tables at two paths, both or neither.

    Both are written beside their places first, so a failure there changes
    nothing; then the old ones are moved away and the new ones in, and a move
    that fails is undone in reverse order.
    """
    spark = first[0].sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(first[1]).getFileSystem(spark._jsc.hadoopConfiguration())
    mark, places = uuid.uuid4().hex, [first[1].rstrip("/"), second[1].rstrip("/")]
    done: list[tuple[str, str]] = []

    def move(a: str, b: str) -> None:
        if not store.rename(path(a), path(b)):
            raise OSError(f"{a} could not be moved to {b}")
        done.append((a, b))

    try:
        for (df, _), place in zip((first, second), places):
            df.write.parquet(f"{place}.new-{mark}")
        for place in places:
            if store.exists(path(place)):
                move(place, f"{place}.old-{mark}")
            move(f"{place}.new-{mark}", place)
    except Exception:
        for a, b in reversed(done):
            store.rename(path(b), path(a))
        raise
    finally:
        for place in places:
            for kind in ("new", "old"):
                store.delete(path(f"{place}.{kind}-{mark}"), True)


# -------------------------------------------------------------------- SQLite


def sqlite_file(spark: SparkSession, table: str, columns: str, rows: list[tuple]) -> str:
    """A small database file with one table, in the shared folder; that must be a mounted one."""
    path = scratch_path(spark, "sqlite").removeprefix("file:") + ".db"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with sqlite3.connect(path) as db:
        db.execute(f"create table {table} ({columns})")
        db.executemany(f"insert into {table} values ({', '.join('?' * len(rows[0]))})", rows)
    db.close()
    return path


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, parts: int = 8) -> DataFrame:
    """A table of a database file, opened read-only and read by ranges of its row numbers."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        low, high = db.execute(f"select min(rowid), max(rowid) from {table}").fetchone()
        for pdf in batches:
            for i in pdf["id"]:
                a, b = (low + (high - low + 1) * j // parts for j in (int(i), int(i) + 1)) if low is not None else (0, 0)
                found = db.execute(f"select {', '.join(names)} from {table} where rowid >= ? and rowid < ?", (a, b))
                while rows := found.fetchmany(10_000):
                    yield pd.DataFrame(rows, columns=names)
        db.close()

    return spark.range(0, parts, 1, parts).mapInPandas(run, schema)


# -------------------------------------------------------- listings and probes

#: Extensions of the files that count as sources.
SOURCE_EXTENSIONS = ("insv", "360", "osv", "mp4", "mov", "mkv")
PROBE = (
    "streams array<struct<codec_type:string,width:int,height:int,r_frame_rate:string>>, format struct<duration:string>"
)


def sources(listed: DataFrame) -> DataFrame:
    return listed.filter(S.has_extension("name", SOURCE_EXTENSIONS))


def ranked(listed: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """Adds ``place``: the row's number in order of ``key``, by first characters, their counts, and the order among equals."""
    head = F.substring(key, 1, 4)
    sizes = listed.groupBy(head.alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_h")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("_h").orderBy(key))
    out = listed.withColumn("_h", head).withColumn("place", own).join(sizes, "_h")
    return out.withColumn("place", F.col("place") + F.col("_before")).drop("_h", "_before")


def model_folders(names: DataFrame, by: list[str]) -> DataFrame:
    """As :func:`model_folder`, for each group of names."""
    below = F.regexp_extract("name", r"^sparse/([^/]+)/", 1)
    found = names.groupBy(*by).agg(
        F.max(below == "0").alias("zero"), F.min(F.nullif(below, F.lit(""))).alias("first"), F.max(F.col("name").startswith("sparse/")).alias("any")
    )
    folder = F.when(F.col("zero"), F.lit("sparse/0")).when(F.col("first").isNotNull(), F.concat(F.lit("sparse/"), "first"))
    return found.select(*by, F.coalesce(folder, F.when(F.col("any"), F.lit("sparse"))).alias("folder"))


def probed(rows: DataFrame, document: str) -> DataFrame:
    """Adds width, height, fps and duration_ms of a probe document's first video stream."""
    doc = F.from_json(document, PROBE)
    video = F.get(F.filter(doc["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    return rows.withColumns(
        {
            "width": video["width"], "height": video["height"], "fps": fraction(video["r_frame_rate"]),
            "duration_ms": doc["format"]["duration"].try_cast("double") * 1000,
        }
    )
