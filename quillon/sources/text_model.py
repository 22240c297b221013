"""Readers of reconstruction models as whitespace text: cameras, images, points, frames, pairs, tables of colours.

A file that is missing is recorded by the caller (see :func:`read_model`), a
row that does not parse is dropped and can be counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby, islice, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.numeric import is_finite

TRACK = "array<struct<image_id:bigint,point2d_index:bigint>>"


def _path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def data_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, text) of lines that are neither blank nor comments, trimmed.

    Files are split over tasks; a block's lines come one after the other, in
    the file's order, and ``block`` is where it begins.
    """
    text = F.trim(F.regexp_replace("value", r"\r\z", ""))
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), text.alias("text"))
    return lines.filter("text <> '' and not startswith(text, '#')")


def token_lines(spark: SparkSession, path: str) -> DataFrame:
    """(tokens) of the data lines, files split over tasks."""
    text = F.trim(F.regexp_replace("value", r"\s+", " "))
    return spark.read.text(path).select(text.alias("text")).filter("text <> '' and not startswith(text, '#')").select(
        F.split("text", " ").alias("tokens")
    )


def _at(i: int, kind: str):
    return F.get("tokens", F.lit(i)).try_cast(kind)


def _numbers(first: int, count: int):
    return F.array(*[_at(first + i, "double") for i in range(count)])


def _complete(*columns):
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull()
    return out


def cameras(lines: DataFrame) -> DataFrame:
    """camera_id, model, width, height, params: five tokens at least; parameters that are no numbers are left out."""
    ident, width, height = _at(0, "bigint"), _at(2, "bigint"), _at(3, "bigint")
    params = F.transform(F.slice("tokens", 5, F.greatest(F.size("tokens") - 4, F.lit(0))), lambda t: t.try_cast("double"))
    rows = lines.filter((F.size("tokens") >= 5) & _complete(ident, width, height))
    return rows.select(
        ident.alias("camera_id"), F.get("tokens", F.lit(1)).alias("model"), width.alias("width"), height.alias("height"),
        F.array_compact(params).alias("params"),
    )


def points(lines: DataFrame) -> DataFrame:
    """point3d_id, xyz, rgb, err, track: eight tokens at least; a bad number drops the row, a bad track entry itself."""
    ident, err = _at(0, "bigint"), _at(7, "double")
    rgb = [_at(i, "int") for i in (4, 5, 6)]
    xyz = [_at(i, "double") for i in (1, 2, 3)]
    ok = _complete(ident, err, *xyz, *rgb)
    for c in rgb:
        ok = ok & c.between(0, 255)
    n = F.floor((F.size("tokens") - 8) / 2).cast("int")
    pair = lambda i: F.struct(
        F.get("tokens", 8 + 2 * i).try_cast("bigint").alias("image_id"), F.get("tokens", 9 + 2 * i).try_cast("bigint").alias("point2d_index")
    )
    track = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), pair)).otherwise(F.array().cast(TRACK))
    track = F.filter(track, lambda t: t["image_id"].isNotNull() & t["point2d_index"].isNotNull())
    return lines.filter((F.size("tokens") >= 8) & ok).select(
        ident.alias("point3d_id"), F.array(*xyz).alias("xyz"), F.array(*[c.cast("smallint") for c in rgb]).alias("rgb"),
        err.alias("err"), track.alias("track"),
    )


def frames(lines: DataFrame) -> DataFrame:
    """frame_id, rig_id, q, t, data: ten tokens at least; the declared triples as far as they go."""
    ident, rig, count = _at(0, "bigint"), _at(1, "bigint"), _at(9, "int")
    pose = [_at(i, "double") for i in range(2, 9)]
    n = F.least(count, F.floor((F.size("tokens") - 10) / 3).cast("int"))
    triple = lambda i: F.struct(
        F.get("tokens", 10 + 3 * i).alias("sensor_type"), F.get("tokens", 11 + 3 * i).try_cast("bigint").alias("sensor_id"),
        F.get("tokens", 12 + 3 * i).try_cast("bigint").alias("data_id"),
    )
    none = F.array().cast("array<struct<sensor_type:string,sensor_id:bigint,data_id:bigint>>")
    data = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), triple)).otherwise(none)
    return lines.filter((F.size("tokens") >= 10) & _complete(ident, rig, count, *pose)).select(
        ident.alias("frame_id"), rig.alias("rig_id"), _numbers(2, 4).alias("q"), _numbers(6, 3).alias("t"),
        F.filter(data, lambda d: d["sensor_id"].isNotNull() & d["data_id"].isNotNull()).alias("data"),
    )


#: Rows that a reader gives out at a time.
IMAGE_ROWS = 4096


def _head(tokens: list[str]) -> tuple | None:
    """An image's first line: id, pose, camera, name; none if it does not parse."""
    if len(tokens) < 10:
        return None
    try:
        pose = [float(x) for x in tokens[1:8]]
        return int(tokens[0]), pose[:4], pose[4:], int(tokens[8]), " ".join(tokens[9:])
    except ValueError:
        return None


def _seen(tokens: list[str]) -> int:
    """Observations of an image's second line that have a point."""
    return sum(1 for x in tokens[2::3] if x.lstrip("-").isdigit() and int(x) >= 0)


def _pieces(batches: Iterator[pa.RecordBatch]):
    """(file, block, lines) of stretches of lines of one block."""
    for batch in batches:
        rows = zip(*[c.to_pylist() for c in batch.columns])
        for key, group in groupby(rows, key=lambda r: r[:2]):
            yield *key, [r[2] for r in group]


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block: observations of its first line, first lines at its end, one after the other, and whether all are first lines."""
    names = ["file", "block", "first", "run", "whole"]
    for (file, block), pieces in groupby(_pieces(batches), key=lambda p: p[:2]):
        first, run, whole = None, 0, True
        for _, _, lines in pieces:
            first = _seen(lines[0].split()) if first is None else first
            n = sum(1 for _ in takewhile(lambda x: _head(x.split()), reversed(lines)))
            run, whole = (run + n, whole) if n == len(lines) else (n, False)
        yield pa.RecordBatch.from_pydict(dict(zip(names, [[file], [block], [first], pa.array([run], pa.int64()), [whole]])))


_IMAGE = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("image_id", pa.int64()), ("q", pa.list_(pa.float64())),
     ("t", pa.list_(pa.float64())), ("camera_id", pa.int64()), ("name", pa.string()), ("seen", pa.int64())]
)
IMAGE_LINES = "file string, block bigint, place bigint, image_id bigint, q array<double>, t array<double>, camera_id bigint, name string, seen bigint"


def _block_images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The images of each block.

    A line that is no first line ends an image or none, so behind it first
    lines are images and second lines by turns.  ``place`` counts the block's
    lines up to there, whose turn the blocks before decide; null behind it.
    ``seen`` is null if the second line is in the next block.
    """
    def rows():
        for (file, block), pieces in groupby(_pieces(batches), key=lambda p: p[:2]):
            run, open_, held = 0, True, None
            for line in chain.from_iterable(lines for _, _, lines in pieces):
                tokens = line.split()
                if held is not None:
                    yield *held, _seen(tokens)
                    held = None
                head = _head(tokens)
                if head is None:
                    run, open_ = 0, False
                    continue
                if open_ or run % 2 == 0:
                    held = (file, block, run if open_ else None, *head)
                run += 1
            if held is not None:
                yield *held, None

    out = rows()
    while part := list(islice(out, IMAGE_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _IMAGE)], schema=_IMAGE)


def images(lines: DataFrame) -> DataFrame:
    """Images of two lines each: pose and name, then triples of which those with a point count.

    Blank lines are gone before the pairing, so an image without observations
    takes the next line as its own.  A first line that does not parse is one
    line; reading goes on with the next.  Blocks of a file are read apart, a
    batch of lines at a time: what one needs of the others is a row for each.
    """
    ends = lines.mapInArrow(_block_ends, "file string, block bigint, first bigint, run bigint, whole boolean")
    order = Window.partitionBy("file").orderBy("block")
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, 1)
    # first lines one after the other up to a block: all since the last block that has another line
    ends = ends.withColumn("all", F.coalesce(F.sum(F.when(F.col("whole"), F.col("run"))).over(order), F.lit(0).cast("long")))
    since = F.coalesce(F.last(F.when(~F.col("whole"), F.col("run") - F.col("all")), ignorenulls=True).over(before), F.lit(0).cast("long"))
    ends = ends.select("file", "block", (F.coalesce(F.last("all").over(before), F.lit(0).cast("long")) + since).alias("_in"), F.first("first").over(behind).alias("_next"))
    found = lines.mapInArrow(_block_images, IMAGE_LINES).join(ends, ["file", "block"])
    return found.filter("place is null or (place + _in) % 2 = 0").select(
        "image_id", "q", "t", "camera_id", "name", F.coalesce("seen", "_next", F.lit(0).cast("long")).alias("observed_point_count"),
        F.lit(True).alias("registered"),
    )


def frame_links(frame_rows: DataFrame) -> DataFrame:
    """image_id -> frame_id through camera data, whatever the case of the type; the last row of an image counts."""
    each = frame_rows.select("frame_id", F.posexplode("data").alias("pos", "d"))
    each = each.filter(F.lower("d.sensor_type") == "camera")
    return each.groupBy(F.col("d.data_id").alias("image_id")).agg(F.max_by("frame_id", F.struct("frame_id", "pos")).alias("frame_id"))


def read_model(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], list[str]]:
    """The model's tables, and the names of the files that are missing."""
    found, missing = {}, []
    for name, reader, lines in (
        ("cameras", cameras, token_lines), ("images", images, data_lines), ("points3D", points, token_lines), ("frames", frames, token_lines),
    ):
        path = f"{folder}/{name}.txt"
        if _path_exists(spark, path):
            found[name] = reader(lines(spark, path))
        else:
            missing.append(name)
    if "images" in found and "frames" in found:
        found["images"] = found["images"].join(frame_links(found["frames"]), "image_id", "left")
    return found, missing


def require_model(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """As :func:`read_model`, but a missing core file is an error."""
    found, missing = read_model(spark, folder)
    if core := [m for m in missing if m != "frames"]:
        raise FileNotFoundError(f"{folder}: {', '.join(core)}")
    return found


def pair_counts(lines: DataFrame) -> DataFrame:
    """One row: pairs (two tokens at least) and malformed lines."""
    ok = F.size("tokens") >= 2
    return lines.agg(F.count_if(ok).alias("pairs"), F.count_if(~ok).alias("malformed"))


def colour_cube_status(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row for each cube (one without ``by``): size, rows, and whether a colour cube is whole: one size of 2 .. 256, size cubed rows of three finite numbers."""
    key = F.upper(F.get("tokens", F.lit(0)))
    size = F.when(key == "LUT_3D_SIZE", _at(1, "int"))
    numeric = _at(0, "double").isNotNull()
    good = numeric & (F.size("tokens") == 3) & is_finite(_at(0, "double")) & is_finite(_at(1, "double")) & is_finite(_at(2, "double"))
    out = lines.groupBy(*(by or [])).agg(
        F.count(size).alias("sizes"), F.max(size).alias("size"), F.count_if(numeric).alias("rows"), F.count_if(numeric & ~good).alias("bad_rows")
    )
    n = F.col("size").cast("bigint")
    ok = (F.col("sizes") == 1) & F.col("size").between(2, 256) & (F.col("bad_rows") == 0) & (F.col("rows") == n * n * n)
    return out.withColumn("valid", F.coalesce(ok, F.lit(False)))
