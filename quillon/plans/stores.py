"""Queries that write files or tables and read them back: scans, listings, sinks, checked writes, and the rules around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import strings as S
from quillon.operators import gates, raster, relational
from quillon.plans.base import EV, query, r6
from quillon.sources import files, text_model
from quillon.storage import scratch_path
from quillon.streaming import events as streams


def put_files(spark, root: str, names: list[str]) -> str:
    """Small files named as given, each holding its own name."""
    conf = spark._jsc.hadoopConfiguration()
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(conf).create(path)
        out.write(bytearray(name.encode()))
        out.close()
    return root


# ------------------------------------------------------------------- sources


@query(
    "model_text_scan",
    "S1 S3 S5 S6",
    """with f as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as r from orders),
    n as (select l_orderkey, count_if(l_linenumber % 2 = 1) as seen from lineitem group by 1)
    select f.o_orderkey as image_id, 'lens0/my frame ' || f.o_orderkey || '.jpg' as name, coalesce(n.seen, 0) as observed, case when r <= 2 then o_custkey end as frame_id
    from f left join n on n.l_orderkey = f.o_orderkey""",
)
def model_text_scan(t):
    folder = scratch_path(t.spark, "model")
    # two lines for each image, the second one of triples; comments, blank lines and a line that does not parse between them
    seen = t.lineitem.groupBy("l_orderkey").agg(
        F.array_join(F.collect_list(F.concat(F.lit("1.5 2.5 "), F.when(F.col("l_linenumber") % 2 == 1, F.col("l_linenumber")).otherwise(-1))), " ").alias("second")
    )
    o = t.orders.select("o_orderkey", "o_custkey").join(seen, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    first = F.concat(F.col("o_orderkey"), F.lit("  1 0 0 0 0.5 0.25 0.125 7 lens0/my   frame "), F.col("o_orderkey"), F.lit(".jpg"))
    stray = F.when(F.col("o_orderkey") % 50 == 0, "# comment\n\n").when(F.col("o_orderkey") % 97 == 0, "not a pose\n").otherwise("")
    o.select(F.concat(stray, first, F.lit("\n"), F.coalesce("second", F.lit("0 0 -1")))).write.text(f"{folder}/images.txt")
    rank = F.slice(F.array_sort(F.collect_list("o_orderkey")), 1, 2)
    frames = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("all"), rank.alias("linked"))
    triples = F.array_join(F.transform("all", lambda i: F.concat(F.lit("CAMERA 1 "), i)), " ")
    # fewer triples are declared than follow
    frames.select(F.concat_ws(" ", "o_custkey", F.lit("1 1 0 0 0 0 0 0"), F.size("linked"), triples)).write.text(f"{folder}/frames.txt")
    t.spark.range(1).select(F.lit("1 PINHOLE 10 10 1 1")).write.text(f"{folder}/cameras.txt")
    t.spark.range(1).select(F.lit("1 0 0 0 1 2 3 0.5 1 0")).write.text(f"{folder}/points3D.txt")
    model = text_model.require_model(t.spark, folder)
    return model["images"].select("image_id", "name", F.col("observed_point_count").alias("observed"), "frame_id")


@query(
    "pair_lines",
    "S7 S1",
    "select count_if(p_partkey % 9 <> 0) as pairs, count_if(p_partkey % 9 = 0) as malformed from part",
)
def pair_lines(t):
    path = scratch_path(t.spark, "pairs")
    line = F.when(F.col("p_partkey") % 9 == 0, "alone").otherwise(F.concat_ws("  ", F.lit(" a.jpg"), "p_partkey"))
    t.part.select(F.concat(line, F.when(F.col("p_partkey") % 5 == 0, "\n\n# note").otherwise(""))).write.text(path)
    return text_model.pair_counts(text_model.token_lines(t.spark, path))


@query(
    "json_document_scan",
    "S8",
    "select n_nationkey as id, n_name as name, n_regionkey * 0.5 as half from nation",
)
def json_document_scan(t):
    path = scratch_path(t.spark, "documents")
    doc = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") * 0.5).alias("half"), F.lit("x").alias("unknown"))
    t.nation.select(doc.alias("d")).select("d.*").write.option("maxRecordsPerFile", 1).json(path)
    return files.json_documents(t.spark, path, "id bigint, name string, half double")


@query(
    "media_probe",
    "S21 STR12",
    """select s_suppkey, 1920 as width, 960 as height, round((s_suppkey % 3 + 29) * 1000 / 1001.0, 6) as fps, round(s_acctbal * 1000, 3) as duration_ms from supplier""",
)
def media_probe(t):
    doc = F.concat(
        F.lit('{"streams":[{"codec_type":"audio"},{"codec_type":"video","width":1920,"height":960,"r_frame_rate":"'),
        (F.col("s_suppkey") % 3 + 29) * 1000, F.lit('/1001"}],"format":{"duration":"'), F.col("s_acctbal").cast("string"), F.lit('"}}'),
    )
    out = files.probed(t.supplier.select("s_suppkey", doc.alias("doc")), "doc")
    return out.select("s_suppkey", "width", "height", r6("fps").alias("fps"), F.round("duration_ms", 3).alias("duration_ms"))


@query(
    "telemetry_cache",
    "S9",
    f"""with {EV} select event_id, k % 4 <> 0 and k % 5 <> 0 and k % 7 <> 0 as valid from ev""",
)
def telemetry_cache(t):
    k, one = F.col("k"), F.lit(1).cast("long")
    rows = t.ev.select(
        "event_id", F.when(k % 4 == 0, 2).otherwise(3).alias("schema_version"), F.lit("r1").alias("parser_revision"), one.alias("source_size"),
        F.when(k % 5 == 0, 2).otherwise(1).alias("size"), one.alias("source_modified"), one.alias("modified"),
        F.when(k % 7 == 0, 0).otherwise(5).alias("gyro_samples"), F.lit(0).alias("accel_samples"), F.lit(None).cast("int").alias("attitude_samples"),
    )
    return rows.select("event_id", files.still_valid(rows, 3, "r1").alias("valid"))


@query(
    "first_curve",
    "S13",
    f"""with {EV} select user_id, min(event_id) filter (k > 50) as event_id from ev group by 1""",
)
def first_curve(t):
    curve = F.when(F.col("k") > 50, F.struct("event_id", "value"))
    found = t.ev.groupBy("user_id").agg(F.min_by(curve, F.when(curve.isNotNull(), F.col("event_id"))).alias("c"))
    return found.select("user_id", F.col("c.event_id").alias("event_id"))


@query(
    "directory_scan",
    "S14 S15 S16",
    """with f as (select n_nationkey as k, 'lens' || (n_nationkey % 2) || '/f_' || lpad(n_nationkey::varchar, 4, '0') as stem from nation),
    n as (select k, stem || '.JPG' as name, stem from f union all select k, stem || '.png', stem from f where k % 5 = 0)
    select name, k::bigint as sequence, stem || '.png' as mask, k % 5 = 0 as conflict, row_number() over (order by lower(name)) as place from n""",
)
def directory_scan(t):
    names = []
    for r in t.nation.select("n_nationkey").collect():  # 25 rows: the table of nations is fixed
        stem = f"lens{r[0] % 2}/f_{r[0]:04d}"
        names += [f"{stem}.JPG", f"note_{r[0]}.txt"] + ([f"{stem}.png"] if r[0] % 5 == 0 else [])
    root = put_files(t.spark, scratch_path(t.spark, "frames"), names)
    out = files.ranked(files.mask_targets(files.listing(t.spark, root)), "sort_key")
    return out.select("name", "sequence", "mask", "conflict", "place")


@query(
    "source_folder",
    "S17 S18",
    """select 'source' as kind, 'clip_' || r_regionkey || '.MP4' as name from region union all select 'chosen', 'below/odd.xyz'
       union all select 'metadata', 'meta/' || r_regionkey || '.json' from region""",
)
def source_folder(t):
    keys = [r[0] for r in t.region.select("r_regionkey").collect()]  # five rows
    names = [f"clip_{k}.MP4" for k in keys] + [f"note_{k}.txt" for k in keys] + [f"meta/{k}.json" for k in keys] + ["below/deep.mp4", "below/odd.xyz"]
    root = put_files(t.spark, scratch_path(t.spark, "sources"), names)
    every, top = files.listing(t.spark, root), files.listing(t.spark, root, recursive=False)
    chosen = every.filter("name = 'below/odd.xyz'")
    parts = [
        files.sources(top).select(F.lit("source").alias("kind"), "name"),
        chosen.select(F.lit("chosen").alias("kind"), "name"),
        files.listing(t.spark, root, glob="*.json").select(F.lit("metadata").alias("kind"), "name"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "model_directories",
    "S19",
    """select r_regionkey, case r_regionkey % 4 when 0 then 'sparse/0' when 1 then 'sparse/1' when 2 then 'sparse' end as folder from region""",
)
def model_directories(t):
    key = F.col("r_regionkey") % 4
    held = (
        F.when(key == 0, F.array(F.lit("sparse/2/cameras.txt"), F.lit("sparse/0/cameras.txt")))
        .when(key == 1, F.array(F.lit("sparse/7/images.txt"), F.lit("sparse/1/images.txt")))
        .when(key == 2, F.array(F.lit("sparse/cameras.txt"))).otherwise(F.array(F.lit("other/cameras.txt")))
    )
    return files.model_folders(t.region.select("r_regionkey", F.explode(held).alias("name")), ["r_regionkey"])


@query(
    "colour_cubes",
    "S25",
    "select r_regionkey, case when r_regionkey % 2 = 0 then 8 else 7 end as n_rows, r_regionkey % 2 = 0 as valid from region",
)
def colour_cubes(t):
    # a cube in a row: its status is that of its lines
    n = F.when(F.col("r_regionkey") % 2 == 0, 8).otherwise(7)
    lines = F.concat(F.array(F.array(F.lit("LUT_3D_SIZE"), F.lit("2"))), F.array_repeat(F.array(F.lit("0"), F.lit("0.5"), F.lit("1")), n))
    rows = t.region.select("r_regionkey", F.explode(lines).alias("tokens"))
    return text_model.colour_cube_status(rows, ["r_regionkey"]).select("r_regionkey", F.col("rows").cast("int").alias("n_rows"), "valid")


@query("sqlite_scan", "S20", "select n_nationkey, n_name, n_regionkey from nation")
def sqlite_scan(t):
    rows = [tuple(r) for r in t.nation.select("n_nationkey", "n_name", "n_regionkey").collect()]  # 25 rows
    path = files.sqlite_file(t.spark, "nation", "n_nationkey integer, n_name text, n_regionkey integer", rows)
    return files.sqlite_table(t.spark, path, "nation", "n_nationkey bigint, n_name string, n_regionkey bigint", parts=3).select(
        F.col("n_nationkey").cast(t.nation.schema["n_nationkey"].dataType), "n_name", F.col("n_regionkey").cast(t.nation.schema["n_regionkey"].dataType)
    )


# --------------------------------------------------------------------- sinks


@query(
    "published_report",
    "K1 K2 K3 K7 K13",
    "select o_orderpriority as variant, count(*) as selected, cast(count_if(o_orderstatus = 'F') as bigint) as complete from orders group by 1",
)
def published_report(t):
    path = scratch_path(t.spark, "report")
    counts = t.orders.groupBy(F.col("o_orderpriority").alias("variant")).agg(
        F.count(F.lit(1)).alias("selected"), F.count_if(F.col("o_orderstatus") == "F").alias("complete")
    )
    files.write_document(counts.limit(1), path)  # an older report, replaced as a whole
    files.write_document(counts, path)
    return files.json_documents(t.spark, path, "variant string, selected bigint, complete bigint", lines=True)


@query(
    "paired_commit",
    "K4",
    """select 'a' as side, count(*) as n from region union all select 'b', count(*) from nation""",
)
def paired_commit(t):
    a, b = scratch_path(t.spark, "pair-a"), scratch_path(t.spark, "pair-b")
    files.write_pair((t.nation, a), (t.region, b))
    broken = t.nation.withColumn("n_name", F.raise_error(F.lit("no")).cast("string"))
    try:
        files.write_pair((t.region, a), (broken, b))
    except Exception:  # whatever the engine raises: both must still be the old ones
        pass
    assert t.spark.read.parquet(a).count() == t.nation.count() and t.spark.read.parquet(b).count() == t.region.count()
    files.write_pair((t.region, a), (t.nation, b))
    each = [t.spark.read.parquet(p).agg(F.lit(s).alias("side"), F.count(F.lit(1)).alias("n")) for s, p in (("a", a), ("b", b))]
    return each[0].unionByName(each[1])


@query(
    "artifact_list",
    "K10 STR11",
    """with n as (select 'raw/' || r_name || '.bin' as name from region) select name, cast(length(name) as bigint) as length, sha256(name) as sha256 from n""",
)
def artifact_list(t):
    names = [f"raw/{r[0]}.bin" for r in t.region.select("r_name").collect()]  # five rows
    root = put_files(t.spark, scratch_path(t.spark, "artifacts"), names)
    return files.artifact_manifest(t.spark, root).select("name", "length", "sha256")


@query(
    "event_log_stream",
    "K9 STR14",
    """select conv_id, turn, 'wrote /home/<user>' as said from conversations""",
)
def event_log_stream(t):
    start = scratch_path(t.spark, "events")
    rows = t.conversations.select("conv_id", "turn", F.concat(F.lit("wrote /home/ann/"), "conv_id", F.lit(".log")).alias("said"))
    rows.write.parquet(f"{start}/in")
    stream = t.spark.readStream.schema(rows.schema).parquet(f"{start}/in").withColumn("said", S.redact("said"))
    files.event_log(stream, f"{start}/log", f"{start}/state").awaitTermination()
    return t.spark.read.schema(rows.schema).json(f"{start}/log")


# ------------------------------------------------------- schemas and writes


@query(
    "schema_assertion",
    "D1",
    "select * from (values ('missing cameras'), ('type of n_name')) v(issue)",
)
def schema_assertion(t):
    kind = t.nation.schema["n_nationkey"].dataType
    expected = T.StructType([T.StructField("n_nationkey", kind), T.StructField("n_name", T.LongType()), T.StructField("cameras", T.StringType())])
    found = relational.schema_issues(t.nation, expected)
    return t.spark.createDataFrame([(i,) for i in found], "issue string")


@query(
    "atomic_rewrite",
    "D4 D6 D7",
    """select 'matches' as name, 0::bigint as n_rows, false as refused union all select 'geometry', 0, false union all select 'orders', count(*), true from orders""",
)
def atomic_rewrite(t):
    """Two derived tables are emptied, schemas kept; a write whose check fails leaves what was there."""
    spark, paths = t.spark, {n: scratch_path(t.spark, n) for n in ("matches", "geometry", "orders")}
    t.nation.write.parquet(paths["matches"])
    t.region.write.parquet(paths["geometry"])
    for name, empty in zip(("matches", "geometry"), relational.emptied(t.nation, t.region)):
        relational.write_checked(empty, paths[name], [])
    keys = t.orders.select("o_orderkey", "o_custkey")
    relational.write_checked(keys, paths["orders"], [("negative key", keys.filter("o_orderkey < 0"))])
    try:
        relational.write_checked(keys.limit(0), paths["orders"], [("every key", keys)])
        refused = False
    except ValueError:
        refused = True
    each = [
        spark.read.schema(df.schema).parquet(paths[n]).agg(
            F.lit(n).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.lit(refused and n == "orders").alias("refused")
        )
        for n, df in (("matches", t.nation), ("geometry", t.region), ("orders", keys))
    ]
    return reduce(lambda a, b: a.unionByName(b), each)


@query(
    "injection_marker",
    "D8 K13",
    """select count_if(c_acctbal > 0) as gravity_rows, count_if(c_custkey % 3 = 0) as focal_rows, count_if(c_acctbal > 0) > 0 and count_if(c_custkey % 3 = 0) > 0 as complete from customer""",
)
def injection_marker(t):
    gravity = t.customer.filter("c_acctbal > 0").agg(F.count(F.lit(1)).alias("gravity_rows"))
    focal = t.customer.filter("c_custkey % 3 = 0").agg(F.count(F.lit(1)).alias("focal_rows"))
    path = scratch_path(t.spark, "marker")
    files.write_document(relational.marker(gravity, focal), path)
    return files.json_documents(t.spark, path, "gravity_rows bigint, focal_rows bigint, complete boolean")


@query(
    "project_lifecycle",
    "D9",
    f"""with {EV} select user_id, min(event_id) as created, max(event_id) as updated, arg_max(event_type, event_id) as status, count(*) as revisions from ev group by 1""",
)
def project_lifecycle(t):
    return relational.project_state(t.ev, ["user_id"], "event_id", "event_type")


@query(
    "fingerprint_reuse",
    "D10 STR11",
    """with f as (select n_regionkey, sha256('v1|' || string_agg(n_nationkey || ':' || n_name, ',' order by n_nationkey)) as fingerprint from nation group by 1)
    select n_regionkey, fingerprint, n_regionkey <> 1 as reused from f""",
)
def fingerprint_reuse(t):
    part = F.concat_ws(":", "n_nationkey", "n_name")
    now = relational.fingerprints(t.nation, ["n_regionkey"], "n_nationkey", part, "v1")
    changed = F.when(F.col("n_regionkey") == 1, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name"))
    before = relational.fingerprints(t.nation, ["n_regionkey"], "n_nationkey", F.concat_ws(":", "n_nationkey", changed), "v1")
    return relational.reusable(now, before, ["n_regionkey"])


# --------------------------------------------------------------------- gates


@query(
    "fixed_rotation",
    "P13 P14",
    f"""with {EV} select event_id, array_to_string(list_filter([case when k % 2 = 0 then 'rig' end, case when k % 3 = 0 then 'gravity coverage' end], lambda x: x is not null), '+') as native_issues,
      case when k % 2 = 0 then case when k % 5 = 0 then 'rig+backend' else 'rig' end else case when k % 5 = 0 then 'backend' else '' end end as external_issues from ev""",
)
def fixed_rotation(t):
    k, yes = F.col("k"), F.lit(True)
    capability = F.concat(
        F.lit('{"protocol":"p1","manifestFormat":"m1","executableVersion":"2","backend":"'), F.when(k % 5 == 0, "COLMAP").otherwise("own"),
        F.lit('","supportsOrientationPriors":true,"supportsWxyzHamilton":true,"supportsRigFrames":true,"supportsFixedRotation":true}'),
    )
    common = {"mapper": yes, "option": yes, "rig": k % 2 != 0, "focal": yes}
    native = gates.fixed_rotation_issues(common, gravity=yes, coverage=F.when(k % 3 == 0, 0.5).otherwise(0.9))
    external = gates.fixed_rotation_issues(common, manifest=yes, handshake=gates.capability_issue(capability, "p1", "m1", ("stock_colmap", "colmap")))
    return t.ev.select("event_id", F.array_join(native, "+").alias("native_issues"), F.array_join(external, "+").alias("external_issues"))


@query(
    "detection_decode",
    "P19 P20",
    f"""with {EV}, d as (select event_id, value / 100.0 as a, k / 100.0 as c, k as w from ev)
    select event_id, case when a >= c then 0 else 2 end as class_id, round(greatest(a, c), 6) as score from d where greatest(a, c) >= 0.4 and w > 0""",
)
def detection_decode(t):
    # three classes, of which the second is not asked for, however high it scores
    scores = F.array(F.col("value") / 100.0, F.lit(9.0), F.col("k") / 100.0)
    rows = t.ev.select("event_id", F.array(F.lit(5.0), F.lit(5.0), F.col("k").cast("double"), F.lit(4.0)).alias("box"), scores.alias("scores"))
    out = raster.decode_detections(rows, ["person", "car", "dog"], [" Person", "DOG ", ""], 0.4)
    none = raster.decode_detections(rows, ["person", "car", "dog"], ["", "cat"], 0.4)
    return out.unionByName(none).select("event_id", "class_id", r6("score").alias("score"))


@query(
    "selected_outputs",
    "P2",
    """select l_orderkey, count(*) as selected, min('a_' || l_linenumber || '.jpg') as first_left, max('b_' || l_linenumber || '.jpg') as last_right from lineitem where l_linestatus = 'O' group by 1""",
)
def selected_outputs(t):
    path = lambda side: F.concat(F.lit(f"out\\{side}/{side}_"), "l_linenumber", F.lit(".jpg"))
    rows = t.lineitem.select("l_orderkey", (F.col("l_linestatus") == "O").alias("selected"), path("a").alias("left"), path("b").alias("right"))
    out = relational.selected(rows, ["left", "right"])
    return out.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("selected"), F.min("left").alias("first_left"), F.max("right").alias("last_right"))


@query(
    "filter_values",
    "STR17",
    """select p_partkey, 'C\\:\\\\lut\\' || chr(39) || 's ' || p_partkey || '.cube' as escaped from part""",
)
def filter_values(t):
    return t.part.select("p_partkey", S.filter_value(F.concat(F.lit("C:\\lut's "), "p_partkey", F.lit(".cube"))).alias("escaped"))


# ------------------------------------------------------------------- rasters


def _bytes(vector: str = "embedding"):
    byte = F.transform(vector, lambda x: F.lpad(F.hex(F.floor(F.least(F.greatest((x + 1) * 127, F.lit(0.0)), F.lit(255.0))).cast("long")), 2, "0"))
    return F.unhex(F.concat_ws("", byte))


_BYTES = "list_transform(embedding, lambda x: floor(least(greatest((x::double + 1) * 127, 0.0), 255.0)))"


@query(
    "sky_masks",
    "I9",
    f"""with b as (select vec_id, {_BYTES} as v from embeddings), r as (select vec_id, v, list_min(v) as lo, list_max(v) as hi from b)
    select vec_id, case when hi > lo then len(list_filter(v, lambda x: (x - lo) / (hi - lo) >= 0.5)) else 0 end::double as sky from r""",
)
def sky_masks(t):
    frames = t.embeddings.select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), _bytes().alias("data"))
    return raster.map_frames(frames, _sky_pixels, "sky", "double").select("vec_id", "sky")


def _sky_pixels(x) -> float:
    return float(raster.sky_mask(x.astype(float)).sum())


@query(
    "detection_masks",
    "I8",
    f"""with b as (select vec_id, {_BYTES} as v from embeddings)
    select vec_id, len(list_filter(range(64), lambda i: (i // 8) between 1 and 4 and (i % 8) between 2 and 5 and v[i + 1] > 127))::double as pixels from b""",
)
def detection_masks(t):
    frames = t.embeddings.select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), _bytes().alias("data"))
    return raster.map_frames(frames, _boxed_pixels, "pixels", "double").select("vec_id", "pixels")


def _boxed_pixels(x) -> float:
    import numpy as np

    return float(raster.boxes_to_mask(x[None].astype(float) - 127, np.array([[1.0]]), np.array([[2.0, 1.0, 6.0, 5.0]])).sum())


@query(
    "letterbox_sums",
    "I10 Q19",
    f"""with b as (select vec_id, {_BYTES} as v from embeddings) select vec_id, round(3 * (list_sum(v[1:32]) + 32 * 114) / 255.0, 4) as total from b""",
)
def letterbox_sums(t):
    frames = t.embeddings.select("vec_id", F.lit(8).alias("width"), F.lit(4).alias("height"), F.substring(_bytes(), 1, 32).alias("data"))
    return raster.map_frames(frames, _letterboxed, "total", "double").select("vec_id", F.round("total", 4).alias("total"))


def _letterboxed(x) -> float:
    return float(raster.letterbox_planes(x[:, :, None].repeat(3, axis=2), 8).sum(dtype=float))


@query(
    "keep_masks",
    "I7 P22",
    f"""with b as (select vec_id, {_BYTES} as v from embeddings)
    select vec_id, len(list_filter(range(64), lambda i: power(i % 8 + 0.5 - 4, 2) + power(i // 8 + 0.5 - 4, 2) > power(0.49 * 8, 2) or v[i + 1] > 127))::double as left_out from b""",
)
def keep_masks(t):
    frames = t.embeddings.select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), _bytes().alias("data"))
    return raster.map_frames(frames, _left_out, "left_out", "double").select("vec_id", "left_out")


def _left_out(x) -> float:
    return float((raster.keep_mask(raster.valid_region(8, 8, 0.49), [x > 127]) == 255).sum())


@query(
    "mask_engines",
    "X1",
    f"""with b as (select vec_id, {_BYTES} as v from embeddings) select vec_id, 0.0 as idle, len(list_filter(v, lambda x: x > 127))::double as masked from b""",
)
def mask_engines(t):
    """Two engines behind one interface: one that masks nothing, one by threshold."""
    frames = t.embeddings.select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), _bytes().alias("data"))
    idle = raster.map_frames(frames, raster.no_mask, "idle", "double").select("vec_id", "idle")
    return idle.join(raster.map_frames(frames, raster.threshold_mask, "masked", "double").select("vec_id", "masked"), "vec_id")


@query(
    "proxy_sizes",
    "I3",
    """select p_partkey, case when greatest(p_size * 40, 300) <= 512 then p_size * 40 else greatest(1, cast(round(p_size * 40 * 512.0 / greatest(p_size * 40, 300)) as int)) end as width,
       case when greatest(p_size * 40, 300) <= 512 then 300 else greatest(1, cast(round(300 * 512.0 / greatest(p_size * 40, 300)) as int)) end as height from part""",
)
def proxy_sizes(t):
    w, h = raster.limited_size(F.col("p_size") * 40, F.lit(300))
    return t.part.select("p_partkey", w.alias("width"), h.alias("height"))


# ------------------------------------------------------------------- streams


@query(
    "bound_logs",
    "ST4",
    """select e.event_id, s.event_id as task from events e join events s on e.user_id = s.user_id and s.event_type = 'signup'
       and e.ts >= s.ts - interval 1 day and e.ts <= s.ts + interval 1 day where e.event_type = 'view'""",
)
def bound_logs(t):
    logs = t.events.filter("event_type = 'view'").select("user_id", "event_id", "ts")
    starts = t.events.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("task"), "ts")
    return streams.bind_logs(logs, starts, "user_id", "ts", "1 day", "2 days").select("event_id", "task")
