"""Queries on names, markers, documents and tool output."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import documents as D
from quillon.functions import numeric as N
from quillon.functions import strings as S
from quillon.operators import colour
from quillon.plans.base import EV, r6, query
from quillon.sources import files, text_model


@query(
    "name_rules",
    "STR1 STR2 STR3 STR4 STR15 STR16",
    """with f as (select p_partkey, replace(p_name, ' ', '/') || '_' || case when p_partkey % 5 = 0 then 'x' else lpad(p_partkey::varchar, 8, '0') end as stem,
        case p_partkey % 4 when 0 then '.JPG' when 1 then '.png' when 2 then '.txt' else '.webp' end as ext from part)
    select p_partkey, string_split(stem, '/')[-1] || ext as base, case when p_partkey % 5 <> 0 then p_partkey end as seq, ext <> '.txt' as is_image, ext in ('.JPG', '.png') as is_stored,
        stem || '.png' as mask, 'out_' || lpad((p_partkey % 1000)::varchar, 8, '0') || '.jpg' as output from f""",
)
def name_rules(t):
    p = F.col("p_partkey")
    stem = F.concat(F.replace("p_name", F.lit(" "), F.lit("\\")), F.lit("_"), F.when(p % 5 == 0, "x").otherwise(F.format_string("%08d", p)))
    ext = F.when(p % 4 == 0, ".JPG").when(p % 4 == 1, ".png").when(p % 4 == 2, ".txt").otherwise(".webp")
    f = t.part.select("p_partkey", F.concat(stem, ext).alias("path"))
    return f.select(
        "p_partkey", S.base_name("path").alias("base"), S.trailing_number(S.stem("path")).alias("seq"), S.has_extension("path").alias("is_image"),
        S.has_extension("path", S.STORED_EXTENSIONS).alias("is_stored"), S.mask_path("path").alias("mask"),
        S.output_name(F.lit("out_"), p % 1000, F.lit("jpg")).alias("output"),
    )


@query(
    "url_rules",
    "STR5 STR14 STR9 STR11",
    """with u as (select page_id, url from pages)
    select page_id, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') as marker, substr(sha256(url), 1, 24) as token,
      'at ' || case when page_id % 3 = 0 then '/Users/<user>' when page_id % 3 = 1 then '/home/<user>' else '<path>' end as redacted from u""",
)
def url_rules(t):
    i = F.col("page_id")
    place = F.when(i % 3 == 0, "/Users/ann/").when(i % 3 == 1, "/home/bo/").otherwise("/srv/x y/")
    said = F.concat(F.lit("at "), place, i.cast("string"))
    return t.pages.select("page_id", S.marker_key("url").alias("marker"), S.fingerprint("url", 24).alias("token"), S.redact(said).alias("redacted"))


@query(
    "safe_names",
    "STR9 STR20",
    """with n as (select p_partkey, p_name, p_brand from part)
    select p_partkey, case when p_partkey % 9 = 0 then 'con-project' else replace(p_name, ' ', '-') || '-' || replace(p_brand, '#', '-') end as folder,
      case when p_partkey = 0 then 'Less than 1 second' when p_partkey >= 3600 then (p_partkey // 3600) || ' hr ' || lpad(((p_partkey // 60) % 60)::varchar, 2, '0') || ' min'
           when p_partkey >= 60 then (p_partkey // 60) || ' min ' || lpad((p_partkey % 60)::varchar, 2, '0') || ' sec' else p_partkey || ' sec' end as took from n""",
)
def safe_names(t):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit(":?")), F.lit("<>"), F.replace("p_brand", F.lit("#"), F.lit("|")), F.lit(" . "))
    name = F.when(F.col("p_partkey") % 9 == 0, " con.").otherwise(name)
    return t.part.select("p_partkey", S.safe_directory_name(name).alias("folder"), S.duration_text(F.col("p_partkey") * 1000).alias("took"))


@query(
    "status_rules",
    "STR13 P27",
    """with s as (select o_orderkey, case o_orderkey % 6 when 0 then 'Stage RUNNING' when 1 then 'complete!' when 2 then 'paused' when 3 then 'Fatal Error' when 4 then null else 'queued' end as x,
        case o_orderkey % 4 when 0 then 'Feature extraction' when 1 then 'segmenting' when 2 then 'Global mapper' else 'x' end as y from orders)
    select o_orderkey, case o_orderkey % 6 when 0 then 'running' when 1 then 'completed' when 2 then 'cancelled' when 3 then 'failed' else 'pending' end as status,
      case when o_orderkey % 6 = 3 then 'error' else 'info' end as level, case o_orderkey % 4 when 0 then 'extract' when 1 then 'mask' when 2 then 'align' end as stage from s""",
)
def status_rules(t):
    k = F.col("o_orderkey")
    x = F.when(k % 6 == 0, "Stage RUNNING").when(k % 6 == 1, "complete!").when(k % 6 == 2, "paused").when(k % 6 == 3, "Fatal Error").when(k % 6 == 5, "queued")
    y = F.when(k % 4 == 0, "Feature extraction").when(k % 4 == 1, "segmenting").when(k % 4 == 2, "Global mapper").otherwise("x")
    return t.orders.select("o_orderkey", S.status_of(x).alias("status"), S.level_of(x).alias("level"), S.stage_of(y).alias("stage"))


@query(
    "time_coercion",
    "STR10 STR12 P3",
    """with o as (select o_orderkey, o_orderdate, cast(epoch_us(o_orderdate) // 1000 as bigint) as ms from orders)
    select o_orderkey, ms as from_iso, ms as from_seconds, ms as from_ms, round((o_orderkey + 1) * 1000 / 1001.0, 6) as rate from o""",
)
def time_coercion(t):
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz))")
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return t.orders.select(
        "o_orderkey", S.epoch_ms(iso).alias("from_iso"), S.epoch_ms((ms / F.lit(1000)).cast("string")).alias("from_seconds"),
        S.epoch_ms(ms).alias("from_ms"), r6(N.fraction(F.concat((F.col("o_orderkey") + 1) * 1000, F.lit("/1001")))).alias("rate"),
    )


@query(
    "versions",
    "P28 STR18",
    """with v as (select p_partkey, p_partkey % 6 as a, p_size % 7 as b, p_partkey % 3 as c from part)
    select p_partkey, (a, b, c) >= (4, 1, 1) as recent, true as strict, false as loose from v""",
)
def versions(t):
    a, b, c = F.col("p_partkey") % 6, F.col("p_size") % 7, F.col("p_partkey") % 3
    v = F.concat_ws(".", a, b, c)
    return t.part.select(
        "p_partkey", S.version_at_least(F.concat(F.lit("tool "), v, F.lit(" (cuda)")), (4, 1, 1)).alias("recent"), S.is_version(v).alias("strict"),
        S.is_version(F.concat(F.lit("v"), v)).alias("loose"),
    )


@query(
    "brand_and_model",
    "STR7 STR8 X6 Q24",
    """with s as (select s_suppkey, case s_suppkey % 4 when 0 then 'insta360' when 1 then 'DJI' when 2 then 'GoPro' else 'unknown' end as kind,
        case s_suppkey % 5 when 0 then 'unknown' when 1 then 'DJI Osmo 360' else 'One-' || s_nationkey end as model from supplier),
    b as (select s_suppkey, model, case when kind = 'insta360' then 'Insta360' when kind = 'DJI' or model like 'DJI%' then 'DJI' when kind = 'GoPro' then 'GoPro' end as brand from s)
    select s_suppkey, brand, case when model = 'unknown' then null when brand = 'DJI' and model like 'DJI%' then 'Osmo 360' else model end as model from b""",
)
def brand_and_model(t):
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "insta360").when(k % 4 == 1, "DJI").when(k % 4 == 2, "GoPro").otherwise("unknown")
    model = F.when(k % 5 == 0, "unknown").when(k % 5 == 1, "DJI Osmo 360").otherwise(F.concat(F.lit("One-"), "s_nationkey"))
    brand, rest = S.brand_and_model(kind, model)
    return t.supplier.select("s_suppkey", brand.alias("brand"), rest.alias("model"))


@query(
    "colour_profiles",
    "P23 P24 A12 STR6 STR7",
    f"""with {EV}, m as (select user_id, k, event_type from ev where event_type <> 'signup'),
    c as (select user_id, count_if(event_type = 'view' and k % 40 = 0) as dlog, count_if(event_type = 'click' and k % 20 = 0) as ilog, count_if(event_type = 'purchase' and k % 20 = 0) as log,
        count_if(event_type = 'error' and k % 20 = 0) as plain, count_if(event_type = 'view' and k % 40 = 1) as rec from m group by 1)
    select user_id, case when dlog > 0 then 'dlog_m' when ilog > 0 then 'ilog' when log > 0 then 'insta_log' when plain > 0 then 'unknown' when rec > 0 then 'rec709' else 'unknown' end as profile,
        case when dlog >= 2 then 0.99 when dlog > 0 then 0.94 when ilog > 0 then 0.92 when log > 0 then 0.90 when plain > 0 then 0.90 when rec >= 2 then 0.95 when rec > 0 then 0.86 else 0.0 end as confidence from c""",
)
def colour_profiles(t):
    e, k = F.col("event_type"), F.col("k")
    key = F.when(e == "purchase", "Gamma Mode").when(e == "error", "filter").otherwise("Color-Profile")
    value = (
        F.when((e == "view") & (k % 40 == 0), "D-Log M").when((e == "click") & (k % 20 == 0), "I-Log").when((e == "purchase") & (k % 20 == 0), "LOG")
        .when((e == "error") & (k % 20 == 0), "Vivid").when((e == "view") & (k % 40 == 1), "Rec.709").otherwise("other")
    )
    rows = t.ev.filter(e != "signup").select("user_id", key.alias("key"), value.alias("value"), F.lit("a/clip.mp4").alias("path"))
    return colour.detect(rows, "user_id").select("user_id", "profile", F.col("confidence").cast("double").alias("confidence"))


@query(
    "json_pointers",
    "JS1 JS6 A17",
    f"""with {EV} select event_id, cast(k as varchar) as pointer, least(greatest(cast(k as double), 10.0), 50.0) as setting, cast(k as double) as extract_ms, cast(k * 2 as double) as align_ms from ev""",
)
def json_pointers(t):
    doc = F.concat(F.lit('{"a":{"b":['), "k", F.lit(']},"minGap":"'), "k", F.lit('","phases":{"extract":1,"align":{"durationMs":'), F.col("k") * 2, F.lit('}},"timings":[{"name":"extract","durationMs":'), "k", F.lit("}]}"))
    rows = t.ev.select("event_id", doc.alias("doc"))
    phases = D.phase_durations("doc")
    return rows.select(
        "event_id", D.pointer("doc", "/a/b/0").alias("pointer"), D.setting("doc", ["min_gap", "minGap"], 20, 10, 50).alias("setting"),
        F.element_at(phases, "extract").alias("extract_ms"), F.element_at(phases, "align").alias("align_ms"),
    )


@query(
    "json_issues",
    "JS7 P25",
    f"""with {EV} select event_id, case when k % 2 = 0 then 'fps+old' else 'old' end as codes, k % 3 = 0 as flag from ev""",
)
def json_issues(t):
    code = F.when(F.col("k") % 2 == 0, "fps").otherwise("strange")
    doc = F.concat(F.lit('{"issues":[{"code":"'), code, F.lit('"}],"warnings":["old","'), code, F.lit('"],"on":'), F.when(F.col("k") % 3 == 0, '"true"').otherwise("false"), F.lit("}"))
    rows = t.ev.select("event_id", doc.alias("doc"))
    return rows.select("event_id", F.array_join(D.issue_list("doc", ["fps", "size"]), "+").alias("codes"), D.flag("doc", ["on"], False).alias("flag"))


@query(
    "json_recursion",
    "JS2 JS3 JS4 JS5 JS8",
    f"""with {EV} select event_id, 3::bigint as scalars, '{{"a":{{"x":' || k || ',"y":"<home>/f"}},"b":[1]}}' as merged, cast(k as varchar) as found from ev""",
)
def json_recursion(t):
    base = F.concat(F.lit('{"a":{"x":'), "k", F.lit(',"y":"no"},"b":[1,null,true,2]}'))
    over = F.lit('{"a":{"y":"/home/ann/f"},"b":[1]}')
    rows = t.ev.select("event_id", base.alias("base"), D.deep_merge(base, over).alias("m"))
    redact = D.redactor([("/home/ann", "<home>")])
    return rows.select(
        "event_id", F.size(D.flatten("m")).cast("bigint").alias("scalars"), redact("m").alias("merged"), D.finder({"X", "id"})("m").alias("found")
    )


@query(
    "document_merge_policy",
    "A17 JS8",
    f"""with {EV} select event_id, cast(k as bigint) as a, cast(k + 1 as bigint) as b from ev""",
)
def document_merge_policy(t):
    first = F.create_map(F.lit("a"), F.col("k"), F.lit("b"), F.col("k"))
    second = F.create_map(F.lit("b"), F.col("k") + 1)
    rows = t.ev.select("event_id", D.merged_maps(first, second).alias("m"))
    return rows.select("event_id", F.element_at("m", "a").alias("a"), F.element_at("m", "b").alias("b"))


@query(
    "text_cameras",
    "S2",
    """select p_partkey as camera_id, 'OPENCV' as model, p_size * 10 as width, cast(2 as bigint) as n_params, p_retailprice as focal from part where p_partkey % 10 <> 0""",
)
def text_cameras(t):
    line = F.concat_ws(" ", F.when(F.col("p_partkey") % 10 == 0, "#").otherwise(F.col("p_partkey").cast("string")), F.lit("OPENCV"), F.col("p_size") * 10, F.lit("7"), F.col("p_retailprice"), F.lit("x 1.5"))
    lines = t.part.select(F.split(line, " ").alias("tokens")).filter("tokens[0] <> '#'")
    out = text_model.cameras(lines)
    return out.select("camera_id", "model", F.col("width"), F.size("params").cast("bigint").alias("n_params"), F.element_at("params", 1).alias("focal"))


@query(
    "text_points",
    "S4",
    """select l_orderkey as point3d_id, cast(count(*) as bigint) as track_length, cast(min(l_suppkey) as bigint) as first_image, 0.5 as err from lineitem group by 1""",
)
def text_points(t):
    track = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.lpad("l_suppkey", 6, "0"), "l_linenumber"))), " ").alias("track"))
    line = F.concat_ws(" ", "l_orderkey", F.lit("1 2 3 10 20 30 0.5"), "track")
    out = text_model.points(track.select(F.split(line, " ").alias("tokens")))
    return out.select("point3d_id", F.size("track").cast("bigint").alias("track_length"), F.element_at("track", 1)["image_id"].alias("first_image"), "err")


@query(
    "tool_output",
    "S22 P27",
    """select s_nationkey, count(*) as devices, bool_or(s_suppkey % 9 = 0) as has_option, 'Device ' || min(s_suppkey) as name
       from supplier group by 1""",
)
def tool_output(t):
    line = F.concat(F.col("s_suppkey"), F.lit(", Device "), F.col("s_suppkey"))
    found = files.device_lines(t.supplier.select(line.alias("value"))).join(t.supplier, F.col("index") == F.col("s_suppkey"))
    text = F.when(F.col("s_suppkey") % 9 == 0, "usage: [--use-gpu, x]").otherwise("usage: --use-gpus")
    first = F.min_by("name", "s_suppkey")
    return found.withColumn("value", text).groupBy("s_nationkey").agg(
        F.count(F.lit(1)).alias("devices"), files.has_option(found, "--use-gpu").alias("has_option"), first.alias("name")
    )


@query(
    "sample_expansion",
    "S12",
    f"""with {EV} select event_id, cast(i as bigint) as sample_index, round(ms + i / 4.0 * 1000.0, 3) as sample_ts from ev, range(4) r(i) where event_type = 'view'""",
)
def sample_expansion(t):
    rows = t.ev.filter("event_type = 'view'").select("event_id", "ms", F.lit(1000.0).alias("d"), F.array_repeat(F.lit(1), 4).alias("s"))
    out = files.expand_samples(rows, "s", "ms", "d")
    return out.select("event_id", F.col("sample_index").cast("bigint").alias("sample_index"), F.round("sample_ts", 3).alias("sample_ts"))


@query(
    "rotation_lines",
    "K14",
    f"""with {EV} select event_id, '1 1.00000000000000000 0.00000000000000000 ' || case when k % 2 = 0 then '0.50000000000000000' else '-0.25000000000000000' end || ' 0.00000000000000000 0 0 0' as line from ev""",
)
def rotation_lines(t):
    y = F.when(F.col("k") % 2 == 0, 0.5).otherwise(-0.25)
    return t.ev.select("event_id", files.rotation_line((F.lit(1.0), F.lit(0.0), y, F.lit(0.0))).alias("line"))
