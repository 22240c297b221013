"""Queries on relational extracts: coverage, bindings, gates, statistics, graph and retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import quaternion as Q
from quillon.functions.numeric import clamp, coverage_ratio, eta_ms, finite, is_finite, percent_of
from quillon.operators import gates, graph, raster, relational, retrieval, statistics
from quillon.plans.base import EV, r6, query
from quillon.streaming import events as streams


@query("lens_frames_matched", "J2", "select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem)")
def lens_frames_matched(t):
    return relational.in_both(t.orders, t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]).select("o_orderkey")


@query(
    "mask_coverage",
    "J3 A4 P26",
    """select o_orderpriority, count(*) as total, count_if(hit) as covered, round(count_if(hit) / count(*), 6) as coverage,
       count_if(hit) = count(*) as complete
       from (select o_orderpriority, o_orderkey in (select l_orderkey from lineitem) as hit from orders) group by 1""",
)
def mask_coverage(t):
    done = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    out = relational.coverage_of(t.orders, done, ["o_orderkey"], ["o_orderpriority"])
    return out.withColumn("coverage", r6("coverage"))


@query(
    "frame_link_lookup",
    "J4",
    """with l as (select l_partkey as image_id, l_orderkey as frame_id, row_number() over (partition by l_partkey order by l_orderkey desc, l_linenumber desc) as r
        from lineitem where lower(l_linestatus) = 'o')
    select p_partkey, frame_id from part left join l on p_partkey = image_id and r = 1""",
)
def frame_link_lookup(t):
    data = t.lineitem.filter(F.lower("l_linestatus") == "o").withColumn("pos", F.struct("l_orderkey", "l_linenumber"))
    last = relational.last_wins(data, ["l_partkey"], "pos").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("frame_id"))
    return t.part.select("p_partkey").join(last, "p_partkey", "left")


@query(
    "image_binding",
    "J10 A7 D5",
    """select n_nationkey, n_name, r_name, count(*) as suppliers, count(distinct c_custkey) as customers, count(s_acctbal) as known,
       exists (select 1 from supplier where s_acctbal < 0) as any_negative
       from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
       left join customer on c_nationkey = n_nationkey and c_acctbal > 9000 group by all""",
)
def image_binding(t):
    negative = relational.any_row(t.supplier, F.col("s_acctbal") < 0)
    out = (
        t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(t.customer.filter("c_acctbal > 9000"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    )
    return out.groupBy("n_nationkey", "n_name", "r_name").agg(
        F.count(F.lit(1)).alias("suppliers"), F.countDistinct("c_custkey").alias("customers"), F.count("s_acctbal").alias("known"),
        F.lit(negative).alias("any_negative"),
    )


_FEATURES = """f as (select p_partkey as id, case when p_partkey % 11 = 0 then null else p_size end as kr, case p_partkey % 5 when 0 then 3 else 4 end as kc,
      p_size * 16 - (case when p_partkey % 13 = 0 then 4 else 0 end) as kb, case when p_partkey % 17 = 0 then null else p_size + (case when p_partkey % 19 = 0 then 1 else 0 end) end as dr,
      case when p_partkey % 7 = 0 then 64 else 128 end as dc, p_size * 128 as db from part)"""


@query(
    "feature_status",
    "J11 P4 A18",
    f"""with {_FEATURES}, s as (select case when kr is null or dr is null then 'incomplete' when kr < 0 or kc < 0 then 'negative keypoints'
      when dr < 0 or dc < 0 then 'negative descriptors' when kc not in (2, 4, 6) then 'keypoint columns' when dc <> 128 then 'descriptor columns'
      when kr <> dr then 'row counts differ' when kb <> kr * kc * 4 then 'keypoint bytes' when db <> dr * dc then 'descriptor bytes' else 'complete' end as status from f)
    select status, count(*) as images from s group by 1""",
)
def feature_status(t):
    p, size = F.col("p_partkey"), F.col("p_size")
    kp = t.part.filter(p % 11 != 0).select(
        "p_partkey", size.alias("kp_rows"), F.when(p % 5 == 0, 3).otherwise(4).alias("kp_cols"),
        (size * 16 - F.when(p % 13 == 0, 4).otherwise(0)).alias("kp_bytes"),
    )
    desc = t.part.filter(p % 17 != 0).select(
        "p_partkey", (size + F.when(p % 19 == 0, 1).otherwise(0)).alias("desc_rows"), F.when(p % 7 == 0, 64).otherwise(128).alias("desc_cols"),
        (size * 128).alias("desc_bytes"),
    )
    rows = t.part.select("p_partkey").join(kp, "p_partkey", "left").join(desc, "p_partkey", "left")
    return rows.groupBy(gates.feature_status().alias("status")).agg(F.count(F.lit(1)).alias("images"))


@query(
    "focal_gate",
    "P5 P6 P7 A8",
    """with c as (select p_partkey, cast(p_partkey % 19 as int) as model, p_size * 40 as width, p_size * 30 as height,
        case when p_partkey % 23 = 0 then 'default' when p_partkey % 2 = 0 then 'Metadata ' else 'view_graph_calibrator' end as source, p_partkey % 29 <> 0 as verified,
        case when p_partkey % 3 = 0 then 0.3 * (p_size * 40) else p_retailprice end as f from part where p_size > 0),
    m as (select *, case when model in (0, 14) then 3 when model in (1, 2, 8, 12, 15) then 4 when model in (3, 7, 9, 13) then 5 when model in (4, 5) then 8
        when model in (6, 10) then 12 when model = 11 then 16 when model = 16 then 6 end as n from c),
    s as (select case when n is null then 'model' when p_partkey % 31 = 0 then 'parameter count' when trim(lower(source)) = 'default' then 'source' when not verified then 'not verified'
        when p_partkey % 3 = 0 then 'default guess' else 'accepted' end as status from m)
    select status, count(*) as cameras, round(count(*) / (select count(*) from s), 6) as share from s group by 1""",
)
def focal_gate(t):
    p = F.col("p_partkey")
    models = F.broadcast(gates.camera_models(t.spark))  # seventeen rows
    c = t.part.filter("p_size > 0").select(
        "p_partkey", (p % 19).cast("int").alias("model"), (F.col("p_size") * 40).alias("width"), (F.col("p_size") * 30).alias("height"),
        F.when(p % 23 == 0, "default").when(p % 2 == 0, "Metadata ").otherwise("view_graph_calibrator").alias("source"),
        (p % 29 != 0).alias("verified"), F.when(p % 3 == 0, F.lit(0.3) * (F.col("p_size") * 40)).otherwise(F.col("p_retailprice")).alias("f"),
    ).join(models, "model", "left")
    n = F.coalesce("n_params", F.lit(3)) + F.when(p % 31 == 0, 1).otherwise(0)
    value = (
        lambda i: F.when(F.array_contains("focal", i), F.col("f"))
        .when(i == F.get("principal", F.lit(0)), F.col("width") / 2)
        .when(i == F.get("principal", F.lit(1)), F.col("height") / 2)
        .otherwise(F.lit(0.0))
    )
    c = c.withColumn("params", F.transform(F.sequence(F.lit(0), n - 1), value)).drop("n_params", "focal", "principal")
    out = gates.focal_status(c).groupBy("status").agg(F.count(F.lit(1)).alias("cameras"))
    total = F.sum("cameras").over(Window.partitionBy(F.lit(1)))  # a row for each status
    return out.select("status", "cameras", r6(coverage_ratio("cameras", total)).alias("share"))


@query(
    "prior_upsert",
    "J13 D2 K11 P9",
    """with t as (select c_custkey as id, c_nationkey as sensor, c_acctbal as x, c_mktsegment as system from customer where c_custkey % 3 <> 0),
    c as (select c_custkey as key, c_acctbal * 2 as g from customer where c_custkey % 2 = 0),
    n as (select key, g, row_number() over (order by hash(1)) as r from c where key % 3 = 0)
    select count(*) as n_rows, cast(count(distinct id) as bigint) as ids, cast(max(id) as bigint) as top, round(sum(g), 2) as gravity, count_if(system = 'none') as added from (
      select t.id, c.g, t.system from t left join c on t.id = c.key
      union all select (select max(id) from t) + r, g, 'none' from n)""",
)
def prior_upsert(t):
    c = t.customer
    target = c.filter("c_custkey % 3 <> 0").select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("key"), F.lit(None).cast("double").alias("g"), F.col("c_mktsegment").alias("system")
    )
    changes = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") * 2).alias("g"))
    out = relational.upsert(target, changes, ["key"], "id", {"system": F.coalesce("system", F.lit("none"))}, ["g"], {"system": F.lit("none")})
    return out.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("ids"), F.max("id").alias("top"),
        F.round(F.sum("g"), 2).alias("gravity"), F.count_if(F.col("system") == "none").alias("added"),
    )


@query(
    "flag_update",
    "D3",
    """select p_partkey, case when p_partkey in (select l_partkey from lineitem where l_quantity > 49) then 1 else p_size end as flag from part""",
)
def flag_update(t):
    accepted = t.lineitem.filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    target = t.part.select("p_partkey", F.col("p_size").alias("flag"))
    return relational.set_flag(target, accepted, "p_partkey", "flag")


@query(
    "prefix_rules",
    "J14",
    """with r as (select distinct left(p_name, 3) as prefix from part where p_partkey < 8 union select distinct left(p_name, 6) from part where p_partkey < 4),
    m as (select p_partkey, prefix, row_number() over (partition by p_partkey order by prefix) as n from part join r on starts_with(p_name, prefix))
    select p.p_partkey, m.prefix from part p left join m on p.p_partkey = m.p_partkey and n = 1""",
)
def prefix_rules(t):
    short = t.part.filter("p_partkey < 8").select(F.substring("p_name", 1, 3).alias("prefix"))
    rules = short.union(t.part.filter("p_partkey < 4").select(F.substring("p_name", 1, 6))).distinct()
    names = t.part.select("p_name").distinct()
    return t.part.join(relational.prefix_match(names, rules, "p_name", "prefix"), "p_name").select("p_partkey", "prefix")


@query(
    "sibling_pairs",
    "J15 U6",
    """with f as (select 'VID_' || c_nationkey || case when c_custkey % 2 = 0 then '_00_' else '_10_' end || (c_custkey // 2) || '.insv' as path from customer),
    k as (select path, regexp_extract(lower(path), '^.*_([01]0)_', 1) as role, regexp_replace(lower(path), '^(.*)_[01]0_', '\\1_xx_') as pair_key from f)
    select coalesce(a.pair_key, b.pair_key) as pair_key, a.path as lens0, b.path as lens1
    from (select * from k where role = '00') a full join (select * from k where role = '10') b on a.pair_key = b.pair_key""",
)
def sibling_pairs(t):
    marker = F.when(F.col("c_custkey") % 2 == 0, "_00_").otherwise("_10_")
    path = F.concat(F.lit("VID_"), "c_nationkey", marker, F.call_function("div", F.col("c_custkey"), F.lit(2).cast("long")), F.lit(".insv"))
    return relational.pair_siblings(t.customer.select(path.alias("path")), "path")


@query(
    "event_task_resolution",
    "J16",
    f"""with {EV}, tasks as (select user_id, min(event_id) as task from ev where event_type = 'signup' group by 1),
    one as (select user_id, min(event_id) as only_open, count(*) as n from ev where event_type = 'purchase' group by 1)
    select e.event_id, coalesce(t.task, case when o.n = 1 then o.only_open end) as task from ev e left join tasks t on e.user_id = t.user_id and e.k < 50
    left join one o on e.user_id = o.user_id where e.event_type = 'error'""",
)
def event_task_resolution(t):
    tasks = t.ev.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("task"))
    one = t.ev.filter("event_type = 'purchase'").groupBy("user_id").agg(F.min("event_id").alias("only_open"), F.count(F.lit(1)).alias("n"))
    e = t.ev.filter("event_type = 'error'").join(tasks, "user_id", "left").join(one, "user_id", "left")
    own = F.when(F.col("k") < 50, F.col("task"))
    return e.select("event_id", F.coalesce(own, F.when(F.col("n") == 1, F.col("only_open"))).alias("task"))


@query(
    "robust_medians",
    "A1 A1b P1 O1 O10",
    f"""with {EV} select event_type, median(value) as plain, median(case when k % 10 <> 0 then value end) as finite, count(*) as n from ev group by 1""",
)
def robust_medians(t):
    x = F.when(F.col("k") % 20 == 0, F.lit(float("nan"))).when(F.col("k") % 10 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    rows = t.ev.withColumn("x", x)
    middle = statistics.exact_ranks(rows, ["event_type"], {"plain": F.col("value"), "finite": finite("x")})
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).join(middle, "event_type").select("event_type", "plain", "finite", "n")


@query(
    "model_quality",
    "A2 G1 G3",
    """with recursive m as (select distinct l_orderkey as p, l_suppkey as i from lineitem),
    f as (select p, min(i) as a from m group by p), e as (select distinct f.a, m.i as b from m join f using (p) where m.i <> f.a),
    both_ways as (select a, b from e union select b, a from e),
    reach(n, c) as (select i, i from (select distinct i from m) union select r.n, x.b from reach r join both_ways x on r.c = x.a),
    comp as (select n, min(c) as c from reach group by n), sizes as (select c, count(*) as k from comp group by c),
    pts as (select p, count(*) as len from m group by p)
    select (select count(*) from comp) as image_count, (select count(*) from pts) as point_count, (select median(len) from pts) as median_track_length,
           (select count(*) from sizes) as component_count, (select max(k) from sizes) as largest_component,
           round((select max(k) from sizes) / (select count(*) from comp), 6) as coverage""",
)
def model_quality(t):
    track = t.lineitem.select("l_orderkey", "l_suppkey").distinct()
    comp = graph.component_sizes(track, "l_suppkey", graph.star_edges(track, "l_orderkey", "l_suppkey"), "model")
    one = F.lit(1).alias("model")
    images = track.select(one, F.col("l_suppkey").alias("image_id")).distinct()
    points = track.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("track_length"))
    points = points.select(one, F.col("l_orderkey").alias("point_id"), F.lit(None).cast("double").alias("err"), "track_length")
    out = statistics.model_quality(images, points, comp.select(one, F.col("l_suppkey").alias("node"), "component"), ["model"])
    return out.select("image_count", "point_count", "median_track_length", "component_count", "largest_component", r6("coverage").alias("coverage"))


@query(
    "capture_metrics",
    "A3 A6 U1 U2 U3 G2",
    """with e as (select o_orderkey as f, cast(l as bigint) as lens from orders, range(2) t(l)), r as (select distinct l_orderkey as f, cast(l_linenumber % 2 as bigint) as lens from lineitem),
    x as (select e.f, count(*) as ne, count(r.f) as nr from e left join r on e.f = r.f and e.lens = r.lens group by 1)
    select count(*) as expected_frames, count_if(nr > 0) as any_lens, count_if(ne = 2 and nr = 2) as complete, sum(ne - nr)::bigint as unregistered from x""",
)
def capture_metrics(t):
    lens = F.explode(graph.lenses_of(F.lit("frame"))).cast("bigint")
    expected = t.orders.select(F.col("o_orderkey").alias("f"), F.explode(graph.lenses_of(F.lit("frame"))).alias("lens"))
    expected = expected.withColumn("lens", F.col("lens").cast("bigint"))
    registered = t.lineitem.select(F.col("l_orderkey").alias("f"), (F.col("l_linenumber") % 2).cast("bigint").alias("lens"))
    counts = relational.complete_rigs(expected, registered, "f", "lens")
    missing = relational.missing_from(expected, registered, ["f", "lens"]).agg(F.count(F.lit(1)).alias("unregistered"))
    del lens
    return counts.join(missing)


@query(
    "name_differences",
    "U4 U5 K6",
    """with e as (select distinct o_custkey % 1000 as n, o_orderstatus as s from orders), r as (select distinct c_custkey % 1000 as n, 'O' as s from customer where c_custkey % 7 <> 0)
    select coalesce(e.s, r.s) as s, count(e.n) as expected, count(r.n) as registered, count(*) filter (r.n is null) as missing, count(*) filter (e.n is null) as unexpected
    from e full join r on e.n = r.n and e.s = r.s group by 1""",
)
def name_differences(t):
    e = t.orders.select((F.col("o_custkey") % 1000).alias("n"), F.col("o_orderstatus").alias("s"))
    r = t.customer.filter("c_custkey % 7 <> 0").select((F.col("c_custkey") % 1000).alias("n"), F.lit("O").alias("s"))
    return relational.name_sets(e, r, ["s"], "n")


@query(
    "committed_sets_equal",
    "U4 K5",
    """select 'left' as side, count(*) as n from (select o_orderkey from orders except select l_orderkey from lineitem)
       union all select 'right', count(*) from (select l_orderkey from lineitem except select o_orderkey from orders)""",
)
def committed_sets_equal(t):
    diff = relational.set_difference(t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k")))
    sides = t.spark.createDataFrame([("left",), ("right",)], "side string")
    return sides.join(diff.groupBy("side").agg(F.count(F.lit(1)).alias("n")), "side", "left").fillna(0, ["n"])


_GRAV = """o as (select user_id, event_id, 0.02 * sin(value) as x, -1.0 as y, 0.02 * cos(value) as z, event_id % 10 = 0 as bad from ev where k % 10 <> 1),
    u as (select user_id, case when bad then 1.0 else x / sqrt(x*x+y*y+z*z) end as x, case when bad then 0.0 else y / sqrt(x*x+y*y+z*z) end as y,
          case when bad then 0.0 else z / sqrt(x*x+y*y+z*z) end as z from o),
    s0 as (select user_id, count(*) as matched, median(x) as a, median(y) as b, median(z) as c from u group by 1),
    s as (select user_id, matched, a / sqrt(a*a+b*b+c*c) as a, b / sqrt(a*a+b*b+c*c) as b, c / sqrt(a*a+b*b+c*c) as c from s0),
    r as (select u.*, s.matched, degrees(acos(greatest(least(u.x*a+u.y*b+u.z*c, 1.0), -1.0))) as e from u join s using (user_id)),
    m as (select user_id, median(e) as med from r group by 1),
    d as (select r.user_id, median(abs(e - med)) as mad from r join m using (user_id) group by 1),
    l as (select user_id, med, least(greatest(med + 3.0 * greatest(mad, 0.5), 5.0), 20.0) as lim from m join d using (user_id)),
    n as (select r.user_id, count_if(e <= lim) as inliers, any_value(med) as med, any_value(lim) as lim, any_value(matched) as matched from r join l using (user_id) group by 1),
    c as (select user_id, count(*) as images from ev group by 1)"""


@query(
    "gravity_alignment",
    "A9 J12 Q5 Q6 Q8 P29",
    f"""with {EV}, {_GRAV} select c.user_id, images, matched, inliers, round(med, 6) as median_residual_deg, round(lim, 6) as limit_deg,
    case when matched < 8 then 'too few observations' when matched / images < 0.8 then 'coverage' when not med <= 10.0 then 'inconsistent'
         when inliers < 8 or inliers / matched < 0.7 then 'too few inliers' end as problem from c join n using (user_id)""",
)
def gravity_alignment(t):
    bad = F.col("event_id") % 10 == 0
    images = t.ev.select("user_id", F.col("event_id").alias("name"), F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0)]).alias("q"))
    g = F.when(bad, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(0.02 * F.sin("value"), F.lit(-1.0), 0.02 * F.cos("value")))
    priors = t.ev.filter("k % 10 <> 1").select("user_id", F.col("event_id").alias("name"), g.alias("gravity"))
    out = statistics.gravity_alignment(images, priors, ["user_id"])
    return out.select("user_id", "images", "matched", "inliers", r6("median_residual_deg").alias("median_residual_deg"),
                      r6("inlier_threshold_deg").alias("limit_deg"), "problem")


@query(
    "anchor_centroids",
    "A15",
    """with p as (select label, i, sum(embedding[i]::double) as s from embeddings, range(1, 65) t(i) group by all),
    n as (select label, sqrt(sum(s * s)) as n from p group by 1)
    select p.label, round(sum(s / n * i), 5) as checksum, round(max(s / n), 6) as top from p join n using (label) group by 1""",
)
def anchor_centroids(t):
    out = statistics.centroid(t.embeddings, ["label"], "embedding")
    at = F.aggregate(F.zip_with("embedding", F.sequence(F.lit(1), F.lit(64)), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return out.select("label", F.round(at, 5).alias("checksum"), r6(F.array_max("embedding")).alias("top"))


_ANCHORS = """a as (select label, vec_id, embedding::double[] as e, row_number() over (partition by label order by vec_id) as pos from embeddings),
    f as (select * from a where pos <= 20),
    p as (select label, i, sum(e[i]) as s from f, range(1, 65) t(i) group by all), nn as (select label, sqrt(sum(s * s)) as n from p group by 1),
    c as (select p.label, list(s / n order by i) as v from p join nn using (label) group by 1),
    sp as (select x.label as source_a, y.label as source_b, 1 - greatest(least(list_dot_product(x.v, y.v), 1.0), -1.0) as sd from c x join c y on x.label < y.label),
    top as (select * from sp where sd <= 1.5 order by sd, source_a, source_b limit 128)"""


@query(
    "source_pairs",
    "J8 O2 O8 Q16 P15",
    f"with {_ANCHORS} select source_a, source_b, round(sd, 6) as source_distance from top",
)
def source_pairs(t):
    config = retrieval.Retrieval(source_distance=1.5)
    vectors = t.embeddings.select(F.col("label").alias("source"), F.col("vec_id").alias("frame"), F.col("embedding").alias("descriptor"))
    out = retrieval.source_pairs(retrieval.first_anchors(vectors, config), config)
    return out.withColumn("source_distance", r6("source_distance"))


@query(
    "anchor_matches",
    "J9 O3 O4 Q17",
    f"""with {_ANCHORS}, b as (select source_a, source_b, x.vec_id as fa, y.vec_id as fb, x.pos as pa, y.pos as pb,
        1 - greatest(least(list_dot_product(x.e, y.e), 1.0), -1.0) as d from top join f x on x.label = source_a join f y on y.label = source_b),
    r as (select *, row_number() over wa as ra, row_number() over wb as rb,
        nth_value(d, 1) over (wa rows between unbounded preceding and unbounded following) as a1, nth_value(d, 2) over (wa rows between unbounded preceding and unbounded following) as a2,
        nth_value(d, 1) over (wb rows between unbounded preceding and unbounded following) as b1, nth_value(d, 2) over (wb rows between unbounded preceding and unbounded following) as b2
        from b window wa as (partition by source_a, source_b, pa order by d, pb), wb as (partition by source_a, source_b, pb order by d, pa)),
    k as (select * from r where ra <= 2 and d <= 0.9 and (rb = 1 or (least(greatest(a1 / a2, 0), 1) <= 0.85 and least(greatest(b1 / b2, 0), 1) <= 0.85))),
    o as (select *, row_number() over (partition by source_a, source_b order by d, fa, fb) as n from k)
    select source_a, source_b, fa as frame_a, fb as frame_b, round(d, 6) as distance, rb = 1 as mutual from o where n <= 4""",
)
def anchor_matches(t):
    config = retrieval.Retrieval(source_distance=1.5, distance=0.9)
    vectors = t.embeddings.select(F.col("label").alias("source"), F.col("vec_id").alias("frame"), F.col("embedding").alias("descriptor"))
    out = retrieval.retrieve(vectors, config)
    return out.select("source_a", "source_b", "frame_a", "frame_b", r6("distance").alias("distance"), "mutual")


def _sql_q(x: str) -> str:
    return f"round({x}, 6)"


@query(
    "quaternion_algebra",
    "Q1 Q2 Q4 Q5 Q9 Q10 Q20",
    f"""with {EV}, a as (select event_id, value * 0.01 as h, k * 0.02 as g from ev),
    q as (select event_id, cos(h) as aw, sin(h) as ax, cos(g) as bw, sin(g) as b2 from a)
    select event_id, {_sql_q('aw*bw')} as w, {_sql_q('ax*bw')} as x, {_sql_q('aw*b2')} as y, {_sql_q('ax*b2')} as z,
      {_sql_q('degrees(2 * acos(least(abs(aw*bw), 1.0)))')} as between_deg,
      {_sql_q('2 * atan2(abs(ax), abs(aw))')} as angle from q""",
)
def quaternion_algebra(t):
    h, g = F.col("value") * 0.01, F.col("k") * 0.02
    zero = F.lit(0.0)
    a = Q.chain((F.cos(h) * 3, F.sin(h) * 3, zero, zero), Q.normalize)
    b = Q.chain((F.cos(g), zero, F.sin(g), zero), Q.normalize)
    rows = t.ev.select("event_id", a.alias("a"), b.alias("b"))
    a, b = Q.of("a"), Q.of("b")

    def checked(v):
        product = Q.multiply(v[:4], v[4:])
        # the same product by the matrix of the left factor
        byrow = [sum((r[i] * v[4 + i] for i in range(1, 4)), r[0] * v[4]) for r in Q.left_matrix(v[:4])]
        return tuple(F.when(F.abs(x - y) < 1e-12, x) for x, y in zip(product, byrow))

    both = (*a, *b)
    rows = rows.select(
        "event_id", Q.chain(both, checked).alias("p"), Q.chain(both, lambda v: (Q.angle_degrees(v[:4], v[4:]),)).alias("d"),
        Q.chain(a, lambda v: (Q.axis_angle(v)[1],)).alias("t"),
    )
    return rows.select(
        "event_id", *[r6(c).alias(n) for c, n in zip(Q.of("p"), "wxyz")], r6(F.get("d", F.lit(0))).alias("between_deg"),
        r6(F.get("t", F.lit(0))).alias("angle"),
    )


@query(
    "view_overlap",
    "P21 Q6 Q7",
    f"""with {EV}, v as (select event_id, 2 * (value * 0.01) as a, k * 0.5 as half from ev)
    select event_id, case when half > 0 then degrees(acos(greatest(least(cos(a), 1.0), -1.0))) <= half + 30.0 + 1e-9 end as overlaps from v
    where abs(degrees(acos(greatest(least(cos(a), 1.0), -1.0))) - half - 30.0) > 1e-6""",
)
def view_overlap(t):
    q = (F.cos(F.col("value") * 0.01), F.lit(0.0), F.sin(F.col("value") * 0.01), F.lit(0.0))
    forward = Q.lit(0, 0, 1)
    rows = t.ev.withColumn("v", Q.chain(q, lambda u: Q.rotate(u, forward)))
    turned, half = Q.of("v", 3), F.col("k") * 0.5
    edge = F.abs(Q.vector_angle(forward, turned) - half - 30.0)
    return rows.filter(edge > 1e-6).select("event_id", Q.views_overlap(forward, turned, half, F.lit(30.0)).alias("overlaps"))


@query(
    "orientation_gate",
    "P10 P11 P12",
    f"""with {EV}, p as (select user_id, event_id, ms, event_id % 53 = 0 as bad, (k % 60) / 10.0 as res, value from ev where event_type = 'view'),
    c as (select e.user_id, count(*) as expected, count_if(exists (select 1 from p where p.user_id = e.user_id and abs(p.ms - e.ms) <= 5000000.0)) as covered
          from ev e where event_type = 'click' group by 1),
    s as (select user_id, count_if(bad or res > 5.0) as invalid, max(res) as top from p group by 1)
    select c.user_id, expected, covered, round(covered / expected, 6) as coverage, top as max_residual_deg, coalesce(invalid, 0) = 0 and covered / expected >= 0.8 as valid
    from c left join s on c.user_id = s.user_id""",
)
def orientation_gate(t):
    from quillon.operators import asof

    bad = F.col("event_id") % 53 == 0
    one = F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)])
    p = t.ev.filter("event_type = 'view'").select(
        "user_id", F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("pos"), F.col("ms").alias("ts"),
        F.array(F.when(bad, 0.0).otherwise(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("q"), one.alias("covariance"),
        F.lit(1.0).alias("weight"), ((F.col("k") % 60) / 10.0).cast("double").alias("residual_deg"), F.lit("v1").alias("version"),
    )
    frames = t.ev.filter("event_type = 'click'").select("user_id", "event_id", F.col("ms").alias("ts"))
    covered = asof.covered_within(frames, p, ["user_id"], "ts", 5_000_000.0)
    out = gates.prior_report(p, frames, covered, ["user_id"], 15.0, "v1")
    return out.select("user_id", "expected", "covered", r6("coverage").alias("coverage"), "max_residual_deg", "valid")


@query(
    "inferred_gates",
    "P29 P30 P31 P32 P16 P17",
    """with b as (select l_suppkey % 10 as boundary, count(distinct (l_orderkey, l_partkey)) as verified from lineitem where l_quantity > 45 group by 1),
    s as (select l_suppkey % 10 as boundary, l_linenumber as component, count(distinct l_orderkey) as joint, count(*) as images from lineitem group by all),
    r as (select *, row_number() over (partition by boundary order by (joint >= 3) desc, joint desc, images desc, component) as n from s)
    select b.boundary, verified, verified >= 3 as connected, r.component as seed, joint, joint / (joint + 10.0) >= 0.9 as enough from b join r on b.boundary = r.boundary and n = 1""",
)
def inferred_gates(t):
    li = t.lineitem.withColumn("boundary", F.col("l_suppkey") % 10)
    verified = li.filter("l_quantity > 45").select("boundary", F.col("l_orderkey").alias("frame_a"), F.col("l_partkey").alias("frame_b"))
    comp = li.groupBy("boundary", F.col("l_linenumber").alias("component")).agg(
        F.countDistinct("l_orderkey").alias("joint_frames"), F.count(F.lit(1)).alias("images")
    )
    seed = gates.choose_seed(comp, ["boundary"])
    out = gates.boundary_connected(verified, ["boundary"]).join(seed, "boundary")
    more = gates.continues(F.lit(2), F.col("joint_frames"), F.col("joint_frames") + 10)
    return out.select("boundary", "verified", "connected", F.col("component").alias("seed"), F.col("joint_frames").alias("joint"), (~more).alias("enough"))


@query(
    "progress_summary",
    "A18 A19 A23 Q25 Q26 STR13 A22",
    f"""with {EV}, p as (select user_id, case event_type when 'click' then 'completed' when 'error' then 'failed' else 'running' end as status,
        case when k = 0 then 0.0 when k <= 1 then least(k, 1) * 100.0 else least(k, 100) end as pr, value, k,
        case event_type when 'view' then 1498380.0 when 'click' then 287773.0 else 4941579.0 end as w from ev)
    select user_id, cast(floor(sum(w * case when status = 'completed' then 1.0 else least(greatest(k, 0), 100) / 100.0 end) / sum(w) * 100 + 0.5) as int) as progress,
      count_if(status = 'completed') as done, count_if(status = 'failed') as failed, round(avg(case when status = 'running' then floor(pr + 0.5) end), 6) as running_mean from p group by 1""",
)
def progress_summary(t):
    from quillon.functions.strings import first_containing

    status = first_containing("event_type", [("click", "completed"), ("error", "failed")], "running")
    weight = F.when(F.col("event_type") == "view", 1498380.0).when(F.col("event_type") == "click", 287773.0).otherwise(4941579.0)
    rows = t.ev.withColumns({"status": status, "w": weight, "progress": percent_of("k")})
    return rows.groupBy("user_id").agg(
        statistics.weighted_progress("k", "status", "w").alias("progress"),
        F.count_if(F.col("status") == "completed").alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        r6(F.avg(F.when(F.col("status") == "running", F.col("progress")))).alias("running_mean"),
    )


@query(
    "remaining_time",
    "Q25",
    f"""with {EV} select event_id, round(case when value > 0 then case when k > 0 and 90 >= k then value / k * (90 - k) when k >= 5 then value * (100 - k) / k end end, 6) as eta from ev""",
)
def remaining_time(t):
    return t.ev.select("event_id", r6(eta_ms("value", "k", F.lit(90), "k")).alias("eta"))


@query(
    "box_overlap",
    "Q18",
    f"""with {EV}, b as (select event_id, value as x0, k::double as y0, value + 20.0 as x1, k + 30.0 as y1, lag(value) over (order by event_id) as px, lag(k) over (order by event_id) as py from ev),
    i as (select event_id, greatest(least(x1, px + 20.0) - greatest(x0, px), 0) * greatest(least(y1, py + 30.0) - greatest(y0, py), 0) as c from b where px is not null)
    select event_id, round(c / (1200.0 - c), 6) as iou from i""",
)
def box_overlap(t):
    rows = t.ev
    before = rows.select((F.col("event_id") + 1).alias("event_id"), F.col("value").alias("px"), F.col("k").alias("py"))
    both = rows.join(before, "event_id")
    w = F.least(F.col("value") + 20.0, F.col("px") + 20.0) - F.greatest("value", "px")
    h = F.least(F.col("k") + 30.0, F.col("py") + 30.0) - F.greatest("k", "py").cast("double")
    common = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = F.lit(1200.0) - common
    return both.select("event_id", r6(F.when(union > 0, common / union).otherwise(0.0)).alias("iou"))


@query("non_max_suppression", "O5")
def non_max_suppression(t):
    box = F.array("value", F.col("k").cast("double"), F.col("value") + 20.0, F.col("k") + 30.0)
    d = t.ev.select(F.col("user_id").alias("image"), F.col("event_id").alias("pos"), box.alias("box"), (F.col("value") % 1).alias("score"), (F.col("k") % 3).alias("class_id"))
    return raster.non_max_suppression(d, ["image"])


@query(
    "tile_means",
    "A20 I5",
    f"""with {EV} select user_id, cast(floor(k / 32) as bigint) as tile_x, cast(floor((event_id % 64) / 32) as bigint) as tile_y, cast(sum(cast(floor(value) as bigint)) // count(*) as bigint) as mean from ev group by all""",
)
def tile_means(t):
    pixels = t.ev.select("user_id", F.col("k").alias("x"), (F.col("event_id") % 64).alias("y"), F.floor("value").alias("value"))
    return raster.tile_means(pixels, ["user_id"], 32)


@query("raster_sharpness", "I1 I2 I4 A21 P22")
def raster_sharpness(t):
    byte = F.transform("embedding", lambda x: F.lpad(F.hex(F.floor(clamp((x + 1) * 127, 0.0, 255.0)).cast("long")), 2, "0"))
    data = F.unhex(F.concat_ws("", F.flatten(F.array_repeat(byte, 4))))
    frames = t.embeddings.select("vec_id", F.lit(16).alias("width"), F.lit(16).alias("height"), data.alias("data"))
    return raster.map_frames(frames, raster.sharpness, "sharpness", "double").select("vec_id", r6("sharpness").alias("sharpness"))


@query("raster_descriptor", "I5 I6 Q16")
def raster_descriptor(t):
    byte = F.transform("embedding", lambda x: F.lpad(F.hex(F.floor(clamp((x + 1) * 127, 0.0, 255.0)).cast("long")), 2, "0"))
    frames = t.embeddings.select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(F.concat_ws("", byte)).alias("data"))
    out = raster.map_frames(frames, lambda x: raster.global_descriptor(x, 8), "descriptor", "array<double>")
    return out.select("vec_id", F.size("descriptor").alias("n"), r6(statistics.dot_product("descriptor", "descriptor")).alias("norm"))


@query(
    "terminal_suppression",
    "ST3 ST2",
    f"""with {EV}, s as (select *, case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'running' end as status from ev),
    d as (select *, coalesce(max(case when status in ('completed', 'failed', 'cancelled') then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as done from s where user_id % 10 <> 0)
    select event_id, user_id, status from d where done = 0""",
)
def terminal_suppression(t):
    from quillon.functions.strings import first_containing

    rows = t.ev.withColumn("status", first_containing("event_type", [("purchase", "completed"), ("error", "failed")], "running"))
    ignored = t.ev.filter("user_id % 10 = 0").select("user_id").distinct()
    return streams.suppress_after_terminal(rows, "user_id", "event_id", "status", ignored).select("event_id", "user_id", "status")


@query(
    "progress_fold",
    "ST2 W13",
    """with n as (select *, case when lag(role) over (partition by conv_id order by turn) is not distinct from role then 0 else 1 end as nw from conversations),
    r as (select *, sum(nw) over (partition by conv_id order by turn) as run from n),
    g as (select conv_id, run, first(role order by turn) as phase, min(turn)::double as started, count(*) as events from r group by all),
    x as (select *, lead(started) over (partition by conv_id order by run) as finished, row_number() over (partition by conv_id order by run desc) as b from g)
    select conv_id, cast(run as bigint) as run, phase, events, case when finished >= started then finished - started when finished < started then 0.0 end as duration from x where b <= 100""",
)
def progress_fold(t):
    rows = t.conversations.withColumn("t", F.col("turn").cast("double"))
    out = streams.fold_progress(rows, ["conv_id"], "t", "role", "turn")
    return out.select("conv_id", "run", "phase", "events", "duration")


@query(
    "latest_log_rows",
    "W13 O10",
    "select conv_id, turn from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 3",
)
def latest_log_rows(t):
    return streams.latest_rows(t.conversations, ["conv_id"], "turn", 3).select("conv_id", "turn")


@query(
    "device_ordinals",
    "W14 O12",
    """with d as (select s_suppkey, 'Device ' || (s_nationkey % 7) as name from supplier)
    select s_suppkey, case when count(*) over (partition by name) > 1 then name || ' #' || row_number() over (partition by name order by s_suppkey) else name end as label from d""",
)
def device_ordinals(t):
    from quillon.sources.files import device_labels

    rows = t.supplier.select("s_suppkey", F.concat(F.lit("Device "), F.col("s_nationkey") % 7).alias("name"))
    return device_labels(rows, "name", "s_suppkey").select("s_suppkey", "label")


@query(
    "unique_lines",
    "O12",
    """with p as (select p_partkey, case when p_partkey % 2 = 0 then upper(p_brand) else p_brand end as line, p_type from part),
    r as (select *, row_number() over (partition by p_type, lower(trim(line)) order by p_partkey) as n from p) select p_type, p_partkey, line from r where n = 1""",
)
def unique_lines(t):
    line = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    rows = t.part.select("p_partkey", line.alias("line"), "p_type")
    return relational.unique_ignoring_case(rows, ["p_type"], "line", "p_partkey").select("p_type", "p_partkey", "line")


@query(
    "stage_machine",
    "ST5 ST9 B1",
    f"""with {EV}, s as (select *, ['extract', 'mask', 'align'][(k % 3) + 1] as stage, case event_type when 'purchase' then 'completed' when 'error' then 'failed' when 'signup' then 'cancelled' else 'running' end as status from ev),
    l as (select user_id, arg_max(stage, event_id) as stage, arg_max(status, event_id) as status from s group by 1)
    select user_id, stage, status, case when status in ('failed', 'cancelled') then 'stop' when status = 'completed' then case stage when 'extract' then 'mask' when 'mask' then 'align' else 'end' end else 'wait' end as next from l""",
)
def stage_machine(t):
    from quillon.functions.strings import first_containing

    stage = F.get(F.array(F.lit("extract"), F.lit("mask"), F.lit("align")), (F.col("k") % 3).cast("int"))
    status = first_containing("event_type", [("purchase", "completed"), ("error", "failed"), ("signup", "cancelled")], "running")
    rows = t.ev.withColumns({"stage": stage, "status": status})
    return streams.pipeline_state(rows, "user_id", "event_id", "stage", "status", ["extract", "mask", "align"])


@query(
    "restart_recovery",
    "ST8",
    f"""with {EV} select event_id, case when event_type = 'view' then 'cancelled' else event_type end as status,
        case when event_type = 'view' then greatest(100.0 - value, 0.0) else value end as duration_ms from ev""",
)
def restart_recovery(t):
    rows = t.ev.select(
        "event_id", F.when(F.col("event_type") == "view", "running").otherwise(F.col("event_type")).alias("status"),
        F.col("value").alias("started_ms"), F.lit(None).cast("double").alias("finished_ms"), F.col("value").alias("duration_ms"),
    )
    return streams.recover(rows, 100.0).select("event_id", "status", "duration_ms")


@query(
    "covariance_check",
    "P11 P8",
    f"""with {EV}, c as (select event_id, value / 10.0 as a, k / 10.0 as b from ev)
    select event_id, a >= -1e-10 and a * a - b * b >= -1e-10 and a * (a * a - b * b) >= -1e-10 as psd,
        case when abs(sqrt(a * a) - 1) > 1e-3 then 'norm' else 'valid' end as rig from c where abs(a * a - b * b) > 1e-6""",
)
def covariance_check(t):
    a, b, z = F.col("value") / 10.0, F.col("k") / 10.0, F.lit(0.0)
    m = F.array(a, b, z, b, a, z, z, z, a).cast("array<double>")
    pose = F.array(a, *[z] * 6).cast("array<double>")
    rows = t.ev.filter(F.abs(a * a - b * b) > 1e-6)
    return rows.select("event_id", Q.covariance_is_psd(m).alias("psd"), gates.rig_status(pose).alias("rig"))


@query(
    "stream_pairs",
    "P18 P7 STR12",
    """with s as (select s_suppkey, s_nationkey, (s_suppkey % 3 + 29) * 1000 / 1001.0 as fps, s_acctbal as ms from supplier),
    p as (select a.s_suppkey as a, b.s_suppkey as b, abs(a.fps - b.fps) > 0.01 as f, abs(a.ms - b.ms) > 1000 as d from s a join s b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey)
    select a, b, case when f and d then 'frame rate+duration' when f then 'frame rate' when d then 'duration' else '' end as issues from p""",
)
def stream_pairs(t):
    from quillon.functions.numeric import fraction

    rate = F.concat((F.col("s_suppkey") % 3 + 29) * 1000, F.lit("/1001"))
    s = t.supplier.select("s_suppkey", "s_nationkey", fraction(rate).alias("fps"), F.col("s_acctbal").alias("ms"))
    a, b = s.alias("a"), s.alias("b")
    both = a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey")))
    one = F.lit(1)
    found = gates.streams_match(one, one, one, one, F.col("a.fps"), F.col("b.fps"), F.col("a.ms"), F.col("b.ms"))
    return both.select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"), F.array_join(found, "+").alias("issues"))


@query(
    "comparison_rows",
    "A22 K8",
    """with m as (select o_orderpriority as variant, count(*) as selected, count_if(o_orderstatus = 'F') as complete from orders group by 1)
    select variant, selected, complete, round(100.0 * complete / selected, 6) as percent from m""",
)
def comparison_rows(t):
    m = t.orders.groupBy(F.col("o_orderpriority").alias("variant")).agg(
        F.count(F.lit(1)).alias("selected"), F.count_if(F.col("o_orderstatus") == "F").alias("complete")
    )
    return m.withColumn("percent", r6(100.0 * coverage_ratio("complete", "selected"))).dropna()


@query(
    "finite_projection",
    "P1 P3",
    f"""with {EV} select event_id, case when k % 7 = 0 then null else value end as x from ev""",
)
def finite_projection(t):
    x = F.when(F.col("k") % 14 == 0, F.lit(float("nan"))).when(F.col("k") % 7 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    out = t.ev.select("event_id", finite(x).alias("x"))
    return out.filter(is_finite("x") | F.col("x").isNull())
