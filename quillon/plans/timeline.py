"""Queries on time series: as-of lookups, motion, calibration, selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import quaternion as Q
from quillon.operators import asof, calibration, motion, selection
from quillon.operators.statistics import pearson
from quillon.plans.base import EV, r6, query, series_sql, sql_angle, sql_mul, sql_slerp
from quillon.storage import materialize

# samples around a probe: the last one at or before it, and the next one behind
BRACKET = f"""
    with {EV}, {series_sql('view', 's')}, {series_sql('click', 'p')},
    l as (select p.source, p.pos, p.ts, s.ts as lt, s.qw as lw, s.qx as lx, s.qy as ly, s.qz as lz
          from p asof left join s on p.source = s.source and p.ts >= s.ts),
    b as (select l.*, s.ts as rt, s.qw as rw, s.qx as rx, s.qy as ry, s.qz as rz
          from l asof left join s on l.source = s.source and l.ts < s.ts),
    f as (select *, (ts - lt) / (rt - lt) as t from b)
"""
_S = sql_slerp("l", "r", "t")
_N = "sqrt(" + " + ".join(f"{x}*{x}" for x in _S) + ")"
GAP = 20_000_000.0


@query(
    "interval_best_pair",
    "J1 W3 W4",
    f"""
    with {EV}, a as (select * from ev where event_type = 'view'), b as (select * from ev where event_type = 'click'),
    j as (select a.user_id, cast(floor(a.ms / 86400000) as bigint) as day, a.event_id as id_0, b.event_id as id_1,
                 least(a.value, b.value) as score, cast(floor(greatest(a.k - 1, 0)::double / 4.0 * 1.0) as bigint) as interval
          from a join b on a.user_id = b.user_id and floor(a.ms / 86400000) = floor(b.ms / 86400000)),
    r as (select *, row_number() over (partition by user_id, interval order by score desc, id_0, id_1) as rn from j)
    select user_id, interval, id_0, id_1, score from r where rn = 1
    """,
)
def interval_best_pair(t):
    day = F.floor(F.col("ms") / 86400000).alias("day")
    cols = ["user_id", day, F.col("event_id").alias("id"), "value", "k"]
    left = t.ev.filter("event_type = 'view'").select(*cols)
    right = t.ev.filter("event_type = 'click'").select(*cols)
    pairs = selection.pair_lenses(left, right, ["user_id", "day"])
    pairs = pairs.withColumn("interval", selection.rate_interval("k_0", 4.0, 1.0))
    pairs = pairs.withColumn("score", F.least("value_0", "value_1")).withColumn("order", F.struct("id_0", "id_1"))
    best = selection.best_per_interval(pairs, ["user_id", "interval"], "score", "order").filter("selected")
    return best.select("user_id", "interval", "id_0", "id_1", "score")


@query(
    "asof_attitude",
    "J5 J5d Q3",
    BRACKET + f"""select source, pos, round(case when ts = lt then lw else {_S[0]} / {_N} end, 6) as w,
        round(case when ts = lt then lx else {_S[1]} / {_N} end, 6) as x,
        round(case when ts = lt then ly else {_S[2]} / {_N} end, 6) as y,
        round(case when ts = lt then lz else {_S[3]} / {_N} end, 6) as z
        from f where ts = lt or rt is not null and lt is not null""",
)
def asof_attitude(t):
    out = asof.attitude_at(t.series("view"), t.series("click").drop("q"), ["source"]).filter("q is not null")
    return out.select("source", "pos", *[r6(F.get("q", F.lit(i))).alias(c) for i, c in enumerate("wxyz")])


@query(
    "asof_gap_limited",
    "J5 O6",
    BRACKET + f"""select count(*) as probes, count_if(ts = lt or rt - lt <= {GAP}) as covered,
        count_if(lt is null or (rt is null and ts <> lt)) as outside from f""",
)
def asof_gap_limited(t):
    probes = t.series("click").drop("q")
    near = asof.attitude_at(t.series("view"), probes, ["source"], max_gap_ms=GAP)
    free = asof.attitude_at(t.series("view"), probes, ["source"])
    both = near.select("source", "pos", F.col("q").alias("q1")).join(free.select("source", "pos", F.col("q").alias("q2")), ["source", "pos"])
    return both.agg(
        F.count(F.lit(1)).alias("probes"), F.count("q1").alias("covered"), F.count_if(F.col("q2").isNull()).alias("outside")
    )


@query(
    "asof_direction",
    "J5b Q7",
    f"""
    with {EV}, s as (select user_id as source, ms as ts, 0.6 as x, 0.8 * cos(value) as y, 0.8 * sin(value) as z from ev where event_type = 'view'),
    p as (select user_id as source, ms as ts, event_id as pos from ev where event_type = 'click'),
    l as (select p.*, s.ts as lt, s.x as lx, s.y as ly, s.z as lz from p asof join s on p.source = s.source and p.ts >= s.ts),
    b as (select l.*, s.ts as rt, s.x as rx, s.y as ry, s.z as rz from l asof join s on l.source = s.source and l.ts < s.ts),
    f as (select *, (ts - lt) / (rt - lt) as t from b where rt - lt <= {GAP}),
    m as (select source, pos, (1-t)*lx + t*rx as x, (1-t)*ly + t*ry as y, (1-t)*lz + t*rz as z from f)
    select source, pos, round(x / sqrt(x*x+y*y+z*z), 6) as x, round(y / sqrt(x*x+y*y+z*z), 6) as y,
           round(z / sqrt(x*x+y*y+z*z), 6) as z from m""",
)
def asof_direction(t):
    v = F.array(F.lit(0.6), 0.8 * F.cos("value"), 0.8 * F.sin("value"))
    cols = [F.col("user_id").alias("source"), F.col("ms").alias("ts"), F.col("event_id").alias("pos")]
    s = t.ev.filter("event_type = 'view'").select(*cols, v.alias("v"))
    p = t.ev.filter("event_type = 'click'").select(*cols)
    out = asof.direction_at(s, p, ["source"], max_gap_ms=GAP).filter("v is not null")
    return out.select("source", "pos", *[r6(F.get("v", F.lit(i))).alias(c) for i, c in enumerate("xyz")])


SPEED = f"""
    st as (select source, ts, lag(ts) over w as pt, qw, qx, qy, qz, lag(qw) over w as pw, lag(qx) over w as px,
                  lag(qy) over w as py, lag(qz) over w as pz from s window w as (partition by source order by ts)),
    sp as (select source, (pt + ts) * 0.5 as ts, {sql_angle('q', 'p')} as angle, {sql_angle('q', 'p')} * 1000.0 / (ts - pt) as dps
           from st where ts - pt > 2.220446049250313e-16)
"""


@query(
    "angular_speed",
    "W1 A16 Q2",
    f"""with {EV}, {series_sql('view', 's')}, {SPEED}
    select source, count(*) as steps, round(sum(angle), 4) as excitation_deg, round(max(dps), 9) as max_dps from sp group by source""",
)
def angular_speed(t):
    steps = motion.angular_speed(t.series("view"), ["source"])
    top = steps.groupBy("source").agg(F.round(F.max("speed_dps"), 9).alias("max_dps"))
    return motion.excitation(steps, ["source"]).select("source", "steps", F.round("excitation_deg", 4).alias("excitation_deg")).join(top, "source")


@query(
    "asof_speed",
    "J5c",
    f"""with {EV}, {series_sql('view', 's')}, {SPEED},
    p as (select user_id as source, ms as ts, event_id as pos from ev where event_type = 'click'),
    l as (select p.*, sp.ts as lt, sp.dps as ld from p asof join sp on p.source = sp.source and p.ts >= sp.ts),
    b as (select l.*, sp.ts as rt, sp.dps as rd from l asof join sp on l.source = sp.source and l.ts < sp.ts)
    select source, pos, round(ld * (1 - (ts - lt) / (rt - lt)) + rd * ((ts - lt) / (rt - lt)), 9) as dps from b""",
)
def asof_speed(t):
    steps = motion.angular_speed(t.series("view"), ["source"]).withColumn("pos", F.lit(0))
    out = asof.value_at(steps, t.series("click").drop("q"), ["source"], x="speed_dps").filter("speed_dps is not null")
    return out.select("source", "pos", F.round("speed_dps", 9).alias("dps"))


@query(
    "covered_within_tolerance",
    "J6",
    f"""with {EV} select event_id from ev p where event_type = 'click' and exists (
        select 1 from ev s where s.event_type = 'view' and s.user_id = p.user_id and abs(s.ms - p.ms) <= 600000)""",
)
def covered_within_tolerance(t):
    p = t.ev.filter("event_type = 'click'")
    return asof.covered_within(p, t.ev.filter("event_type = 'view'"), ["user_id"], "ms", 600_000.0).select("event_id")


@query(
    "boundary_lookup",
    "J5e O11",
    f"""with {EV}, pt as (select user_id, k, max(value) as y from ev where event_type = 'view' group by all),
    pr as (select event_id, user_id, k + 0.5 as x from ev where event_type = 'click'),
    l as (select pr.*, pt.k as lk, pt.y as ly from pr asof join pt on pr.user_id = pt.user_id and pr.x >= pt.k),
    b as (select l.*, pt.k as rk, pt.y as ry from l asof join pt on l.user_id = pt.user_id and l.x < pt.k)
    select event_id, round(ly * (1 - (x - lk) / (rk - lk)) + ry * ((x - lk) / (rk - lk)), 6) as height from b""",
)
def boundary_lookup(t):
    points = t.ev.filter("event_type = 'view'").select("user_id", F.col("k").cast("double").alias("x"), F.col("value").alias("y"))
    probes = t.ev.filter("event_type = 'click'").select("event_id", "user_id", (F.col("k") + 0.5).alias("x"))
    out = asof.boundary_at(points, probes, ["user_id"], "x", "y").filter("y is not null")
    return out.select("event_id", r6("y").alias("height"))


_M = sql_mul("m", "q")


@query(
    "orientation_priors",
    "J7 Q15 Q4",
    BRACKET.replace("p.ts >= s.ts", "p.ts + 1500.0 >= s.ts").replace("l.ts < s.ts", "l.ts + 1500.0 < s.ts").replace(
        "(ts - lt) / (rt - lt)", "(ts + 1500.0 - lt) / (rt - lt)"
    )
    + f""", g as (select source, pos, {', '.join(f'{x} / {_N} as q{c}' for x, c in zip(_S, 'wxyz'))}, 0.5 as mw, 0.5 as mx, 0.5 as my, 0.5 as mz
         from f where lt is not null and rt is not null)
    select source, pos, {', '.join(f'round({x}, 6) as {c}' for x, c in zip(_M, 'wxyz'))} from g""",
)
def orientation_priors(t):
    out = asof.orientation_priors(t.series("click").drop("q"), t.series("view"), ["source"], 1500.0, (0.5, 0.5, 0.5, 0.5))
    return out.select("source", "pos", *[r6(F.get("q", F.lit(i))).alias(c) for i, c in enumerate("wxyz")])


@query(
    "rolling_shutter_rows",
    "J7b S12",
    f"""with {EV}, s as (select user_id as source, ms as ts from ev where event_type = 'view'),
    p as (select user_id as source, event_id as pos, ms + i / 3.0 * 30000 + 10.0 as ts, i from ev, range(4) r(i) where event_type = 'click'),
    l as (select p.*, s.ts as lt from p asof left join s on p.source = s.source and p.ts >= s.ts),
    b as (select l.*, s.ts as rt from l asof left join s on l.source = s.source and l.ts < s.ts)
    select source, pos, count(*) as n_rows, count(*) filter (lt is not null and rt is not null or lt = ts) as covered from b group by all""",
)
def rolling_shutter_rows(t):
    rows = asof.row_samples(t.series("click").drop("q"), t.series("view"), ["source"], 4, 30_000.0, 10.0)
    return rows.groupBy("source", "pos").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("covered").alias("covered"))


# times that repeat, go back or are missing, and attitudes that are not valid, made of the clean table
BROKEN = """bad as (select user_id as source, event_id as pos,
    case when event_id % 41 = 0 then null when event_id % 37 = 0 then ms - 864000000.0 else floor(ms / 1000000) * 1000000 end as ts,
    case when event_id % 29 = 0 then 0.0 else cos(value * 0.01) end as w, case when event_id % 29 = 0 then 0.0 else sin(value * 0.01) end as x from ev)"""


def broken(t):
    ts = (
        F.when(F.col("event_id") % 41 == 0, F.lit(None))
        .when(F.col("event_id") % 37 == 0, F.col("ms") - 864000000.0)
        .otherwise(F.floor(F.col("ms") / 1000000) * 1000000.0)
    )
    zero = F.col("event_id") % 29 == 0
    h = F.col("value") * 0.01
    q = F.array(F.when(zero, 0.0).otherwise(F.cos(h)), F.when(zero, 0.0).otherwise(F.sin(h)), F.lit(0.0), F.lit(0.0))
    return t.ev.select(F.col("user_id").alias("source"), F.col("event_id").alias("pos"), ts.alias("ts"), q.alias("q"))


@query(
    "attitude_diagnostics",
    "A5 W2",
    f"""with {EV}, {BROKEN},
    m as (select *, ts is not null and w * w + x * x > 0 as ok from bad),
    g as (select *, last_value(ts ignore nulls) over (partition by source order by pos rows between unbounded preceding and 1 preceding) as pt,
                 last_value(case when ok then w end ignore nulls) over (partition by source order by pos rows between unbounded preceding and 1 preceding) as pw,
                 last_value(case when ok then x end ignore nulls) over (partition by source order by pos rows between unbounded preceding and 1 preceding) as px from m)
    select source, count(*) as total, count_if(ok) as valid, count_if(not ok) as invalid, count_if(ts is null) as non_finite_ts,
           count_if(ts < pt) as backward, count_if(ts = pt) as duplicate,
           count_if(ok and pw is not null and degrees(2 * acos(least(abs(w * pw + x * px), 1.0))) > 90) as jumps,
           round(max(case when ok then ts end) - min(case when ok then ts end), 3) as duration_ms from g group by source""",
)
def attitude_diagnostics(t):
    out = motion.attitude_diagnostics(broken(t), ["source"])
    cols = ["source", "total", "valid", "invalid", "non_finite_ts", "backward", "duplicate", "jumps"]
    return out.select(*cols, F.round("duration_ms", 3).alias("duration_ms"))


@query(
    "timeline_last_wins",
    "O6",
    f"""with {EV}, {BROKEN}, r as (select *, row_number() over (partition by source, ts order by pos desc) as last,
        row_number() over (partition by source, ts order by pos) as first from bad where ts is not null)
    select source, round(ts, 3) as ts, max(case when last = 1 then pos end) as last_pos, max(case when first = 1 then pos end) as first_pos
    from r group by all""",
)
def timeline_last_wins(t):
    rows = broken(t).filter("ts is not null")
    last = asof.last_per_timestamp(rows, ["source"], "ts", "pos").select("source", "ts", F.col("pos").alias("last_pos"))
    first = asof.last_per_timestamp(rows, ["source"], "ts", "pos", first=True).select("source", "ts", F.col("pos").alias("first_pos"))
    return last.join(first, ["source", "ts"]).withColumn("ts", F.round("ts", 3))


@query(
    "gap_segments",
    "W6 ST7",
    f"""with {EV}, g as (select user_id, ms, case when ms - lag(ms) over (partition by user_id order by ms) > 7200000 then 1 else 0 end as n from ev),
    s as (select *, sum(n) over (partition by user_id order by ms) as segment from g)
    select user_id, cast(segment as bigint) as segment, count(*) as events, round(max(ms) - min(ms), 3) as ms from s group by all""",
)
def gap_segments(t):
    out = motion.gap_segments(t.ev, ["user_id"], "ms", 7_200_000.0)
    return out.groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("events"), F.round(F.max("ms") - F.min("ms"), 3).alias("ms"))


@query(
    "sampling_grid",
    "W11",
    f"""with {EV}, r as (select user_id, min(ms) as lo, max(ms) as hi from ev group by 1),
    n as (select *, least(floor((hi - lo) / 1000.0), 100000) as n from r)
    select user_id, cast(least(ceil((hi - lo) / 1000.0), 100000) + 1 as bigint) as points, round(lo, 3) as first_ms from n""",
)
def sampling_grid(t):
    ranges = t.ev.groupBy("user_id").agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))
    grid = motion.sampling_grid(ranges.withColumn("rate_hz", F.lit(0.01)), ["user_id"])
    return grid.groupBy("user_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.min("ts"), 3).alias("first_ms"))


@query(
    "stride_subsample",
    "W12",
    f"""with {EV}, r as (select *, row_number() over (partition by user_id order by ms) - 1 as i, count(*) over (partition by user_id) as n from ev)
    select user_id, event_id from r where i % greatest(n // 16, 1) = 0""",
)
def stride_subsample(t):
    return motion.every_nth(t.ev, ["user_id"], "ms", 16).select("user_id", "event_id")


@query(
    "upper_median",
    "A1c",
    f"""with {EV}, s as (select user_id, list_sort(list(value)) as v from ev group by 1)
    select user_id, case when len(v) >= 16 then v[len(v) // 2 + 1] end as value from s""",
)
def upper_median(t):
    return motion.upper_median(t.ev, ["user_id"], "value")


@query(
    "offset_scores",
    "A10 Q23 O7 W1",
    f"""with {EV}, {series_sql('view', 's')}, {SPEED}, v as (select * from sp),
    st2 as (select user_id as source, ms as ts, lag(ms) over w as pt, cos(value*0.01) as qw, case when k % 3 = 0 then sin(value*0.01) else 0.0 end as qx,
        case when k % 3 = 1 then sin(value*0.01) else 0.0 end as qy, case when k % 3 = 2 then sin(value*0.01) else 0.0 end as qz,
        lag(cos(value*0.01)) over w as pw, lag(case when k % 3 = 0 then sin(value*0.01) else 0.0 end) over w as px,
        lag(case when k % 3 = 1 then sin(value*0.01) else 0.0 end) over w as py, lag(case when k % 3 = 2 then sin(value*0.01) else 0.0 end) over w as pz
        from ev where event_type = 'click' window w as (partition by user_id order by ms)),
    tl as (select source, (pt + ts) * 0.5 as ts, {sql_angle('q', 'p')} * 1000.0 / (ts - pt) as dps from st2 where ts - pt > 2.220446049250313e-16),
    g as (select v.source, v.ts + o * 3600000.0 as ts, v.dps as vd, o * 3600000.0 as off from v, range(-2, 3) r(o)),
    l as (select g.*, tl.ts as lt, tl.dps as ld from g asof join tl on g.source = tl.source and g.ts >= tl.ts),
    b as (select l.*, tl.ts as rt, tl.dps as rd from l asof join tl on l.source = tl.source and l.ts < tl.ts),
    m as (select source, off, vd, ld * (1 - (ts - lt) / (rt - lt)) + rd * ((ts - lt) / (rt - lt)) as td from b)
    select source, off as offset_ms, count(*) as pairs, case when count(*) >= 2 and var_pop(vd) * var_pop(td) > 0 then round(corr(vd, td), 6) end as correlation
    from m group by all having count(*) >= 3""",
)
def offset_scores(t):
    config = calibration.Config(offset_min_ms=-7_200_000.0, offset_max_ms=7_200_000.0, offset_step_ms=3_600_000.0)
    out = calibration.offset_scores(t.series("view"), t.series("click"), ["source"], config).filter("pairs >= 3")
    return out.select("source", "offset_ms", "pairs", r6("correlation").alias("correlation"))


@query("calibration_model", "Q11 Q12 Q13 Q14 W10 O9 A11 A13 A14")
def calibration_model(t):
    """A telemetry series made from the visual one by a fixed rotation and a shift of 80 ms, found again."""
    turn = Q.lit(0.9004471023526769, 0.13056, -0.34815, 0.17408)
    i = F.col("i").cast("double")
    axis = Q.normalize((F.sin(0.31 * i), F.cos(0.23 * i), F.sin(0.17 * i + 1)))
    angle = F.radians(12 * F.sin(0.42 * i) + 7 * F.cos(0.17 * i) + 9 * F.sin(0.05 * i)) / 2
    made = t.ev.select("user_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(119))))
    q = (F.cos(angle), *[F.sin(angle) * a for a in axis])
    tele = made.select(F.col("user_id").alias("source"), (F.col("i") * 40.0 + 80.0).alias("ts"), F.col("i").cast("long").alias("pos"), Q.pack(q).alias("q"))
    vis = Q.multiply(Q.normalize(turn), q)
    visual = made.select(F.col("user_id").alias("source"), (F.col("i") * 40.0).alias("ts"), F.col("i").cast("long").alias("pos"), Q.pack(vis).alias("q"))
    out = calibration.calibrate(visual, tele, ["source"], calibration.Config())
    off = Q.angle_degrees(Q.of("x"), Q.normalize(turn))
    return out.select(
        "source", "valid", "problem", "offset_ms", "convention", F.round("correlation", 6).alias("correlation"),
        F.round("residual_deg", 6).alias("residual_deg"), (off < 0.01).alias("recovered"),
    )


@query("keyframe_pruning", "W9 Q21 Q22 STR19 ST6")
def keyframe_pruning(t):
    proxy = F.array(F.col("value") % 256, (F.col("value") * 3) % 256).cast("array<double>")
    frames = t.ev.select(
        F.col("user_id").alias("source"), F.col("event_id").alias("seq"), (F.col("ms") / 10_000).alias("ts"),
        F.when(F.col("k") % 7 != 0, F.expr("array(cos(value * 0.01), sin(value * 0.01), 0D, 0D)")).alias("q"), proxy.alias("proxy"),
    )
    out = selection.prune_keyframes(frames, ["source"], selection.Pruning())
    return out.select("source", "seq", "kept", "reason", r6("rotation_deg").alias("rotation_deg"), r6("novelty").alias("novelty"))


@query("gyro_integration", "W7 Q9")
def gyro_integration(t):
    g = F.array(F.col("value") % 20 - 10, F.col("k") % 15 - 7.0, F.lit(3.0))
    imu = t.ev.select(F.col("user_id").alias("source"), F.row_number().over(Window.partitionBy("user_id").orderBy("ms")).alias("pos"), g.alias("gyro"))
    imu = imu.withColumn("ts", F.col("pos") * 10.0).withColumn("pos", F.col("pos").cast("long"))
    out = motion.integrate_gyro(imu, ["source"])
    return out.select("source", "ts", *[r6(F.get("q", F.lit(i))).alias(c) for i, c in enumerate("wxyz")], "gaps", "duplicate", "problem")


@query("gravity_fusion", "W5 W8")
def gravity_fusion(t):
    n = 301
    dealt = motion.extent(t.ev.groupBy(F.col("event_id").alias("source")).agg((F.count(F.lit(1)) * n).alias("rows")))
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")
    # sources are dealt before their samples are made, which so stay where they are
    imu = t.ev.select(F.col("event_id").alias("source"), "value").repartition(dealt[0], "source").select("source", "value", i)
    a = F.array(F.lit(0.0), 0.3 * F.sin(F.col("i") + F.col("value")), F.lit(9.81))
    imu = imu.select("source", (F.col("i") * 10.0).alias("ts"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("gyro"), a.alias("accl"))
    out = motion.fuse_gravity(imu, ["source"], dealt=dealt)
    down = F.get("v", F.lit(2))
    out = out.groupBy("source").agg(F.count(F.lit(1)).alias("samples"), F.max("corrections").alias("corrections"), r6(F.max(down)).alias("z"))
    return materialize(out, "gravity", narrow=True)


@query(
    "temporal_links",
    "W15",
    f"""with {EV}, w as (select user_id, event_id, lead(event_id, 1) over (partition by user_id order by ms) as a,
        lead(event_id, 2) over (partition by user_id order by ms) as b from ev)
    select user_id, event_id as frame_a, a as frame_b, 1 as step from w where a is not null
    union all select user_id, event_id, b, 2 from w where b is not null""",
)
def temporal_links(t):
    w = Window.partitionBy("user_id").orderBy("ms")
    out = t.ev.select("user_id", "event_id", *[F.lead("event_id", n).over(w).alias(f"b{n}") for n in (1, 2)])
    out = out.select("user_id", F.col("event_id").alias("frame_a"), F.explode(F.array(F.struct(F.col("b1").alias("b"), F.lit(1).alias("s")), F.struct(F.col("b2").alias("b"), F.lit(2).alias("s")))).alias("l"))
    return out.select("user_id", "frame_a", F.col("l.b").alias("frame_b"), F.col("l.s").alias("step")).filter("frame_b is not null")


@query(
    "correlation_by_type",
    "A10 A11",
    f"""with {EV} select event_type, case when count(*) >= 2 and var_pop(value) * var_pop(k) > 0 then round(corr(value, k), 6) end as correlation,
        round(sqrt(avg(value * value)), 6) as rms, max(value) as most from ev group by 1
    union all select 'constant', null, 1.0, 1.0""",
)
def correlation_by_type(t):
    from quillon.operators.statistics import rms

    rows = t.ev.select("event_type", "value", F.col("k").cast("double").alias("k"))
    flat = t.ev.select(F.lit("constant").alias("event_type"), F.lit(1.0).alias("value"), F.lit(2.0).alias("k"))
    return rows.unionByName(flat).groupBy("event_type").agg(
        r6(pearson("value", "k")).alias("correlation"), r6(rms("value")).alias("rms"), F.max("value").alias("most")
    )
