"""As-of lookups between time series: bracketing samples, interpolation, tolerance.

A series is dealt by source and by time bucket, so one long source is many
tasks.  What a bucket needs from its neighbours is one sample on each side,
found in a table of one row per source and bucket.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import quaternion as Q
from quillon.functions.numeric import is_finite

BUCKET_MS = 3_600_000.0


def last_per_timestamp(samples: DataFrame, by: list[str], ts: str, order: str, first: bool = False) -> DataFrame:
    """One row for each source and time: the last in source order, or the first."""
    rank = Window.partitionBy(*by, ts).orderBy(F.col(order) if first else F.col(order).desc())
    return samples.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")


def with_previous(
    rows: DataFrame, by: list[str], order: str, values: dict[str, Column], bucket: float, known: bool = False
) -> DataFrame:
    """Adds each value of the row before in order, or with ``known`` the last one before that is not null.

    Rows are dealt by source and bucket of ``order``; the first of a bucket
    takes its value from a table of one row for each source and bucket.
    """
    key = [*by, "_b"]
    held = {f"_v_{n}": F.when(c.isNotNull(), F.struct(c.alias("v"))) if known else F.struct(c.alias("v")) for n, c in values.items()}
    rows = rows.withColumn("_b", F.floor(F.col(order) / bucket)).withColumns(held)
    inside = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({f"_p_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in values})
    edge = rows.groupBy(*key).agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_e_{n}") for n in values])
    behind = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.filter("_b is not null").select(*key, *[F.last(f"_e_{n}", ignorenulls=True).over(behind).alias(f"_e_{n}") for n in values])
    out = own.join(edge, key, "left")
    out = out.withColumns({n: F.coalesce(f"_p_{n}", f"_e_{n}")["v"] for n in values})
    return out.drop("_b", *[f"_{k}_{n}" for k in "vpe" for n in values])


def running_total(rows: DataFrame, by: list[str], order: str, value: Column, out: str, bucket: float, whole: str | None = None,
                  peers: bool = False) -> DataFrame:
    """Adds the sum of ``value`` up to and with each row in order, and the source's sum as ``whole``; dealt as :func:`with_previous`.

    With ``peers`` rows of equal order have the same sum, that with all of them.
    """
    key = [*by, "_b"]
    rows = rows.withColumns({"_b": F.floor(F.col(order) / bucket), "_n": value})
    inside = Window.partitionBy(*key).orderBy(order)
    frame = inside.rangeBetween if peers else inside.rowsBetween
    inside = frame(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.groupBy(*key).agg(F.sum("_n").alias("_s"))
    edge = edge.select(*key, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"), F.sum("_s").over(Window.partitionBy(*by)).alias("_all"))
    got = rows.withColumn(out, F.sum("_n").over(inside)).join(edge, key, "left")
    got = got.withColumn(out, F.col(out) + F.coalesce("_s0", F.lit(0)))
    if whole is not None:
        got = got.withColumn(whole, F.col("_all"))
    return got.drop("_b", "_n", "_s0", "_all")


def bracket(
    samples: DataFrame, probes: DataFrame, by: list[str], ts: str, order: str, value: list[str],
    bucket_ms: float = BUCKET_MS,
) -> DataFrame:
    """Probes with ``before`` and ``after``: the samples on their two sides, as structs of ts, order and values.

    ``before`` is the last sample at or before the probe (of equal times the
    last in source order), ``after`` the first one behind it.  Either is null
    if there is none; samples whose time is not finite are left out, probes of
    such a time have neither.
    """
    cols = [F.col(ts).alias("ts"), F.col(order).alias("pos"), *[F.col(c) for c in value]]
    at = F.floor(F.col(ts) / bucket_ms)
    s = samples.filter(is_finite(ts)).select(
        *by, F.col(ts).cast("double").alias("_t"), F.lit(0).alias("_kind"), F.col(order).cast("long").alias("_o"),
        F.struct(*cols).alias("_s"), at.alias("_b"),
    )
    p = probes.withColumn("_p", F.struct(*probes.columns)).select(
        *by, F.when(is_finite(ts), F.col(ts).cast("double")).alias("_t"), F.lit(1).alias("_kind"),
        F.lit(0).cast("long").alias("_o"), "_p", F.when(is_finite(ts), at).alias("_b"),
    )
    both = s.unionByName(p, allowMissingColumns=True)
    key = [*by, "_b"]
    up = Window.partitionBy(*key).orderBy("_t", "_kind", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = (
        Window.partitionBy(*key)
        .orderBy(F.col("_t").desc(), F.col("_kind").desc(), F.col("_o").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    own = both.withColumns(
        {"_l": F.last("_s", ignorenulls=True).over(up), "_r": F.last("_s", ignorenulls=True).over(down)}
    ).filter("_kind = 1")
    # one row per bucket: its outermost samples, then those of the buckets around it
    edge = both.groupBy(*key).agg(
        F.max_by("_s", F.when(F.col("_s").isNotNull(), F.struct("_t", "_o"))).alias("_hi"),
        F.min_by("_s", F.when(F.col("_s").isNotNull(), F.struct("_t", F.col("_o")))).alias("_lo"),
    )
    behind = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*by).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.filter("_b is not null").select(
        *key, F.last("_hi", ignorenulls=True).over(behind).alias("_hi"), F.last("_lo", ignorenulls=True).over(ahead).alias("_lo")
    )
    out = own.join(edge, key, "left")
    timed = F.col("_t").isNotNull()
    return out.select(
        "_p.*",
        F.when(timed, F.coalesce("_l", "_hi")).alias("before"),
        F.when(timed, F.coalesce("_r", "_lo")).alias("after"),
    )


def gather(
    samples: DataFrame, probes: DataFrame, by: list[str], reach: tuple[float, float] = (0.0, 0.0), bucket_ms: float = BUCKET_MS,
) -> DataFrame:
    """A row for each source and bucket of time with probes: (by, bucket, buckets, probes, samples), arrays of structs.

    ``samples`` holds, in no order, what probes of the bucket can ask for at
    their times plus a shift within ``reach``: the samples of that span and the
    nearest one on each side of it.  ``buckets`` counts the source's rows.  Both
    sides are (by, ts, doubles); rows whose time is not finite are left out.
    """
    key = [*by, "_b"]
    slack = bucket_ms * 1e-6  # for the rounding of sums of times

    def at(shift: float) -> Column:
        return F.floor((F.col("ts") - F.lit(shift)) / bucket_ms)

    def packed(df: DataFrame) -> Column:
        return F.struct("ts", *[c for c in df.columns if c not in (*by, "ts")])

    s = samples.filter(is_finite("ts")).select(
        *by, packed(samples).alias("_s"), at(reach[1] + slack).alias("_from"), at(reach[0] - slack).alias("_to")
    )
    s = s.withColumn("_b", F.explode(F.sequence("_from", "_to")))
    p = probes.filter(is_finite("ts")).select(*by, packed(probes).alias("_p"), at(0.0).alias("_b"))
    both = s.unionByName(p, allowMissingColumns=True).repartition(*key)  # dealt once for both aggregates
    own = both.groupBy(*key).agg(F.collect_list("_p").alias("probes"), F.collect_list("_s").alias("samples"))
    # a sample lies in the buckets of _from .. _to: behind _to it is a neighbour on the left, before _from on the right
    edge = both.groupBy(*key).agg(
        F.max(F.when(F.col("_b") == F.col("_to"), F.col("_s"))).alias("_hi"),
        F.min(F.when(F.col("_b") == F.col("_from"), F.col("_s"))).alias("_lo"),
        F.max(F.col("_p").isNotNull().cast("int")).alias("_has"),
    )
    behind = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*by).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(
        *key, F.last("_hi", ignorenulls=True).over(behind).alias("_hi"), F.last("_lo", ignorenulls=True).over(ahead).alias("_lo"),
        F.sum("_has").over(Window.partitionBy(*by)).alias("buckets"),
    )
    right = edge.withColumnsRenamed({c: f"_k_{c}" for c in key})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key])
    out = own.filter(F.size("probes") > 0).join(right, same)
    return out.select(
        *by, F.col("_b").cast("double").alias("bucket"), "buckets", "probes",
        F.concat(F.array_compact(F.array("_hi", "_lo")), "samples").alias("samples"),
    )


def _fraction(ts: str) -> tuple[Column, Column, Column]:
    """Whether the probe hits ``before`` exactly, the gap of its bracket, and its place in it."""
    exact = F.col("before.ts") == F.col(ts)
    gap = F.col("after.ts") - F.col("before.ts")
    return exact, gap, F.try_divide(F.col(ts) - F.col("before.ts"), gap)


def attitude_at(samples: DataFrame, probes: DataFrame, by: list[str], ts: str = "ts", order: str = "pos",
                q: str = "q", max_gap_ms: float | None = None) -> DataFrame:
    """Probes with ``q``: the attitude by shortest-path interpolation, never extrapolated.

    A probe at a sample's time has that sample, whatever the gaps.  Else it
    needs samples on both sides, no further apart than ``max_gap_ms``.
    Samples without a valid quaternion are left out first.
    """
    valid = Q.staged(samples, q, Q.of(q), *Q.unit_steps(4)).filter(F.get(F.col(q), F.lit(0)).isNotNull())
    out = bracket(valid, probes, by, ts, order, [q])
    exact, gap, t = _fraction(ts)
    near = F.lit(True) if max_gap_ms is None else gap <= max_gap_ms
    out = out.withColumn("_mixed", Q.slerp_array(Q.of(F.col(f"before.{q}")), Q.of(F.col(f"after.{q}")), t))
    inside = F.when(near, F.col("_mixed"))
    return out.withColumn(q, F.when(exact, F.col(f"before.{q}")).otherwise(inside)).drop("before", "after", "_mixed")


def direction_at(samples: DataFrame, probes: DataFrame, by: list[str], ts: str = "ts", order: str = "pos",
                 v: str = "v", max_gap_ms: float = 100.0) -> DataFrame:
    """As :func:`attitude_at` for directions, interpolated linearly and made unit length."""
    out = bracket(samples.filter(F.col(v).isNotNull()), probes, by, ts, order, [v])
    exact, gap, t = _fraction(ts)
    out = out.withColumn("_mixed", Q.nlerp_array(Q.of(F.col(f"before.{v}"), 3), Q.of(F.col(f"after.{v}"), 3), t))
    inside = F.when(gap <= max_gap_ms, F.col("_mixed"))
    return out.withColumn(v, F.when(exact, F.col(f"before.{v}")).otherwise(inside)).drop("before", "after", "_mixed")


def value_at(samples: DataFrame, probes: DataFrame, by: list[str], ts: str = "ts", order: str = "pos",
             x: str = "x") -> DataFrame:
    """As :func:`attitude_at` for numbers; a series of one sample is only met exactly."""
    out = bracket(samples.filter(F.col(x).isNotNull()), probes, by, ts, order, [x])
    exact, _, t = _fraction(ts)
    mixed = F.col(f"before.{x}") * (1 - t) + F.col(f"after.{x}") * t
    return out.withColumn(x, F.when(exact, F.col(f"before.{x}")).otherwise(mixed)).drop("before", "after")


def covered_within(probes: DataFrame, samples: DataFrame, by: list[str], ts: str, tolerance: float) -> DataFrame:
    """The probes with a sample within ``tolerance``: an equi-join on time buckets, then the exact test."""
    bucket = F.floor(F.col(ts) / tolerance)
    near = samples.filter(is_finite(ts)).select(
        *[F.col(c).alias(f"_{c}") for c in by], F.col(ts).alias("_ts"), bucket.alias("_b")
    )
    near = near.withColumn("_b", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)))
    same = bucket == F.col("_b")
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return probes.join(near, same & (F.abs(F.col(ts) - F.col("_ts")) <= tolerance), "left_semi")


def boundary_at(points: DataFrame, probes: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Probes with the height of a polyline at their x; null outside its range.

    Points that repeat an x count with their largest y.
    """
    line = points.groupBy(*by, x).agg(F.max(y).alias(y)).withColumn("_o", F.lit(0))
    return value_at(line, probes, by, ts=x, order="_o", x=y)


def row_samples(frames: DataFrame, samples: DataFrame, by: list[str], n_rows: int, readout_ms: float,
                offset_ms: float = 0.0, max_gap_ms: float | None = None) -> DataFrame:
    """Attitudes at ``n_rows`` evenly spaced rows of each frame's readout; rows without one stay, uncovered."""
    row = F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))
    rows = frames.withColumnRenamed("ts", "frame_ts").withColumn("row", row)
    rows = rows.withColumn("row_fraction", F.col("row") / F.lit(float(max(n_rows - 1, 1))))
    rows = rows.withColumn("image_ts", F.col("frame_ts") + F.col("row_fraction") * readout_ms)
    rows = rows.withColumn("ts", F.col("image_ts") + offset_ms)
    out = attitude_at(samples, rows, by, max_gap_ms=max_gap_ms)
    return out.withColumn("covered", F.col("q").isNotNull())


def orientation_priors(frames: DataFrame, samples: DataFrame, by: list[str], offset_ms: float,
                       mount: tuple[float, float, float, float], inverted: bool = False,
                       max_gap_ms: float | None = None) -> DataFrame:
    """Frames with the calibrated attitude at their time plus the offset; frames without one are dropped."""
    probes = frames.withColumn("frame_ts", F.col("ts")).withColumn("ts", F.col("ts") + offset_ms)
    out = attitude_at(samples, probes, by, max_gap_ms=max_gap_ms).filter(F.col("q").isNotNull())
    out = Q.staged(out, "q", Q.of("q"), lambda q: Q.calibrated(Q.lit(*mount), q, inverted), *Q.unit_steps(4))
    return out.withColumn("ts", F.col("frame_ts")).drop("frame_ts")
