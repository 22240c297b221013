"""Ordered analyses of orientation and inertial series."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby, islice
from math import acos, cos, degrees, isfinite, radians, sin, sqrt
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillon.functions import quaternion as Q
from quillon.functions.numeric import is_finite
from quillon.operators import asof
from quillon.operators.statistics import exact_ranks
from quillon.storage import materialize

#: Spans of time, and of source order, that a task holds of one source at a time.
BUCKET_MS = 86_400_000.0
BUCKET_ROWS = 65_536
#: The span of time of one inertial task, and the rows it gives out at a time.
FOLD_MS = 3_600_000.0
FOLD_ROWS = 8192
#: Rows of segments or sources that are folded in step, and rows above which a segment is folded by itself, a source by segments.
STEP_ROWS = 262_144
STEP_LONG = 32_768
#: Rows of short sources that a task is meant to get, and long sources above which their list is not broadcast.
TASK_ROWS = 1_048_576
FEW_SOURCES = 10_000
#: Fixed values of the inertial rules.
GAP_WARNING_MS = 100.0
GAP_LIMIT_MS = 2000.0
LOWPASS_S = 0.25
WARMUP_S = 1.0
MAGNITUDE = (2.0, 50.0)
MAGNITUDE_RATIO = (0.65, 1.35)
INLIER_DEGREES = 35.0
RMS_DEGREES = 15.0
MIN_SAMPLES = 16
JUMP_DEGREES = 90.0
SIGNS = (-1.0, 1.0)
IDENTITY = (1.0, 0.0, 0.0, 0.0)
FUSED = "ts double, v array<double>, corrections long, rms_deg double, gyro_sign double"


def angular_speed(samples: DataFrame, by: list[str], ts: str = "ts", q: str = "q") -> DataFrame:
    """Angle and speed between consecutive samples, stamped at the middle; steps of no time are skipped."""
    out = asof.with_previous(samples, by, ts, {"_t": F.col(ts), "_q": F.col(q)}, BUCKET_MS)
    dt = F.col(ts) - F.col("_t")
    out = out.filter(dt > Q.EPS_TELEMETRY).withColumn("angle_deg", Q.angle_degrees(Q.of("_q"), Q.of(q)))
    speed = F.col("angle_deg") * 1000.0 / dt
    return out.select(*by, ((F.col("_t") + F.col(ts)) * 0.5).alias("ts"), "angle_deg", speed.alias("speed_dps"))


def excitation(steps: DataFrame, by: list[str]) -> DataFrame:
    return steps.groupBy(*by).agg(F.sum("angle_deg").alias("excitation_deg"), F.count(F.lit(1)).alias("steps"))


def attitude_diagnostics(samples: DataFrame, by: list[str], ts: str = "ts", order: str = "pos", q: str = "q") -> DataFrame:
    """Counts, range, rate and jumps of each series, in source order.

    A time is compared with the last finite one before it, an attitude with the
    last valid one.
    """
    rows = samples.withColumn("_t", F.when(is_finite(ts), F.col(ts).cast("double")))
    rows = Q.staged(rows, "_u", Q.of(q), *Q.unit_steps(4))
    rows = rows.withColumn("_u", F.when(F.col("_t").isNotNull() & F.get("_u", F.lit(0)).isNotNull(), F.col("_u")))
    rows = asof.with_previous(rows, by, order, {"_pt": F.col("_t"), "_pu": F.col("_u")}, BUCKET_ROWS, known=True)
    both = F.col("_u").isNotNull() & F.col("_pu").isNotNull()
    rows = rows.withColumn("_step", F.when(both, Q.angle_degrees(Q.of("_u"), Q.of("_pu"))))
    valid = F.col("_u").isNotNull()
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(valid).alias("valid"),
        F.count_if(~valid).alias("invalid"),
        F.count_if(F.col("_t").isNull()).alias("non_finite_ts"),
        F.count_if(F.col("_t") < F.col("_pt")).alias("backward"),
        F.count_if(F.col("_t") == F.col("_pt")).alias("duplicate"),
        F.count_if(F.col("_step") > JUMP_DEGREES).alias("jumps"),
        F.max("_step").alias("max_step_deg"),
        F.min(F.when(valid, F.col("_t"))).alias("first_ms"),
        F.max(F.when(valid, F.col("_t"))).alias("last_ms"),
    )
    out = out.withColumn("duration_ms", F.col("last_ms") - F.col("first_ms"))
    rate = F.when((F.col("valid") > 1) & (F.col("duration_ms") > 0), (F.col("valid") - 1) * 1000.0 / F.col("duration_ms"))
    return out.withColumn("rate_hz", rate)


def gap_segments(samples: DataFrame, by: list[str], ts: str, gap_ms: float = GAP_WARNING_MS) -> DataFrame:
    """Adds ``segment``: its number grows where the step to the sample before is above the gap."""
    return _segments(samples, by, ts, gap_ms, BUCKET_MS).drop("_before")


def _segments(samples: DataFrame, by: list[str], ts: str, gap_ms: float, bucket: float) -> DataFrame:
    """``segment``, the same for rows of equal time, and ``_before``, the time of the sample before."""
    rows = asof.with_previous(samples, by, ts, {"_before": F.col(ts)}, bucket)
    new = F.when(F.col(ts) - F.col("_before") > gap_ms, 1).otherwise(0)
    return asof.running_total(rows, by, ts, new, "segment", bucket, peers=True)


def sampling_grid(ranges: DataFrame, by: list[str], most: int = 100_001) -> DataFrame:
    """Times from first_ms to last_ms, both included, at rate_hz held to 1 .. 200 Hz.

    A range that needs more than ``most`` points gets that many at wider steps.
    """
    step = F.lit(1000.0) / F.least(F.greatest(F.coalesce("rate_hz", F.lit(1.0)), F.lit(1.0)), F.lit(200.0))
    span = F.col("last_ms") - F.col("first_ms")
    wanted = F.ceil(span / step)
    rows = ranges.withColumns({"_n": F.least(wanted, F.lit(most - 1)), "_s": F.when(wanted >= most, span / (most - 1)).otherwise(step)})
    return rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), "_n"))).select(
        *by, "i", F.least(F.col("first_ms") + F.col("i") * F.col("_s"), "last_ms").alias("ts")
    )


def every_nth(samples: DataFrame, by: list[str], ts: str, most: int) -> DataFrame:
    """Each n-th sample, n = count div ``most`` (at least 1), from the first."""
    rows = asof.running_total(samples, by, ts, F.lit(1).cast("long"), "_i", BUCKET_MS, whole="_count")
    n = F.greatest(F.call_function("div", F.col("_count"), F.lit(most).cast("long")), F.lit(1))
    return rows.filter((F.col("_i") - 1) % n == 0).drop("_i", "_count")


def upper_median(rows: DataFrame, by: list[str], value: str, least: int = MIN_SAMPLES) -> DataFrame:
    """sorted[n div 2] of each group, null below ``least`` values."""
    return exact_ranks(rows, by, {value: F.col(value)}, upper_least=least).select(*by, F.col(f"{value}_upper").alias(value))


# ------------------------------------------------------------ ordered folds


def _folded(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], fold, schema: str) -> DataFrame:
    """``fold`` over the rows of each key, in order: it is given an iterator of tuples of ``columns`` and yields tuples of ``schema``.

    A task reads its keys one after the other and holds a batch of rows at a time.
    """
    named = rows.select(*keys, *order, *[c for c in columns if c not in order])
    place = {c: i for i, c in enumerate(named.columns)}
    picked = [place[c] for c in columns]
    k = len(keys)
    types = StructType([named.schema[c] for c in keys] + StructType.fromDDL(schema).fields)
    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        out = (
            (*key, *made)
            for key, group in groupby(every, key=lambda r: r[:k])
            for made in fold(tuple(r[i] for i in picked) for r in group)
        )
        while part := list(islice(out, FOLD_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)

    return named.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, types)


def _starts(batch: pa.RecordBatch, k: int) -> np.ndarray:
    """Marks the rows whose first ``k`` columns are not those of the row before."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for c in batch.columns[:k]:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    return new


def _stretches(batches: Iterator[pa.RecordBatch], k: int):
    """(key, rows) of stretches of rows with equal values in the first ``k`` columns, none longer than a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = [*np.flatnonzero(_starts(batch, k)).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:]):
            part = batch.slice(a, b - a)
            yield tuple(c[0].as_py() for c in part.columns[:k]), part


def _folded_in_step(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], fold, step, schema: str) -> DataFrame:
    """As :func:`_folded`, for keys without nulls: the short ones among them are folded in step, arrays over many keys.

    ``step`` is given ``columns`` as Arrow arrays and the bounds of the keys in
    them, and returns the key of each row that it makes and the rows' columns.
    Keys of more than ``STEP_LONG`` rows go through ``fold``, a row at a time.
    """
    named = rows.select(*keys, *order, *[c for c in columns if c not in order])
    place = {c: i for i, c in enumerate(named.columns)}
    picked = [place[c] for c in columns]
    k = len(keys)
    types = StructType([named.schema[c] for c in keys] + StructType.fromDDL(schema).fields)
    arrow = to_arrow_schema(types)

    def together(held: list[list[pa.RecordBatch]]) -> pa.RecordBatch:
        table = pa.Table.from_batches([b for group in held for b in group]).combine_chunks()
        bounds = np.concatenate(([0], np.cumsum([sum(b.num_rows for b in group) for group in held])))
        cols = [c.chunk(0) for c in table.columns]
        of, made = step([cols[i] for i in picked], bounds)
        at = pa.array(bounds[:-1][of])
        out = [*[c.take(at) for c in cols[:k]], *[pa.array(c, f.type) for c, f in zip(made, list(arrow)[k:])]]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for key, parts in groupby(_stretches(batches, k), key=lambda p: p[0]):
            parts = (p for _, p in parts)
            group, n = [], 0
            for p in parts:
                group.append(p)
                n += p.num_rows
                if n > STEP_LONG:
                    break
            if n <= STEP_LONG:
                held.append(group)
                size += n
                if size >= STEP_ROWS:
                    yield together(held)
                    held, size = [], 0
                continue
            every = (r for b in chain(group, parts) for r in zip(*[b.column(i).to_pylist() for i in picked]))
            out = ((*key, *made) for made in fold(every))
            while part := list(islice(out, FOLD_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)
        if held:
            yield together(held)

    return named.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, types)


def _with(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on ``keys`` in which null meets null."""
    right = other.withColumnsRenamed({c: f"_k_{c}" for c in keys})
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])
    return rows.join(right, on, how).drop(*[f"_k_{c}" for c in keys])


def _finite(v) -> bool:
    return v is not None and len(v) == 3 and all(x is not None and isfinite(x) for x in v)


def _cross(a, b) -> tuple[float, float, float]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _dot(a, b) -> float:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _mix(a, b, k: float) -> tuple[float, float, float]:
    return tuple(x * (1 - k) + y * k for x, y in zip(a, b))


def _unit(v) -> tuple:
    size = sqrt(sum(x * x for x in v))
    return tuple(x / size for x in v)


def product(a, b) -> np.ndarray:
    """The product of two quaternions, scalar first."""
    return np.array(_product(tuple(a), tuple(b)))


def _product(a, b) -> tuple[float, float, float, float]:
    c = _cross(a[1:], b[1:])
    return a[0] * b[0] - _dot(a[1:], b[1:]), *[a[0] * b[i] + b[0] * a[i] + c[i - 1] for i in (1, 2, 3)]


def _rotation(before, after, ms: float) -> tuple[float, float, float, float]:
    """The turn of a step between two rates in degrees per second, by their mean."""
    omega = [radians((x + y) / 2) for x, y in zip(before, after)]
    speed = sqrt(_dot(omega, omega))
    if not speed > Q.EPS_TELEMETRY:
        return IDENTITY
    half = speed * ms / 1000 / 2
    return cos(half), *[x * (sin(half) / speed) for x in omega]


def integrate_gyro(samples: DataFrame, by: list[str], ts: str = "ts", order: str = "pos", gyro: str = "gyro") -> DataFrame:
    """Relative attitude from degrees per second by the trapezoid rule, and the series' gap counts.

    Rows that are not finite are left out; of equal times the first counts.  A
    source with a step above two seconds, or fewer than two samples, has no
    rows but one with ``problem``.

    Turns are multiplied within buckets of time first, then the buckets of a
    source in order, so a long source is many tasks.
    """
    rate = F.col(gyro).cast("array<double>")
    good = is_finite(ts) & (F.size(rate) == 3) & F.forall(rate, lambda x: F.coalesce(is_finite(x), F.lit(False)))
    rows = samples.select(*by, F.col(order).alias("_o"), F.when(good, F.col(ts).cast("double")).alias("ts"), rate.alias("_g"))
    in_order = asof.with_previous(rows, by, "_o", {"_pt": F.col("ts")}, BUCKET_ROWS, known=True)
    counts = in_order.groupBy(*by).agg(
        F.count_if(F.col("ts") < F.col("_pt")).alias("backward"), F.count_if(F.col("ts") == F.col("_pt")).alias("duplicate")
    )
    first = rows.filter("ts is not null").groupBy(*by, "ts").agg(F.min(F.struct("_o", "_g")).alias("_f"))
    first = first.select(*by, "ts", F.col("_f._g").alias("_g"))
    steps = asof.with_previous(first, by, "ts", {"_pt": F.col("ts"), "_pg": F.col("_g")}, FOLD_MS)
    steps = steps.withColumn("_b", F.floor(F.col("ts") / FOLD_MS))
    dt = F.col("ts") - F.col("_pt")
    spans = steps.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count_if(dt > GAP_WARNING_MS).alias("_gaps"), F.max(dt).alias("_longest"))
    problem = F.when(F.coalesce("_n", F.lit(0)) < 2, "too few samples").when(F.col("_longest") > GAP_LIMIT_MS, "gap too long")
    counts = _with(counts, spans, by, "left").select(
        *by, "backward", "duplicate", F.coalesce("_gaps", F.lit(0).cast("long")).alias("gaps"), problem.alias("problem")
    )

    def whole(group):
        q = IDENTITY
        for t, g, pt, pg in group:
            if pt is not None:
                q = _unit(_product(q, _rotation(pg, g, t - pt)))
        yield (list(q),)

    def chain(group):
        q = IDENTITY
        for b, turn in group:
            yield b, list(q)
            q = _unit(_product(q, turn))

    def each(group):
        q = None
        for t, g, pt, pg, start, *rest in group:
            q = q or tuple(start)
            if pt is not None:
                q = _unit(_product(q, _rotation(pg, g, t - pt)))
            yield t, list(q), *rest

    step = ["ts", "_g", "_pt", "_pg"]
    turns = _folded(steps, [*by, "_b"], ["ts"], step, whole, "_turn array<double>")
    starts = _folded(turns, by, ["_b"], ["_b", "_turn"], chain, "_b long, _start array<double>")
    starts = _with(starts, counts.filter("problem is null"), by)
    rest = ["backward", "duplicate", "gaps", "problem"]
    begun = _with(steps, starts, [*by, "_b"])
    given = "ts double, q array<double>, backward long, duplicate long, gaps long, problem string"
    paths = _folded(begun, [*by, "_b"], ["ts"], [*step, "_start", *rest], each, given).drop("_b")
    none = [F.lit(None).cast("double").alias("ts"), F.lit(None).cast("array<double>").alias("q")]
    return paths.unionByName(counts.filter("problem is not null").select(*by, *none, *rest))


def _lowpass(state, raw, dt: float):
    """The low-passed vector after a sample; one that is not finite changes nothing."""
    if not _finite(raw):
        return state
    return tuple(raw) if state is None else _mix(state, raw, min(max(dt / (LOWPASS_S + dt), 1e-4), 1.0))


def _settled_lengths(group):
    """The low-passed lengths of the marked samples of a segment after the warm-up, within the limits of gravity."""
    smooth, elapsed = None, 0.0
    for now, before, raw, use in group:
        dt = (now - before) / 1000 if before is not None and now > before else 0.001
        smooth = _lowpass(smooth, raw, dt)
        elapsed += dt
        if use and smooth is not None and elapsed >= WARMUP_S:
            size = sqrt(_dot(smooth, smooth))
            if MAGNITUDE[0] <= size <= MAGNITUDE[1]:
                yield (size,)


class GravityFilter:
    """The downward direction of one gyro convention through a segment; its state is two vectors and a time."""

    def __init__(self, magnitude: float, sign: float):
        self.magnitude, self.sign = magnitude, sign
        self.state, self.smooth, self.elapsed = None, None, 0.0

    def step(self, now: float, before: float | None, gyro, raw) -> float | None:
        """Takes a sample; the angle of the correction, if there is one."""
        span = (now - before) / 1000 if before is not None and now > before else None
        if self.state is not None and span is not None and _finite(gyro):
            self._turn([radians(x) for x in gyro], span)
        dt = min(max(0.001 if span is None else span, 1e-4), 0.1)
        self.smooth = _lowpass(self.smooth, raw, dt)
        self.elapsed += dt
        measured = self._measured()
        if measured is None:
            return None
        if self.state is None:
            self.state = measured
            return None
        away = degrees(acos(min(max(_dot(self.state, measured), -1.0), 1.0)))
        if away > INLIER_DEGREES:
            return None
        self.state = _unit(_mix(self.state, measured, min(max(dt / (1.5 + dt), 1e-4), 0.08)))
        return away

    def _turn(self, omega, span: float) -> None:
        speed = sqrt(_dot(omega, omega))
        if not speed > Q.EPS_TELEMETRY:
            return
        axis, v = [x / speed for x in omega], self.state
        c, s = cos(self.sign * speed * span), sin(self.sign * speed * span)
        side, along = _cross(axis, v), _dot(axis, v) * (1 - c)
        self.state = _unit([v[i] * c + side[i] * s + axis[i] * along for i in range(3)])

    def _measured(self):
        if self.smooth is None or self.elapsed < WARMUP_S:
            return None
        size = sqrt(_dot(self.smooth, self.smooth))
        low, high = (r * self.magnitude for r in MAGNITUDE_RATIO)
        if not low <= size <= high or not size > Q.EPS_TELEMETRY:
            return None
        return tuple(-x / size for x in self.smooth)


def _trial(group):
    """How both gyro signs fare on a segment: samples with a direction, corrections, and the sum of their squared angles."""
    filters, sums = None, [[0, 0, 0.0], [0, 0, 0.0]]
    for now, before, g, a, magnitude in group:
        filters = filters or [GravityFilter(magnitude, sign) for sign in SIGNS]
        for one, total in zip(filters, sums):
            away = one.step(now, before, g, a)
            total[0] += one.state is not None
            if away is not None:
                total[1] += 1
                total[2] += away * away
    for sign, total in zip(SIGNS, sums):
        yield sign, *total


def _directions(group):
    one = None
    for now, before, g, a, magnitude, sign, corrections, rms in group:
        one = one or GravityFilter(magnitude, sign)
        one.step(now, before, g, a)
        if one.state is not None:
            yield now, list(one.state), corrections, rms, sign


# the same folds over many segments in step: the i-th rows of all segments at once


def _floats(c: pa.Array) -> np.ndarray:
    return c.to_numpy(zero_copy_only=False).astype(float)


def _vectors(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of three numbers, and which of them are finite."""
    out = np.full((len(c), 3), np.nan)
    ok = pc.fill_null(pc.equal(pc.list_value_length(c), 3), False).to_numpy(zero_copy_only=False)
    out[ok] = _floats(c.filter(pa.array(ok)).flatten()).reshape(-1, 3)
    good = np.isfinite(out).all(axis=1)
    out[~good] = 0.0
    return out, good


def _dots(a, b) -> np.ndarray:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _step_order(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of the folds, the i-th of all segments together and the longest segments first, and where each step begins."""
    size = np.diff(bounds)
    by = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[by], -np.arange(int(size.max(initial=0))), side="left")
    cut = np.concatenate(([0], np.cumsum(live)))
    step = np.repeat(np.arange(len(live)), live)
    return bounds[by[np.arange(len(step)) - cut[step]]] + step, cut


def _pairs(cut: np.ndarray):
    """Of each step but the first: the bounds of its rows, and of the rows before them in their segments."""
    c = cut.tolist()
    return ((slice(p, p + b - a), slice(a, b)) for p, a, b in zip(c, c[1:], c[2:]))


def _ever(flags: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a flag is set in the segment before each row, and up to it."""
    before, out = np.zeros(len(flags), bool), flags.copy()
    for p, r in _pairs(cut):
        before[r] = out[p]
        out[r] |= out[p]
    return before, out


def _totals(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    out = values.copy()
    for p, r in _pairs(cut):
        out[r] += out[p]
    return out


def _weights(dt, ok, first) -> np.ndarray:
    """Of a sample in the low-passed vector: the first is taken whole, one that is not finite not at all."""
    return np.where(first, 1.0, np.where(ok, np.clip(dt / (LOWPASS_S + dt), 1e-4, 1.0), 0.0))


def _smoothed(raw: np.ndarray, k: np.ndarray, cut: np.ndarray) -> np.ndarray:
    keep, out = 1 - k, raw * k
    for p, r in _pairs(cut):
        out[:, r] += out[:, p] * keep[r]
    return out


def _filtered(smooth, has, elapsed, dt, span, gyro, turned, magnitude, signs, cut):
    """As :class:`GravityFilter`, for rows in step order: the direction with each sign, whether there is one, and the correction or NaN.

    ``signs`` has a row for each sign to try; ``magnitude`` is NaN where it is
    not known, and then there is no direction.
    """
    size = np.sqrt(_dots(smooth, smooth))
    low, high = MAGNITUDE_RATIO[0] * magnitude, MAGNITUDE_RATIO[1] * magnitude
    seen = has & (elapsed >= WARMUP_S) & (size >= low) & (size <= high) & (size > Q.EPS_TELEMETRY)
    begun, there = _ever(seen, cut)
    measured = -smooth / np.where(seen, size, 1.0)
    first, mendable = seen & ~begun, seen & begun
    k = np.clip(dt / (1.5 + dt), 1e-4, 0.08)
    keep, pull = 1 - k, measured * k
    turning = begun & turned
    if gyro.any():
        omega = np.radians(gyro)
        speed = np.sqrt(_dots(omega, omega))
        turning &= speed > Q.EPS_TELEMETRY
        axis = omega / np.where(turning, speed, 1.0)
        angle = speed * span
        cosine, sine = np.cos(angle), signs * np.sin(angle)
    else:
        turning[:] = False
    begins = cut[:-1]
    some = {n: np.logical_or.reduceat(f, begins).tolist() for n, f in (("there", there), ("turning", turning), ("first", first))}
    every = np.logical_and.reduceat(turning, begins).tolist()
    directions, away = np.zeros((3, len(signs), len(dt))), np.full((len(signs), len(dt)), np.nan)
    with np.errstate(invalid="ignore", divide="ignore"):
        for i, (p, r) in enumerate(chain([(None, slice(0, int(cut[1])))], _pairs(cut))):
            if not some["there"][i]:
                continue
            v = directions[:, :, r] if p is None else directions[:, :, p]
            if some["turning"][i]:
                x, y, z = axis[:, r]
                c, s = cosine[r], sine[:, r]
                along = _dots((x, y, z), v) * (1 - c)
                new = np.stack((
                    v[0] * c + (y * v[2] - z * v[1]) * s + x * along,
                    v[1] * c + (z * v[0] - x * v[2]) * s + y * along,
                    v[2] * c + (x * v[1] - y * v[0]) * s + z * along,
                ))
                new /= np.sqrt(_dots(new, new))
                v = new if every[i] else np.where(turning[r], new, v)
            m = measured[:, None, r]
            angle = np.degrees(np.arccos(np.clip(_dots(m, v), -1.0, 1.0)))
            mend = mendable[r] & ~(angle > INLIER_DEGREES)
            new = v * keep[r] + pull[:, None, r]
            new /= np.sqrt(_dots(new, new))
            if not mend.all():
                new = np.where(mend, new, np.where(first[r], m, v) if some["first"][i] else v)
                angle[~mend] = np.nan
            directions[:, :, r], away[:, r] = new, angle
    return directions, there, away


def _spans(cols: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Seconds since the sample before, and whether there is one at an earlier time."""
    now, before = _floats(cols[0]), _floats(cols[1])
    known = now > before
    return np.where(known, (now - before) / 1000, 0.001), known


def _settled_in_step(cols: list[pa.Array], bounds: np.ndarray):
    """As :func:`_settled_lengths`."""
    dt, _ = _spans(cols)
    raw, ok = _vectors(cols[2])
    rows, cut = _step_order(bounds)
    dt, ok = dt[rows], ok[rows]
    had, has = _ever(ok, cut)
    smooth = _smoothed(raw.T[:, rows], _weights(dt, ok, ok & ~had), cut)
    take = has & (_totals(dt, cut) >= WARMUP_S)
    size = np.full(len(dt), np.nan)
    size[rows] = np.where(take, np.sqrt(_dots(smooth, smooth)), np.nan)
    use = cols[3].to_numpy(zero_copy_only=False)
    found = np.flatnonzero(use & (size >= MAGNITUDE[0]) & (size <= MAGNITUDE[1]))
    return np.searchsorted(bounds, found, side="right") - 1, [size[found]]


def _filters_in_step(cols: list[pa.Array], bounds: np.ndarray, signs: np.ndarray):
    """As :class:`GravityFilter`, with ``signs`` of each segment: of each row and sign the direction, whether there is one, and the correction or NaN."""
    span, known = _spans(cols)
    gyro, turned = _vectors(cols[2])
    raw, ok = _vectors(cols[3])
    rows, cut = _step_order(bounds)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[rows]
    magnitude = _floats(cols[4])[bounds[:-1]][of]
    dt, ok = np.clip(span, 1e-4, 0.1)[rows], ok[rows]
    had, has = _ever(ok, cut)
    smooth = _smoothed(raw.T[:, rows], _weights(dt, ok, ok & ~had), cut)
    made = _filtered(smooth, has, _totals(dt, cut), dt, span[rows], gyro.T[:, rows], (turned & known)[rows], magnitude, signs[of].T, cut)
    back = np.empty(len(rows), np.int64)
    back[rows] = np.arange(len(rows))
    directions, there, away = made
    return directions[:, :, back].transpose(2, 1, 0), there[back], away[:, back].T


def _trial_in_step(cols: list[pa.Array], bounds: np.ndarray):
    """As :func:`_trial`."""
    n = len(bounds) - 1
    _, there, away = _filters_in_step(cols, bounds, np.tile(SIGNS, (n, 1)))
    of = np.repeat(np.arange(n), np.diff(bounds))
    out = []
    for j, sign in enumerate(SIGNS):
        hit = ~np.isnan(away[:, j])
        sums = np.bincount(of[hit], weights=away[hit, j] ** 2, minlength=n)
        out.append((np.full(n, sign), np.bincount(of[there], minlength=n), np.bincount(of[hit], minlength=n), sums))
    return np.tile(np.arange(n), len(SIGNS)), [np.concatenate(c) for c in zip(*out)]


def _directions_in_step(cols: list[pa.Array], bounds: np.ndarray):
    """As :func:`_directions`."""
    directions, there, _ = _filters_in_step(cols, bounds, _floats(cols[5])[bounds[:-1], None])
    found = np.flatnonzero(there)
    at = pa.array(found)
    vectors = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * 3, pa.array(directions[found, 0].ravel()))
    rest = [cols[i].take(at) for i in (6, 7, 5)]
    return np.searchsorted(bounds, found, side="right") - 1, [cols[0].take(at), vectors, *rest]


def _upper_medians(count: np.ndarray, values: np.ndarray) -> np.ndarray:
    """sorted[n div 2] of each run of ``count`` values, NaN below ``MIN_SAMPLES``."""
    out, end = np.full(len(count), np.nan), np.cumsum(count)
    for i in np.flatnonzero(count >= MIN_SAMPLES).tolist():
        n = int(count[i])
        out[i] = np.partition(values[end[i] - n : end[i]], n // 2)[n // 2]
    return out


def _fused_in_step(new: np.ndarray, cols: np.ndarray):
    """Gravity of whole sources: ``cols`` has times, rates and accelerations, ``new`` marks the first row of a source.

    Returns the sources' numbers, times and directions of the rows that have
    one, and the corrections, rms and sign of all sources.
    """
    of = np.cumsum(new) - 1
    n = int(of[-1]) + 1
    if (np.diff(cols[0])[~new[1:]] <= 0).any():  # out of order, or equal times, which the values then put in order
        cols = cols[:, np.lexsort((*cols[:0:-1], cols[0], of))]
    ts = cols[0]
    before = np.concatenate(([np.nan], ts[:-1]))
    before[new] = np.nan
    known = ts > before
    span = np.where(known, (ts - before) / 1000, 0.001)
    bounds = np.append(np.flatnonzero(new | (ts - before > GAP_WARNING_MS)), len(ts))
    rows, cut = _step_order(bounds)
    group, span, known = of[rows], span[rows], known[rows]
    gyro, raw = cols[1:4].take(rows, axis=1), cols[4:7].take(rows, axis=1)
    turned, ok = np.isfinite(gyro).all(axis=0), np.isfinite(raw).all(axis=0)
    gyro[:, ~turned], raw[:, ~ok] = 0.0, 0.0
    had, has = _ever(ok, cut)
    first = ok & ~had
    k = _weights(span, ok, first)
    smooth, elapsed = _smoothed(raw, k, cut), _totals(span, cut)
    size = np.sqrt(_dots(smooth, smooth))
    settled = has & (elapsed >= WARMUP_S) & (size >= MAGNITUDE[0]) & (size <= MAGNITUDE[1])
    lengths = np.empty(len(ts))
    lengths[rows] = np.where(settled, size, np.nan)
    magnitude = _upper_medians(np.bincount(group[settled], minlength=n), lengths[~np.isnan(lengths)])
    dt = np.clip(span, 1e-4, 0.1)
    if (dt != span).any():
        elapsed, again = _totals(dt, cut), _weights(dt, ok, first)
        smooth = smooth if np.array_equal(again, k) else _smoothed(raw, again, cut)
    turned &= known
    signs = np.array(SIGNS if gyro[:, turned].any() else SIGNS[-1:])  # without a turn both fare alike, and then the last counts
    directions, there, away = _filtered(smooth, has, elapsed, dt, span, gyro, turned, magnitude[group], np.repeat(signs[:, None], len(ts), axis=1), cut)
    samples = np.bincount(group[there], minlength=n)
    corrections, rms, sign = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n, np.int64)
    for j in range(len(signs)):
        hit = ~np.isnan(away[j])
        c = np.bincount(group[hit], minlength=n)
        r = np.sqrt(np.bincount(group[hit], weights=away[j, hit] ** 2, minlength=n) / np.maximum(c, 1))
        better = (samples >= MIN_SAMPLES) & (c >= MIN_SAMPLES) & (r <= RMS_DEGREES) & ((c > corrections) | (c == corrections) & (r <= rms))
        corrections[better], rms[better], sign[better] = c[better], r[better], j
    back = np.empty(len(ts), np.int64)
    back[rows] = np.arange(len(ts))
    found = np.flatnonzero(there[back] & (corrections > 0)[of])
    source = of[found]
    place = sign[source] * len(ts) + back[found]
    vectors = np.empty((len(found), 3))
    for i in range(3):
        vectors[:, i] = directions[i].ravel().take(place)
    return source, ts[found], vectors, corrections, rms, signs[sign]


def extent(sizes: DataFrame, rows: str = "rows") -> tuple[int, int]:
    """The tasks that sources of so many ``rows`` are dealt to, and the rows of the longest."""
    total, longest = sizes.agg(F.sum(rows), F.max(rows)).first()
    return max(-(-(total or 0) // TASK_ROWS), 1), longest or 0


def _fused_short(rows: DataFrame, by: list[str], tasks: int) -> DataFrame:
    """:func:`fuse_gravity` of sources of ``STEP_LONG`` rows at most: many whole sources at once, all steps in one pass."""
    parts = [F.coalesce(F.when(F.size(c) == 3, F.get(c, F.lit(i))), F.lit(np.nan)).alias(f"{c}{i}") for c in ("_g", "_a") for i in range(3)]
    named, k = rows.select(*by, "ts", *parts), len(by)
    types = StructType([named.schema[c] for c in by] + StructType.fromDDL(FUSED).fields)
    arrow = to_arrow_schema(types)

    def together(batch: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
        source, ts, v, *fared = _fused_in_step(new, np.stack([_floats(c) for c in batch.columns[k:]]))
        at = pa.array(np.flatnonzero(new)[source])
        vectors = pa.ListArray.from_arrays(np.arange(len(ts) + 1, dtype=np.int32) * 3, pa.array(v.ravel()))
        out = [*[c.take(at) for c in batch.columns[:k]], pa.array(ts), vectors, *[pa.array(c[source]) for c in fared]]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += batch.num_rows
            if not size or batch is not None and size < STEP_ROWS:
                continue
            whole = pa.concat_batches(held)
            new = _starts(whole, k)
            end = size if batch is None else int(np.flatnonzero(new)[-1])  # the last source may go on
            if end:
                yield together(whole.slice(0, end), new[:end])
            held, size = [whole.slice(end)], size - end

    return named.repartition(tasks, *by).sortWithinPartitions(*by).mapInArrow(run, types)


def fuse_gravity(
    samples: DataFrame, by: list[str], ts: str = "ts", gyro: str = "gyro", accl: str = "accl", dealt: tuple[int, int] | None = None
) -> DataFrame:
    """The downward direction in sensor coordinates over time, and how the correction fared.

    Both gyro signs are tried; more accepted corrections win, then the smaller
    rms.  A source without a usable answer, or that is null, has no rows.  The
    size of gravity is the upper median over all samples after the warm-up.

    Sources of ``STEP_LONG`` rows at most are folded whole, many in step and in
    one pass; longer ones by the segments between gaps.  ``dealt`` is the
    :func:`extent` of the sources, if the caller knows it; samples that lie in
    so many partitions by source are then not moved.
    """
    vector = lambda c: F.col(c).cast("array<double>")
    rows = samples.filter(is_finite(ts)).select(*by, F.col(ts).cast("double").alias("ts"), vector(gyro).alias("_g"), vector(accl).alias("_a"))
    rows = rows.dropna(subset=by)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    tasks, longest = dealt or extent(sizes)
    if longest <= STEP_LONG:
        return _fused_short(rows, by, tasks)
    many = materialize(sizes.filter(F.col("rows") > STEP_LONG).select(*by), "long-sources")
    if many.count() <= FEW_SOURCES:
        many = F.broadcast(many)
    return _fused_short(rows.join(many, by, "left_anti"), by, tasks).unionByName(_fused_long(rows.join(many, by, "left_semi"), by))


def _fused_long(rows: DataFrame, by: list[str]) -> DataFrame:
    """:func:`fuse_gravity` of long sources.

    The filter starts anew after a gap, so the segments between gaps are
    folded apart, short ones many in step and long ones a row at a time.  They are written once, since they are
    read for the size of gravity, for the trial of the signs and for the result.
    """
    rows = rows.withColumn("_use", F.lit(True))
    rows = materialize(_segments(rows, by, "ts", GAP_WARNING_MS, FOLD_MS), "segments")
    key, order = [*by, "segment"], ["ts", "_before"]
    lengths = _folded_in_step(rows, key, order, [*order, "_a", "_use"], _settled_lengths, _settled_in_step, "_size double")
    size = exact_ranks(lengths, by, {"_size": F.col("_size")}, upper_least=MIN_SAMPLES)
    size = size.select(*by, F.col("_size_upper").alias("_size")).filter("_size is not null")
    segments = rows.select(*key).distinct().join(size, by)
    given = [*order, "_g", "_a", "_size"]
    trials = _folded_in_step(rows.join(segments, key), key, order, given, _trial, _trial_in_step, "_sign double, _n long, _c long, _s double")
    fared = trials.groupBy(*by, "_sign").agg(F.sum("_n").alias("_n"), F.sum("_c").alias("_c"), F.sum("_s").alias("_s"))
    fared = fared.filter((F.col("_n") >= MIN_SAMPLES) & (F.col("_c") >= MIN_SAMPLES)).withColumn("_rms", F.sqrt(F.col("_s") / F.col("_c")))
    best = fared.filter(F.col("_rms") <= RMS_DEGREES).groupBy(*by).agg(F.max(F.struct("_c", (-F.col("_rms")).alias("_r"), "_sign")).alias("_best"))
    best = best.select(*by, F.col("_best._c").alias("corrections"), (-F.col("_best._r")).alias("rms_deg"), F.col("_best._sign").alias("gyro_sign"))
    found = rows.join(segments.join(best, by), key)
    given = [*order, "_g", "_a", "_size", "gyro_sign", "corrections", "rms_deg"]
    return _folded_in_step(found, key, order, given, _directions, _directions_in_step, FUSED).drop("segment")
