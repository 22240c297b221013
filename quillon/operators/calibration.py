"""Time offset and fixed rotation between two orientation series."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillon.functions import quaternion as Q
from quillon.functions.numeric import INF, is_finite
from quillon.operators import asof, motion
from quillon.storage import discard, materialize

#: Fixed limit on the grid of offsets.
MAX_OFFSETS = 20_001
#: Values of a block of steps by offsets, or of axes by axes, and rows that are folded before they are given out.
BLOCK = 1 << 18
FOLD_ROWS = 512
#: Sources up to which a row of each is broadcast.
BROADCAST_SOURCES = 200_000
CONJUGATE = np.array([1.0, -1.0, -1.0, -1.0])


@dataclass(frozen=True)
class Config:
    offset_min_ms: float = -500.0
    offset_max_ms: float = 500.0
    offset_step_ms: float = 5.0
    min_samples: int = 8
    min_excitation_deg: float = 45.0
    min_correlation: float = 0.35
    min_axis_diversity: float = 0.15
    max_residual_deg: float = 8.0
    max_pairs: int = 256

    def __post_init__(self) -> None:
        values = (self.offset_min_ms, self.offset_max_ms, self.offset_step_ms, self.min_excitation_deg, self.max_residual_deg)
        if not all(np.isfinite(v) for v in values):
            raise ValueError("limits must be finite")
        if self.offset_step_ms <= 0 or self.offset_max_ms < self.offset_min_ms:
            raise ValueError("the offset grid is empty")
        if self.min_samples < 2 or not -1 <= self.min_correlation <= 1:
            raise ValueError("the sample or correlation limit is out of range")


def offsets(config: Config) -> np.ndarray:
    """The grid of offsets; a finer grid than the limit is made coarser, the last one is the maximum."""
    span = config.offset_max_ms - config.offset_min_ms
    wanted = int(span // config.offset_step_ms)
    n = min(wanted, MAX_OFFSETS)
    step = span / MAX_OFFSETS if wanted > MAX_OFFSETS else config.offset_step_ms
    return np.minimum(config.offset_min_ms + np.arange(n + 1) * step, config.offset_max_ms)


def _mapped(rows: DataFrame, by: list[str], fold: Callable, out: str) -> DataFrame:
    """(by, out): the rows that ``fold`` yields for each row, by its other columns in order.

    Arrays of structs of doubles are matrices on both ways, a row for each struct, null as NaN.
    """
    given = [c for c in rows.columns if c not in by]
    types = StructType([*[rows.schema[c] for c in by], *StructType.fromDDL(out).fields])
    arrow = to_arrow_schema(types)

    def is_matrix(kind: pa.DataType) -> bool:
        return pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)

    def taken(column: pa.Array) -> list:
        if not is_matrix(column.type):
            return column.to_pylist()
        ends = column.offsets.to_numpy()
        parts = column.values.slice(ends[0], ends[-1] - ends[0]).flatten()
        whole, ends = np.stack([part.to_numpy(zero_copy_only=False).astype(float) for part in parts], axis=1), ends - ends[0]
        return [whole[i:j] for i, j in zip(ends, ends[1:])]

    def put(values: list, kind: pa.DataType) -> pa.Array:
        if not is_matrix(kind):
            return pa.array(values, kind)
        size = kind.value_type.num_fields
        whole = np.concatenate(values) if values else np.empty((0, size))
        parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(whole[:, i])) for i in range(size)], fields=list(kind.value_type))
        ends = np.cumsum([0, *map(len, values)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts, type=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, FOLD_ROWS):
                batch = whole.slice(start, FOLD_ROWS)
                sources, made = [], []
                with np.errstate(all="ignore"):
                    for k, row in enumerate(zip(*[taken(batch.column(c)) for c in given])):
                        for got in fold(*row):
                            sources.append(k)
                            made.append(got)
                at = pa.array(sources, pa.int64())
                columns = [[row[i] for row in made] for i in range(len(arrow) - len(by))]
                kept = [batch.column(c).take(at) for c in by]
                yield pa.RecordBatch.from_arrays([*kept, *[put(c, f.type) for c, f in zip(columns, list(arrow)[len(by) :])]], schema=arrow)

    return rows.select(*by, *given).mapInArrow(run, types)


def _moments(probes: np.ndarray, samples: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """A row for each offset: pairs, both means, the sums of squares and of products around them.

    ``probes`` and ``samples`` are rows of time and value; a probe meets the
    sample of its time plus the offset, or a mixture of the two around it.
    """
    total = np.zeros((len(grid), 6))
    if not len(samples):
        return total
    probes, samples = (rows[np.lexsort(rows.T[::-1])] if len(rows) > 1 else rows for rows in (probes, samples))
    at, value = samples.T
    size, last = max(BLOCK // len(grid), 1), len(at) - 1
    for start in range(0, len(probes), size):
        ts, x = probes[start : start + size].T
        asked = ts + grid[:, None]
        k = np.searchsorted(at, asked.ravel(), "right").reshape(asked.shape) - 1
        left, right = np.maximum(k, 0), np.minimum(k + 1, last)
        exact = at[left] == asked
        met = exact | ((k >= 0) & (k < last))
        t = (asked - at[left]) / (at[right] - at[left])
        y = np.where(exact, value[left], value[left] * (1 - t) + value[right] * t)
        if len(x) == 1:
            one = np.column_stack([met, np.broadcast_to(x, y.shape), y, np.zeros((len(grid), 3))])
            total = _together(total, np.where(met, one, 0.0)) if start else np.where(met, one, 0.0)
            continue
        # from one of the values on, so what does not change has no spread at all
        x0, y0 = _origin(x), _origin(value)
        dx, dy, n = np.where(met, x - x0, 0.0), np.where(met, y - y0, 0.0), met.sum(axis=1)
        mx, my = dx.sum(axis=1) / np.maximum(n, 1), dy.sum(axis=1) / np.maximum(n, 1)
        dx, dy = np.where(met, dx - mx[:, None], 0.0), np.where(met, dy - my[:, None], 0.0)
        products = [(u * v).sum(axis=1) for u, v in ((dx, dx), (dy, dy), (dx, dy))]
        part = np.stack([n, mx + x0, my + y0, *products], axis=1)
        total = _together(total, part) if start else part
    return total


def _origin(values: np.ndarray) -> float:
    """The first finite value."""
    known = np.flatnonzero(np.isfinite(values))
    return values[known[0]] if len(known) else 0.0


def _together(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The moments of two sets of pairs as those of one."""
    n = a[:, 0] + b[:, 0]
    share = b[:, 0] / np.maximum(n, 1)
    dx, dy = b[:, 1] - a[:, 1], b[:, 2] - a[:, 2]
    across = a[:, 0] * share
    one = [n, a[:, 1] + dx * share, a[:, 2] + dy * share, a[:, 3] + b[:, 3] + dx * dx * across, a[:, 4] + b[:, 4] + dy * dy * across,
           a[:, 5] + b[:, 5] + dx * dy * across]
    return np.where((a[:, 0] == 0)[:, None], b, np.where((b[:, 0] == 0)[:, None], a, np.stack(one, axis=1)))


def _all_together(parts: np.ndarray, size: int) -> np.ndarray:
    """A row of moments for each offset, from rows of its index and the moments of some of its pairs."""
    at, (n, mx, my, *products) = parts[:, 0].astype(int), parts[:, 1:].T

    def summed(x: np.ndarray) -> np.ndarray:
        return np.bincount(at, x, minlength=size)

    pairs = summed(n)
    some = np.maximum(pairs, 1)
    # from one of the means on, as in :func:`_moments`
    means = [x0 + summed(n * (x - x0)) / some for x, x0 in ((mx, _origin(mx)), (my, _origin(my)))]
    dx, dy = mx - means[0][at], my - means[1][at]
    products = [summed(p + n * u * v) for p, u, v in zip(products, (dx, dy, dx), (dx, dy, dy))]
    return np.stack([pairs, *means, *products], axis=1)


def _correlations(moments: np.ndarray) -> np.ndarray:
    """As :func:`pearson` has them; NaN where there is none."""
    spread = np.sqrt(moments[:, 3] * moments[:, 4])
    ok = (moments[:, 0] >= 2) & (spread > Q.EPS_TELEMETRY) & np.isfinite(spread)
    return np.where(ok, np.clip(moments[:, 5] / np.where(ok, spread, 1.0), -1.0, 1.0), np.nan)


def _best(moments: np.ndarray, least: int) -> np.ndarray:
    """The index of the best offset, or none."""
    correlation = _correlations(moments)
    order = np.lexsort((np.arange(len(moments)), -moments[:, 0], -np.round(correlation, 12)))
    return order[(moments[order, 0] >= least) & ~np.isnan(correlation[order])][:1]


def _scores(slow: DataFrame, fast: DataFrame, by: list[str], config: Config, best: bool) -> DataFrame:
    """:func:`offset_scores` of angular speeds (by, ts, speed_dps); with ``best`` of each source's best offset alone.

    Steps meet the speeds they ask for in a bucket of time of their source, all
    offsets of a bucket at once.  What leaves a bucket is a row of moments for
    each offset, and these are put together by source; a source of one bucket
    sends only its best.
    """
    span = config.offset_max_ms - config.offset_min_ms
    grid = offsets(config)
    speeds = [df.filter("speed_dps is not null").select(*by, "ts", "speed_dps") for df in (fast, slow)]
    near = asof.gather(*speeds, by, (config.offset_min_ms, config.offset_max_ms), max(asof.BUCKET_MS, span))

    def each(bucket, buckets, probes, samples):
        found = _moments(probes, samples, grid)
        keep = _best(found, config.min_samples) if best and buckets == 1 else np.flatnonzero(found[:, 0])
        yield (np.column_stack([np.full(len(keep), bucket), keep, found[keep]]),)

    def whole(parts):
        total = _all_together(parts[np.lexsort((parts[:, 0], parts[:, 1]))][:, 1:], len(grid))
        correlation = _correlations(total)
        for k in _best(total, config.min_samples) if best else np.flatnonzero(total[:, 0]):
            yield grid[k], None if np.isnan(correlation[k]) else correlation[k], int(total[k, 0])

    fields = ", ".join(f"{c}: double" for c in ("bucket", "offset", "n", "mx", "my", "xx", "yy", "xy"))
    parts = _mapped(near, by, each, f"parts array<struct<{fields}>>")
    parts = parts.groupBy(*by).agg(F.flatten(F.collect_list("parts")).alias("parts"))
    return _mapped(parts, by, whole, "offset_ms double, correlation double, pairs long")


def offset_scores(visual: DataFrame, telemetry: DataFrame, by: list[str], config: Config) -> DataFrame:
    """Correlation of the angular speeds at each offset: (by, offset_ms, correlation, pairs).

    Each visual step asks the telemetry's speed at its time plus the offset.
    """
    return _scores(motion.angular_speed(visual, by), motion.angular_speed(telemetry, by), by, config, best=False)


def best_offset(visual: DataFrame, telemetry: DataFrame, by: list[str], config: Config = Config()) -> DataFrame:
    """The offset of highest correlation, then most pairs, then the earliest; and what failed, if anything.

    Correlations within a trillionth are equal: they are compared rounded.
    """
    slow, fast = (materialize(motion.angular_speed(df, by), "speeds") for df in (visual, telemetry))
    return _best_offset(slow, fast, by, config)


def _best_offset(slow: DataFrame, fast: DataFrame, by: list[str], config: Config) -> DataFrame:
    """:func:`best_offset` of written angular speeds, which are read twice."""
    best = _scores(slow, fast, by, config, best=True)
    turned = [
        motion.excitation(df, by).select(
            *by, F.col("excitation_deg").alias(f"{name}_excitation_deg"), F.col("steps").alias(f"{name}_steps")
        )
        for df, name in ((slow, "visual"), (fast, "telemetry"))
    ]
    out = turned[0].join(turned[1], by, "full").join(best, by, "left")
    few = F.least(F.coalesce("visual_steps", F.lit(0)), F.coalesce("telemetry_steps", F.lit(0))) < config.min_samples
    low = F.least("visual_excitation_deg", "telemetry_excitation_deg") < config.min_excitation_deg
    problem = (
        F.when(few, "too few samples")
        .when(F.greatest("visual_excitation_deg", "telemetry_excitation_deg") == INF, "invalid attitude")
        .when(low, "low excitation")
        .when(F.col("offset_ms").isNull(), "no overlap")
        .when(F.col("correlation") < config.min_correlation, "low correlation")
    )
    return out.withColumn("problem", problem).withColumn("valid", F.col("problem").isNull())


def paired_samples(visual: DataFrame, telemetry: DataFrame, found: DataFrame, by: list[str], config: Config) -> DataFrame:
    """The attitudes of which :func:`hand_eye` makes pairs: (by, rows), the rows of a source as an array.

    ``found`` is (by, offset_ms), a row for each source.  A source gives the
    first ``max_pairs`` samples within the telemetry and as many a stride behind
    them, with their number from 1, the stride and both attitudes.
    """
    # of equal times the first counts on this side
    once, tele = (asof.last_per_timestamp(df, by, "ts", "pos", first=True) for df in (visual, telemetry))
    valid = Q.staged(tele.select(*by, "ts", "q"), "q", Q.of("q"), *Q.unit_steps(4)).filter(F.get("q", F.lit(0)).isNotNull() & is_finite("ts"))
    ranges = valid.groupBy(*by).agg(F.min("ts").alias("_t0"), F.max("ts").alias("_t1"))
    stride = F.greatest(F.call_function("div", F.count(F.lit(1)), F.lit(config.max_pairs).cast("long")), F.lit(1))
    sources = motion._with(motion._with(once.groupBy(*by).agg(stride.alias("stride")), ranges, by), found.select(*by, "offset_ms"), by)
    sources = F.broadcast(sources) if found.count() <= BROADCAST_SOURCES else sources
    rows = motion._with(once.select(*by, "ts", F.col("q").alias("vq")), sources, by)
    rows = rows.withColumn("ts", F.col("ts") + F.col("offset_ms")).filter("ts between _t0 and _t1")
    rows = asof.running_total(rows, by, "ts", F.lit(1), "i", asof.BUCKET_MS)
    rows = rows.filter((F.col("i") <= config.max_pairs) | ((F.col("i") > F.col("stride")) & (F.col("i") <= F.col("stride") + config.max_pairs)))
    at = asof.attitude_at(tele, rows.select(*by, "ts", "i", "stride", "vq"), by).filter("q is not null")
    parts = [F.get(c, F.lit(k)).alias(f"{c}{k}") for c in ("vq", "q") for k in range(4)]
    return at.groupBy(*by).agg(F.collect_list(F.struct(F.col("i").cast("double"), F.col("stride").cast("double"), *parts)).alias("rows"))


def _relative_pairs(rows: np.ndarray, most: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Rotations between samples a stride apart, a of the visual side and b of the telemetry, by attitude convention."""
    rows = rows[np.argsort(rows[:, 0])]
    i, stride = rows[:, 0], rows[0, 1]
    other = np.searchsorted(i, i + stride)
    first = np.flatnonzero(i[np.minimum(other, len(i) - 1)] == i + stride)[:most]
    v, q = _unit(rows[:, 2:6]), _unit(rows[:, 6:])
    a = _product(v[first], v[other[first]] * CONJUGATE)
    for name, u in (("as-provided", q), ("inverted", q * CONJUGATE)):
        yield name, a, _product(u[first], u[other[first]] * CONJUGATE)


def _unit(q: np.ndarray) -> np.ndarray:
    """Rows of unit length; NaN for those that are not finite or have none."""
    n = np.linalg.norm(q, axis=1, keepdims=True)
    return np.where(np.isfinite(n) & (n > Q.EPS_TELEMETRY), q / n, np.nan)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack(Q.multiply(tuple(a.T), tuple(b.T)), axis=1)


def _normal_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 4 x 4 normal matrix of a x = x b."""
    known = np.isfinite(a).all(axis=1) & np.isfinite(b).all(axis=1)
    if not known.any():
        return np.full((4, 4), np.nan)
    diff = np.array(Q.left_matrix(tuple(a[known].T))) - np.array(Q.right_matrix(tuple(b[known].T)))
    return np.einsum("rin,rjn->ij", diff, diff)


def _smallest_eigenvector(m: np.ndarray) -> np.ndarray | None:
    """The unit eigenvector of the smallest eigenvalue, w >= 0."""
    if not np.isfinite(m).all():
        return None
    v = np.linalg.eigh(m)[1][:, 0]
    return v if v[0] >= 0 else -v


def _axes(q: np.ndarray) -> tuple[np.ndarray, float | None]:
    """The unit turning axes of those that turn, and the sum of all angles in degrees."""
    q = _unit(q)
    q = np.where(q[:, :1] < 0, -q, q)[np.isfinite(q).all(axis=1)]
    s = np.linalg.norm(q[:, 1:], axis=1)
    turns = s > Q.EPS_RETRIEVAL
    return q[turns, 1:] / s[turns, None], float(np.degrees(2 * np.arctan2(s, q[:, 0])).sum()) if len(q) else None


def _diversity(axes: np.ndarray) -> float:
    """The largest cross product of two axes, some rows of pairs at a time."""
    most, size = 0.0, max(BLOCK // max(len(axes), 1), 1)
    for start in range(0, len(axes), size):
        l, r = axes[start : start + size, None, :], axes[None, :, :]
        c = Q.cross(np.moveaxis(l, 2, 0), np.moveaxis(r, 2, 0))
        most = max(most, float(np.sqrt(max((c[0] * c[0] + c[1] * c[1] + c[2] * c[2]).max(), 0.0))))
    return most


def _residuals(a: np.ndarray, b: np.ndarray, x: np.ndarray | None) -> np.ndarray:
    """Degrees between a x and x b; infinite without an answer."""
    if x is None:
        return np.full(len(a), np.inf)
    x = np.broadcast_to(x, (len(a), 4))
    left, right = _product(_unit(a), x), _product(x, _unit(b))
    size = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
    angle = np.degrees(2 * np.arccos(np.minimum(np.abs((left * right).sum(axis=1)) / size, 1.0)))
    return np.where(np.isnan(angle), np.inf, angle)


def solve_hand_eye(a: np.ndarray, b: np.ndarray) -> tuple:
    """The unit x, w >= 0, that comes nearest to a x = x b, its residual (root mean square) and the largest, excitation and axis diversity."""
    x = _smallest_eigenvector(_normal_matrix(a, b))
    error = _residuals(a, b, x)
    (axes, ea), (_, eb) = _axes(a), _axes(b)
    rms, most = (float(np.sqrt((error * error).mean())), float(error.max())) if len(error) else (None, None)
    least = min((e for e in (ea, eb) if e is not None), default=None)
    return None if x is None else x.tolist(), rms, most, least, _diversity(axes)


def hand_eye(samples: DataFrame, by: list[str], config: Config = Config()) -> DataFrame:
    """The fixed rotation x with a x = x b by source and attitude convention: x, residuals and gates.

    ``samples`` is what :func:`paired_samples` gives.
    """

    def solve(rows):
        for convention, a, b in _relative_pairs(rows, config.max_pairs):
            if len(a):
                yield convention, len(a), *solve_hand_eye(a, b)

    out = _mapped(
        samples.select(*by, "rows"), by, solve,
        "convention string, pairs long, x array<double>, residual_deg double, max_residual_deg double, excitation_deg double,"
        " axis_diversity double",
    )
    problem = (
        F.when(F.col("pairs") < config.min_samples, "too few samples")
        .when(F.col("excitation_deg") < config.min_excitation_deg, "low excitation")
        .when(F.col("axis_diversity") < config.min_axis_diversity, "parallel axes")
        .when(F.col("x").isNull(), "no solution")
        .when(F.col("residual_deg") > config.max_residual_deg, "residual")
    )
    return out.withColumn("problem", problem)


def calibrate(visual: DataFrame, telemetry: DataFrame, by: list[str], config: Config = Config()) -> DataFrame:
    """Offset and rotation of each source, with the better of both attitude conventions.

    ``visual`` and ``telemetry`` are (by, ts, pos, q).  Equal residuals choose
    the attitudes as they are.
    """
    speeds = [materialize(motion.angular_speed(df, by), "speeds") for df in (visual, telemetry)]
    found = materialize(_best_offset(*speeds, by, config), "offset")  # a row for each source
    discard(*speeds)
    both = hand_eye(paired_samples(visual, telemetry, found.filter("valid"), by, config), by, config)
    order = Window.partitionBy(*by).orderBy(F.col("problem").isNotNull(), F.col("residual_deg"), F.col("convention"))
    best = both.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
    best = best.withColumnRenamed("problem", "rotation_problem").withColumnRenamed("pairs", "rotation_pairs")
    out = found.join(best, by, "left")
    return out.withColumn("problem", F.coalesce("problem", "rotation_problem")).drop("rotation_problem").withColumn(
        "valid", F.col("problem").isNull()
    )
