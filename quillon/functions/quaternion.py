"""Quaternion and vector algebra as native column expressions.

A quaternion is a tuple of four columns (w, x, y, z), a vector one of three;
nulls pass through, and what has no answer is null.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.numeric import INF, is_finite

Quat = tuple[Column, Column, Column, Column]
Vec = tuple[Column, Column, Column]
#: Norms up to these count as zero: the telemetry and the retrieval rule.
EPS_TELEMETRY = 2.220446049250313e-16
EPS_RETRIEVAL = 1e-12
#: Above this cosine the short path is interpolated linearly.
LINEAR_ABOVE = 0.9995


def of(df_col: str | Column, size: int = 4) -> tuple[Column, ...]:
    c = F.col(df_col) if isinstance(df_col, str) else df_col
    return tuple(F.get(c, F.lit(i)) for i in range(size))


def lit(*values: float) -> tuple[Column, ...]:
    return tuple(F.lit(float(v)) for v in values)


def pack(q) -> Column:
    return F.array(*q)


def dot(a, b) -> Column:
    return reduce(lambda s, t: s + t, [x * y for x, y in zip(a, b)])


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def chain(values, *steps) -> Column:
    """An array: ``steps`` applied one after the other to values that are computed once.

    Expressions are trees, so a formula over a formula repeats the inner one
    at each use, and the optimizer joins columns that only wrap it.  Here each
    step reads its input by name, and the size stays in proportion.
    """
    size, out = len(values), F.array(*values)
    for step in steps:

        def taken(n: int, f):
            return lambda v: F.array(*f(of(v, n)))

        out = F.get(F.transform(F.array(out), taken(size, step)), F.lit(0))
        size = len(step(of(F.lit(None).cast("array<double>"), size)))
    return out


def staged(df: DataFrame, out: str, values, *steps, single: bool = False) -> DataFrame:
    """Adds the column ``out``, an array (or its one value) made by ``steps`` from ``values``.

    As :func:`chain`, with a projection of plain columns for each step: names
    that are used more than once keep the optimizer from joining projections,
    so all of it is generated code of a size in proportion.  A filter on the
    result is pushed below the steps, formulas and all: for short chains only.
    """
    names: list[str] = []
    for k, step in enumerate(steps):
        cols = {f"_{out}{k}_{i}": v for i, v in enumerate(values)}
        df = df.withColumns(cols)
        names += cols
        values = step(tuple(F.col(c) for c in cols))
    return df.withColumn(out, values[0] if single else F.array(*values)).drop(*names)


def unit_steps(*sizes: int, eps: float = EPS_TELEMETRY):
    """Steps that make unit length of the quaternions or vectors of these sizes that lie end to end; the rest stays."""
    bounds = [sum(sizes[:i]) for i in range(len(sizes) + 1)]

    def lengths(v):
        return (*v, *[norm(v[a:b]) for a, b in zip(bounds, bounds[1:])])

    def scaled(v):
        norms, out = v[len(v) - len(sizes) :], []
        for a, b, n in zip(bounds, bounds[1:], norms):
            out += [F.when(is_finite(n) & (n > eps), x / F.when(n != 0, n)) for x in v[a:b]]
        return (*out, *v[bounds[-1] : len(v) - len(sizes)])

    return lengths, scaled


def _units(x: np.ndarray, eps: float) -> list:
    """Rows of unit length as lists; None for rows that are not finite or no longer than ``eps``."""
    with np.errstate(all="ignore"):
        n = np.linalg.norm(x, axis=1)
        ok = np.isfinite(n) & (n > eps)
        unit = x / np.where(ok, n, 1.0)[:, None]
    return [v if good else None for v, good in zip(unit.tolist(), ok)]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _slerp_batch(aw: pd.Series, ax: pd.Series, ay: pd.Series, az: pd.Series, bw: pd.Series, bx: pd.Series, by: pd.Series, bz: pd.Series, t: pd.Series) -> pd.Series:
    a, b, t = np.stack([aw, ax, ay, az], axis=1).astype(float), np.stack([bw, bx, by, bz], axis=1).astype(float), t.to_numpy(float)
    with np.errstate(all="ignore"):
        d = a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1] + a[:, 2] * b[:, 2] + a[:, 3] * b[:, 3]
        sign, d = np.where(d < 0, -1.0, 1.0), np.abs(d)
        theta = np.arccos(np.minimum(d, 1.0))
        s, curved = np.sin(theta), d <= LINEAR_ABOVE
        ka = np.where(curved, np.sin((1 - t) * theta) / s, 1 - t)
        kb = np.where(curved, np.sin(t * theta) / s, t) * sign
        mixed = ka[:, None] * a + kb[:, None] * b
        mixed[~((t >= 0) & (t <= 1))] = np.nan
    return pd.Series(_units(mixed, EPS_TELEMETRY), dtype=object)


def slerp_array(a: Quat, b: Quat, t: Column) -> Column:
    """:func:`slerp` as one array, computed on Arrow batches: its formula is too deep for one generated expression."""
    return _slerp_batch(*a, *b, t)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _nlerp_batch(ax: pd.Series, ay: pd.Series, az: pd.Series, bx: pd.Series, by: pd.Series, bz: pd.Series, t: pd.Series) -> pd.Series:
    a, b, t = np.stack([ax, ay, az], axis=1).astype(float), np.stack([bx, by, bz], axis=1).astype(float), t.to_numpy(float)
    with np.errstate(all="ignore"):
        mixed = (1 - t)[:, None] * a + t[:, None] * b
        mixed[~((t >= 0) & (t <= 1))] = np.nan
    return pd.Series(_units(mixed, EPS_RETRIEVAL), dtype=object)


def nlerp_array(a: Vec, b: Vec, t: Column) -> Column:
    """:func:`nlerp` of directions as one array, on Arrow batches."""
    return _nlerp_batch(*a, *b, t)


def normalize(a, eps: float = EPS_TELEMETRY):
    """Unit quaternion or vector; null if not finite or no longer than ``eps``."""
    n = norm(a)
    ok = is_finite(n) & (n > eps)  # a length is finite only if all parts are
    return tuple(F.when(ok, x / F.when(n != 0, n)) for x in a)


def positive_w(q: Quat) -> Quat:
    """The one of q and -q with w >= 0."""
    return tuple(F.when(q[0] < 0, -x).otherwise(x) for x in q)


def multiply(a: Quat, b: Quat) -> Quat:
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return (
        aw * bw - ax * bx - ay * by - az * bz,
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
    )


def conjugate(q: Quat) -> Quat:
    return (q[0], -q[1], -q[2], -q[3])


def relative(a: Quat, b: Quat) -> Quat:
    """The rotation a after the inverse of b, for unit quaternions."""
    return multiply(a, conjugate(b))


def angle_degrees(a: Quat, b: Quat) -> Column:
    """Angle of the rotation between a and b; infinite (not null) if either is invalid.

    The cosine is divided by both lengths, not taken of two unit quaternions:
    that formula is an eighth of the size.
    """
    na, nb = norm(a), norm(b)
    ok = is_finite(na) & (na > EPS_TELEMETRY) & is_finite(nb) & (nb > EPS_TELEMETRY)
    d = F.abs(dot(a, b)) / F.when(ok, na * nb)
    return F.when(ok, F.degrees(2 * F.acos(F.least(d, F.lit(1.0))))).otherwise(F.lit(INF))


def slerp(a: Quat, b: Quat, t: Column) -> Quat:
    """Shortest-path interpolation of unit quaternions; null if t is not in 0 .. 1."""
    d = dot(a, b)
    sign = F.when(d < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    d = F.abs(d)
    theta = F.acos(F.least(d, F.lit(1.0)))
    s = F.sin(theta)
    curved = d <= LINEAR_ABOVE
    ka = F.when(curved, F.try_divide(F.sin((1 - t) * theta), s)).otherwise(1 - t)
    kb = F.when(curved, F.try_divide(F.sin(t * theta), s)).otherwise(t) * sign
    ok = is_finite(t) & (t >= 0) & (t <= 1)
    return tuple(F.when(ok, x) for x in of(chain(tuple(ka * x + kb * y for x, y in zip(a, b)), normalize)))


def nlerp(a, b, t: Column):
    """Linear interpolation, then unit length; null if t is not in 0 .. 1 or the result has no direction."""
    ok = is_finite(t) & (t >= 0) & (t <= 1)
    return tuple(F.when(ok, x) for x in of(chain(tuple((1 - t) * x + t * y for x, y in zip(a, b)), lambda v: normalize(v, EPS_RETRIEVAL)), len(a)))


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def rotate(q: Quat, v: Vec) -> Vec:
    """v turned by the unit quaternion q."""
    u = q[1:]
    t = tuple(2 * x for x in cross(u, v))
    c = cross(u, t)
    return tuple(v[i] + q[0] * t[i] + c[i] for i in range(3))


def vector_angle(a: Vec, b: Vec) -> Column:
    """Degrees between two directions, by a clamped cosine; null if either has none."""
    ua, ub = normalize(a, EPS_RETRIEVAL), normalize(b, EPS_RETRIEVAL)
    d = dot(ua, ub)
    return F.when(d.isNotNull(), F.degrees(F.acos(F.least(F.greatest(d, F.lit(-1.0)), F.lit(1.0)))))


def shortest_arc(a: Vec, b: Vec) -> Quat:
    """The rotation that takes direction a to b.

    Opposite directions have no single one: null.  Equal ones give the identity.
    """

    def units(v):
        return (*normalize(v[:3], EPS_RETRIEVAL), *normalize(v[3:], EPS_RETRIEVAL))

    def arc(u):
        return (dot(u[:3], u[3:]), *cross(u[:3], u[3:]))

    def turn(u):
        raw, same = normalize((1 + u[0], *u[1:]), EPS_RETRIEVAL), u[0] > 1 - 1e-12
        ident = lit(1, 0, 0, 0)
        return tuple(F.when(u[0] < -1 + 1e-8, F.lit(None)).when(same, i).otherwise(x) for i, x in zip(ident, raw))

    return of(chain((*a, *b), units, arc, turn))


def axis_angle(q: Quat) -> tuple[Vec, Column]:
    """Unit axis and angle in radians (0 .. pi) of a unit quaternion; no axis where it does not turn."""
    p = positive_w(q)
    s = norm(p[1:])
    angle = 2 * F.atan2(s, p[0])
    return tuple(F.when(s > EPS_RETRIEVAL, x / F.when(s != 0, s)) for x in p[1:]), angle


def left_matrix(q: Quat) -> list[list[Column]]:
    """Rows of the matrix M with M p = q p."""
    w, x, y, z = q
    return [[w, -x, -y, -z], [x, w, -z, y], [y, z, w, -x], [z, -y, x, w]]


def right_matrix(q: Quat) -> list[list[Column]]:
    """Rows of the matrix M with M p = p q."""
    w, x, y, z = q
    return [[w, -x, -y, -z], [x, w, z, -y], [y, -z, w, x], [z, y, -x, w]]


def remap(q: Quat, before: tuple[float, ...], after: tuple[float, ...]) -> Quat:
    """The product of a constant, q, and another constant: a change of axes on both sides."""
    return multiply(multiply(lit(*before), q), lit(*after))


def calibrated(x: Quat, q: Quat, inverse) -> Quat:
    """x q, or x times the inverse of q where ``inverse`` holds."""
    inverse = F.lit(inverse) if isinstance(inverse, bool) else inverse
    direct, other = multiply(x, q), relative(x, q)
    return tuple(F.when(inverse, b).otherwise(a) for a, b in zip(direct, other))


def views_overlap(forward_a: Vec, forward_b: Vec, half_a: Column, half_b: Column) -> Column:
    """Whether two view cones meet; null for directions or half angles that are not valid."""
    ok = is_finite(half_a) & is_finite(half_b) & (half_a > 0) & (half_b > 0) & (half_a <= 180) & (half_b <= 180)
    return F.when(ok, vector_angle(forward_a, forward_b) <= half_a + half_b + 1e-9)


def covariance_is_psd(c: Column) -> Column:
    """Whether nine row-major values are a symmetric positive semidefinite matrix, by its principal minors."""
    m = [[F.get(c, F.lit(3 * i + j)) for j in range(3)] for i in range(3)]
    tol = F.lit(1e-10)
    ok = (F.size(c) == 9) & F.forall(c, is_finite)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        ok = ok & (F.abs(m[i][j] - m[j][i]) <= tol)
        ok = ok & (m[i][i] * m[j][j] - m[i][j] * m[j][i] >= -tol)
    for i in range(3):
        ok = ok & (m[i][i] >= -tol)
    det = (
        m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
        - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
        + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    )
    return F.coalesce(ok & (det >= -tol), F.lit(False))
