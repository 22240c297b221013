"""The offset search and the pairs of the rotation, against plain loops; and the rows that the search makes."""

import math

import numpy as np
import pytest

from quillon.operators import calibration

SCHEMA = "source string, ts double, pos long, q array<double>"
TURN = np.array([0.9, 0.13, -0.35, 0.17]) / np.linalg.norm([0.9, 0.13, -0.35, 0.17])


def attitude(i):
    axis = np.array([math.sin(0.31 * i), math.cos(0.23 * i), math.sin(0.17 * i + 1)])
    half = math.radians(12 * math.sin(0.42 * i) + 7 * math.cos(0.17 * i) + 9 * math.sin(0.05 * i)) / 2
    return np.concatenate(([math.cos(half)], math.sin(half) * axis / np.linalg.norm(axis)))


def times(a, b):
    return np.concatenate(([a[0] * b[0] - a[1:] @ b[1:]], a[0] * b[1:] + b[0] * a[1:] + np.cross(a[1:], b[1:])))


def back(q):
    return q * np.array([1, -1, -1, -1])


def degrees(a, b):
    return math.degrees(2 * math.acos(min(abs(a @ b), 1.0)))


def series(spark, by_source):
    return spark.createDataFrame([(s, t, i, q.tolist()) for s, rows in by_source.items() for i, (t, q) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def sides(spark):
    """Within one bucket, over many, over a wide gap, apart in time, and before 1970."""
    visual, telemetry = {}, {}
    for name, n, step, shift, start, gone in (
        ("short", 90, 40.0, 80.0, 0.0, ()), ("long", 160, 90_000.0, 30_000.0, 5000.0, ()),
        ("gap", 160, 90_000.0, 30_000.0, 0.0, range(30, 120)), ("apart", 60, 40.0, 9e8, 0.0, ()), ("early", 90, 40.0, 80.0, -3_602_000.0, ()),
    ):
        visual[name] = [(start + i * step, times(TURN, attitude(i))) for i in range(n)]
        telemetry[name] = [(start + i * step + shift, attitude(i)) for i in range(n) if i not in gone]
    return visual, telemetry, series(spark, visual), series(spark, telemetry)


def speeds(rows):
    return [((s + t) / 2, degrees(a, b) * 1000 / (t - s)) for (s, a), (t, b) in zip(rows, rows[1:])]


@pytest.mark.parametrize("low,high,step", [(-500.0, 500.0, 20.0), (-7_200_000.0, 7_200_000.0, 600_000.0)])
def test_offset_scores_of_a_plain_search(spark, sides, low, high, step):
    visual, telemetry, left, right = sides
    want = {}
    for name in visual:
        at, dps = np.array(speeds(telemetry[name])).T
        for k in range(int((high - low) // step) + 1):
            offset = low + k * step
            met = [(v, np.interp(t + offset, at, dps)) for t, v in speeds(visual[name]) if at[0] <= t + offset <= at[-1]]
            if met:
                x, y = np.array(met).T
                known = len(met) > 1 and x.std() * y.std() * len(met) > 1e-12
                want[name, offset] = (len(met), pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9) if known else None)
    got = calibration.offset_scores(left, right, ["source"], calibration.Config(low, high, step)).collect()
    assert {(r.source, r.offset_ms): (r.pairs, r.correlation) for r in got} == want


def test_pairs_a_stride_apart(spark, sides):
    """160 samples and 16 pairs at most: the first 16 samples within the telemetry and those ten behind them."""
    visual, telemetry, left, right = sides
    config = calibration.Config(-60_000.0, 60_000.0, 30_000.0, max_pairs=16)
    got = {r.source: r for r in calibration.calibrate(left, right, ["source"], config).collect()}
    r = got["long"]
    assert r.valid
    pairs = [(times(visual["long"][i][1], back(visual["long"][i + 10][1]))) for i in range(16)]
    assert (r.offset_ms, r.convention, r.rotation_pairs) == (30_000.0, "as-provided", 16)
    assert r.excitation_deg == pytest.approx(sum(degrees(a, np.array([1.0, 0, 0, 0])) for a in pairs), abs=1e-6)
    axes = [a[1:] / np.linalg.norm(a[1:]) for a in pairs]
    assert r.axis_diversity == pytest.approx(max(np.linalg.norm(np.cross(a, b)) for a in axes for b in axes), abs=1e-9)
    assert degrees(np.array(r.x), TURN) < 1e-4 and r.residual_deg < 1e-4
    assert got["apart"].problem == "no overlap"


def test_an_invalid_attitude_is_no_match(spark):
    """Its speeds are infinite, no correlation is known with them (it was given as 1 at each offset), and the source is not valid."""
    rows = [(i * 40.0, attitude(i)) for i in range(60)]
    broken = [(t, q * (i != 30)) for i, (t, q) in enumerate(rows)]
    r = calibration.best_offset(series(spark, {"s": rows}), series(spark, {"s": broken}), ["source"]).first()
    assert not r.valid and r.correlation is None and r.problem == "invalid attitude"


def most_rows(plan):
    """The largest number of rows that a node of an executed plan gave out."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return most_rows(plan.executedPlan())
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    if name.endswith("QueryStageExec"):
        below.append(plan.plan())
    metrics = plan.metrics()
    own = metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0
    return max([own, *map(most_rows, below)])


def test_the_search_makes_no_row_for_each_step_and_offset(spark):
    rows = {"s": [(i * 40.0, attitude(i)) for i in range(500)]}
    scores = calibration.offset_scores(series(spark, rows), series(spark, rows), ["source"], calibration.Config())
    assert len(scores.collect()) == 201
    assert 499 <= most_rows(scores._jdf.queryExecution().executedPlan()) <= 5 * 500
