"""The inertial folds, dealt by bucket and segment, against a whole source at a time."""

import math

import numpy as np
import pyarrow as pa
import pytest

from quillon.operators import motion

SCHEMA = "source string, pos long, ts double, gyro array<double>, accl array<double>"


def usable(v):
    return v is not None and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v)


def turned(v, omega, angle):
    axis = omega / np.linalg.norm(omega)
    return v * np.cos(angle) + np.cross(axis, v) * np.sin(angle) + axis * (axis @ v) * (1 - np.cos(angle))


def hamilton(a, b):
    return np.array([a[0] * b[0] - a[1:] @ b[1:], *(a[0] * b[1:] + b[0] * a[1:] + np.cross(a[1:], b[1:]))])


def whole_gyro(rows):
    """(problem or None, backward, duplicate, gaps, {time: attitude}) of one source."""
    rows = [r for r in sorted(rows, key=lambda r: r[1]) if r[2] is not None and math.isfinite(r[2]) and usable(r[3])]
    steps = [b[2] - a[2] for a, b in zip(rows, rows[1:])]
    first = {}
    for r in rows:
        first.setdefault(r[2], np.radians(r[3]))
    times = sorted(first)
    spans = [b - a for a, b in zip(times, times[1:])]
    counts = sum(x < 0 for x in steps), sum(x == 0 for x in steps), sum(x > 100 for x in spans)
    if len(times) < 2 or max(spans) > 2000:
        return ("too few samples" if len(times) < 2 else "gap too long"), *counts, {}
    q, out = np.array([1.0, 0, 0, 0]), {times[0]: [1.0, 0, 0, 0]}
    for a, b in zip(times, times[1:]):
        omega = (first[a] + first[b]) / 2
        speed = np.linalg.norm(omega)
        if speed > 1e-12:
            half = speed * (b - a) / 2000
            q = hamilton(q, np.array([np.cos(half), *(omega / speed * np.sin(half))]))
        out[b] = q.tolist()
    return None, *counts, out


def whole_gravity(rows):
    """(corrections, sign, {time: direction}) of one source, or None."""
    rows = sorted((r for r in rows if r[2] is not None and math.isfinite(r[2])), key=lambda r: r[2])
    n, sizes = max(len(rows) // 4096, 1), []
    smooth, elapsed, before = None, 0.0, None
    for i, (_, _, t, _, a) in enumerate(rows):
        dt = (t - before) / 1000 if before is not None and t > before else 0.001
        if dt > 0.1:
            smooth, elapsed = None, 0.0
        if usable(a):
            k = min(max(dt / (0.25 + dt), 1e-4), 1.0)
            smooth = np.array(a) if smooth is None else smooth * (1 - k) + np.array(a) * k
        elapsed, before = elapsed + dt, t
        if smooth is not None and elapsed >= 1 and i % n == 0 and 2 <= np.linalg.norm(smooth) <= 50:
            sizes.append(np.linalg.norm(smooth))
    if len(sizes) < 16:
        return None
    gravity, best = sorted(sizes)[len(sizes) // 2], None
    for sign in (-1.0, 1.0):
        state, smooth, elapsed, before, found, angles = None, None, 0.0, None, {}, []
        for _, _, t, g, a in rows:
            step = (t - before) / 1000 if before is not None and t > before else None
            if step is not None and step > 0.1:
                state, smooth, elapsed = None, None, 0.0
            elif state is not None and step is not None and usable(g) and np.linalg.norm(g) > 1e-9:
                omega = np.radians(g)
                state = turned(state, omega, sign * np.linalg.norm(omega) * step)
            dt = min(max(0.001 if step is None else step, 1e-4), 0.1)
            if usable(a):
                k = min(max(dt / (0.25 + dt), 1e-4), 1.0)
                smooth = np.array(a) if smooth is None else smooth * (1 - k) + np.array(a) * k
            elapsed, before = elapsed + dt, t
            size = np.linalg.norm(smooth) if smooth is not None and elapsed >= 1 else 0.0
            if 0.65 * gravity <= size <= 1.35 * gravity:
                if state is None:
                    state = -smooth / size
                elif (away := math.degrees(math.acos(np.clip(state @ -smooth / size, -1, 1)))) <= 35:
                    angles.append(away)
                    k = min(max(dt / (1.5 + dt), 1e-4), 0.08)
                    state = state * (1 - k) - smooth / size * k
                    state = state / np.linalg.norm(state)
            if state is not None:
                found.setdefault(t, []).append(state.tolist())
        rms = math.sqrt(np.mean(np.square(angles))) if angles else math.inf
        if sum(map(len, found.values())) >= 16 and len(angles) >= 16 and rms <= 15 and (best is None or (len(angles), -rms) >= best[:2]):
            best = len(angles), -rms, sign, found
    return best and (best[0], best[2], best[3])


def inertial(gap=150.0, long=False):
    """Sources that turn, with gaps, repeated and backward times, broken rows, and more samples than one stride."""
    rng = np.random.default_rng(5)
    rows = []
    for name, n in (("a", 700), ("b", 260), ("c", 5), ("d", 1), ("many", 8400)):
        t = 0.0
        for i in range(n):
            t += gap if i and i % 230 == 0 else 0.0 if i % 97 == 50 else 10.0
            g = (np.array([6 * math.sin(i / 50), 2.0, -5 * math.cos(i / 70)]) + rng.normal(0, 1, 3)).tolist()
            a = (np.array([2 * math.sin(i / 90), 1.0, 9.6]) + rng.normal(0, 0.3, 3)).tolist()
            if i % 41 == 7:
                g = [None, g, [math.nan, 0.0, 0.0], [1.0, None, 0.0], [1.0]][i % 5]
            if i % 53 == 9:
                a = [None, a, [math.inf, 0.0, 0.0], [], a][i % 5]
            rows.append((name, i, [t, None, math.nan][i % 3] if i % 113 == 60 else t, g, a))
    rows += [("late", i, 5000.0 - 10 * i if i < 300 else 9000.0, [1.0, 2.0, 3.0], [0.0, 0.0, 9.8]) for i in range(301 if long else 300)]
    return [*rows, ("broken", 0, math.nan, None, None), ("broken", 1, 1.0, None, None)]


def sources(rows):
    return {name: [r for r in rows if r[0] == name] for name in dict.fromkeys(r[0] for r in rows)}


@pytest.mark.parametrize("bucket", [730.0, 3_600_000.0])
def test_gyro_by_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(motion, "FOLD_MS", bucket)
    monkeypatch.setattr(motion, "BUCKET_ROWS", 64)
    rows = inertial(long=True)
    got = {}
    for r in motion.integrate_gyro(spark.createDataFrame(rows, SCHEMA), ["source"]).collect():
        got.setdefault(r.source, []).append(r)
    assert {g[0].problem for g in got.values()} == {None, "too few samples", "gap too long"}
    for name, own in sources(rows).items():
        problem, *counts, path = whole_gyro(own)
        assert {(r.problem, r.backward, r.duplicate, r.gaps) for r in got[name]} == {(problem, *counts)}, name
        assert len(got[name]) == max(len(path), 1)
        for r in got[name] if path else []:
            assert np.allclose(r.q, path[r.ts], atol=1e-9)


@pytest.mark.parametrize("bucket", [730.0, 3_600_000.0])
def test_gravity_by_segments(spark, monkeypatch, bucket):
    monkeypatch.setattr(motion, "FOLD_MS", bucket)
    # rows of one time have no order of their own: here they are alike, broken ones among them
    rows, seen = [], {}
    for r in inertial():
        rows.append((*r[:3], *seen.setdefault((r[0], r[2]), r[3:])))
    got = {}
    for r in motion.fuse_gravity(spark.createDataFrame(rows, SCHEMA), ["source"]).collect():
        got.setdefault(r.source, []).append(r)
    wanted = {name: w for name, own in sources(rows).items() if (w := whole_gravity(own))}
    assert set(got) == set(wanted) and {"a", "b", "many"} <= set(got)
    for name, (corrections, sign, path) in wanted.items():
        assert {(r.corrections, r.gyro_sign) for r in got[name]} == {(corrections, sign)}
        assert len(got[name]) == sum(map(len, path.values()))
        for r in got[name]:
            assert any(np.allclose(r.v, v, atol=1e-9) for v in path[r.ts])


def test_size_of_gravity_is_of_all_samples(spark):
    """Every third sample is larger, and every third was all that long sources were judged by: the smaller ones were then no gravity."""
    rows = [("s", i, i * 100.0, [0.0, 0.0, 0.0], [0.0, 0.0, 5.0 if i % 3 else 40.0]) for i in range(12_300)]
    got = motion.fuse_gravity(spark.createDataFrame(rows, SCHEMA), ["source"]).collect()
    assert len(got) > 12_280 and all(r.corrections > 12_280 for r in got)


@pytest.mark.parametrize("rows_each", [100, 4096])
def test_gravity_of_long_and_short_sources(spark, monkeypatch, rows_each):
    """sources folded whole give what they give by segments, in any order of rows and however few rows a step has."""
    rows, seen = [], {}
    for r in inertial():
        rows.append((*r[:3], *seen.setdefault((r[0], r[2]), r[3:])))
    rows = [rows[i] for i in np.random.default_rng(3).permutation(len(rows))]
    wanted = {name: w for name, own in sources(rows).items() if name != "many" and (w := whole_gravity(own))}
    results = []
    for long in (500, 32_768):
        monkeypatch.setattr(motion, "STEP_LONG", long)
        monkeypatch.setattr(motion, "STEP_ROWS", rows_each)
        got = motion.fuse_gravity(spark.createDataFrame(rows, SCHEMA), ["source"]).collect()
        results.append(sorted((r.source, r.ts, *np.round(r.v, 9) + 0.0, r.corrections, round(r.rms_deg, 9), r.gyro_sign) for r in got))
        for name, (corrections, sign, path) in wanted.items():
            own = [r for r in got if r.source == name]
            assert {(r.corrections, r.gyro_sign) for r in own} == {(corrections, sign)} and len(own) == sum(map(len, path.values()))
    assert len(results[0]) == len(results[1]) and {"a", "many"} <= {r[0] for r in results[0]}
    for a, b in zip(*results):
        assert a[0] == b[0] and np.allclose(a[1:], b[1:], atol=1e-7)


def test_gravity_query_moves_no_samples(spark):
    """what the query writes between its steps are rows of events, not their 301 samples each."""
    import glob

    import pyarrow.parquet as pq

    from quillon import registry, storage

    files = lambda: set(glob.glob(f"{storage.scratch_dir(spark)}/**/*.parquet", recursive=True))
    before = files()
    sf = "/root/testdata/sf0.001"
    n = registry.QUERIES["gravity_fusion"](spark, sf).count()
    assert n == spark.read.parquet(f"{sf}/events.parquet").count()
    assert sum(pq.read_metadata(f).num_rows for f in files() - before) == n


def test_folds_of_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert motion.integrate_gyro(none, ["source"]).count() == 0
    assert motion.fuse_gravity(none, ["source"]).count() == 0


def test_folds_in_step_are_the_folds():
    """Many segments at once give what each gives by itself: nulls, bad vectors, equal times, lengths of one row and more."""
    rng = np.random.default_rng(12)
    cols, bounds = [[] for _ in range(9)], [0]
    for n in [1, 2, 150, 700, 301, 301, 90]:
        ts = np.cumsum(rng.choice([0.0, 5.0, 10.0, 60.0], n))
        magnitude, sign = rng.uniform(9, 11), rng.choice([-1.0, 1.0])
        for i in range(n):
            bad = rng.integers(0, 40)
            odd = {0: None, 1: [1.0, 2.0], 2: [1.0, None, 2.0], 3: [1.0, math.nan, 2.0]}
            g = odd[bad] if bad in odd else (rng.normal(0, 30, 3) * (bad > 8)).tolist()
            a = odd[bad - 4] if bad - 4 in odd else [0.0, float(rng.normal()), 9.8]
            row = (ts[i], ts[i - 1] if i else None, g, a, magnitude, sign, 7, 1.5, bool(rng.integers(0, 2)))
            for c, v in zip(cols, row):
                c.append(v)
        bounds.append(bounds[-1] + n)
    kinds = [pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.bool_()]
    arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
    for picked, fold, step in (
        ([0, 1, 3, 8], motion._settled_lengths, motion._settled_in_step),
        ([0, 1, 2, 3, 4], motion._trial, motion._trial_in_step),
        ([0, 1, 2, 3, 4, 5, 6, 7], motion._directions, motion._directions_in_step),
    ):
        of, made = step([arrays[i] for i in picked], np.array(bounds))
        made = [c.to_pylist() if isinstance(c, pa.Array) else c.tolist() for c in made]
        seen = 0
        for s, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
            want = list(fold(tuple(cols[i][r] for i in picked) for r in range(lo, hi)))
            got = [tuple(c[r] for c in made) for r in np.flatnonzero(of == s)]
            assert len(got) == len(want)
            seen += len(want)
            for g, w in zip(got, want):
                assert np.allclose(np.hstack(g), np.hstack(w), rtol=1e-9, atol=1e-9)
        assert seen > 10
