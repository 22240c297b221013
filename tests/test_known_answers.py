"""Known answers on small literal tables."""

import json
import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import documents as D
from quillon.functions import numeric as N
from quillon.functions import quaternion as Q
from quillon.functions import strings as S
from quillon.operators import asof, calibration, colour, gates, graph, motion, raster, relational, retrieval, selection, statistics
from quillon.sources import files, text_model
from quillon.storage import materialize
from quillon.streaming import events

HALF = math.sqrt(0.5)
IDENT, Z90 = [1.0, 0.0, 0.0, 0.0], [HALF, 0.0, 0.0, HALF]
SERIES = "source string, ts double, pos long, q array<double>"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def quat(q):
    return tuple(F.lit(x) for x in q)


def angle(a, b):
    return math.degrees(2 * math.acos(min(1, abs(float(np.dot(a, b))))))


def test_quaternion_rules(spark):
    nan = float("nan")
    assert list(one(spark, *Q.normalize(quat([2.0, 0.0, 0.0, 0.0])))) == IDENT
    assert one(spark, Q.normalize(quat([0.0] * 4))[0], Q.normalize(quat([nan, 0.0, 0.0, 0.0]))[0]) == (None, None)
    a = one(spark, Q.angle_degrees(quat(IDENT), quat(Z90)), Q.angle_degrees(quat(IDENT), quat([-1.0, 0.0, 0.0, 0.0])), Q.angle_degrees(quat(IDENT), quat([0.0] * 4)))
    assert abs(a[0] - 90) < 1e-9 and a[1] == 0 and a[2] == float("inf")
    half = one(spark, *Q.slerp(quat(IDENT), quat(Z90), F.lit(0.5)))
    assert abs(angle(half, IDENT) - 45) < 1e-9
    assert one(spark, Q.slerp(quat(IDENT), quat(Z90), F.lit(nan))[0], Q.slerp(quat(IDENT), quat(Z90), F.lit(1.1))[0]) == (None, None)
    up, down, x = Q.lit(0, 1, 0), Q.lit(0, -1, 0), Q.lit(1, 0, 0)
    assert one(spark, Q.shortest_arc(up, down)[0])[0] is None
    assert list(one(spark, *Q.shortest_arc(up, up))) == IDENT
    turned = one(spark, *Q.rotate(Q.shortest_arc(x, down), x))
    assert np.allclose(turned, [0, -1, 0])
    m = Q.left_matrix(quat(Z90))[1], Q.right_matrix(quat(Z90))[1]
    assert np.allclose(one(spark, *m[0], *m[1]), [0, HALF, -HALF, 0, 0, HALF, HALF, 0])
    assert np.allclose(one(spark, *Q.remap(quat(IDENT), tuple(Z90), (HALF, 0, 0, -HALF))), IDENT)


def test_view_overlap(spark):
    f, b = Q.lit(0, 0, 1), Q.lit(0, 0, -1)
    got = one(spark, Q.views_overlap(f, b, F.lit(80.0), F.lit(80.0)), Q.views_overlap(f, f, F.lit(45.0), F.lit(45.0)), Q.views_overlap(f, b, F.lit(0.0), F.lit(80.0)))
    assert tuple(got) == (False, True, None)


def test_covariance(spark):
    eye = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    bad = F.array(*[F.lit(float(x)) for x in (1, 2, 0, 2, 1, 0, 0, 0, 1)])
    assert tuple(one(spark, Q.covariance_is_psd(eye), Q.covariance_is_psd(bad))) == (True, False)


def test_numeric_rules(spark):
    nan, inf = float("nan"), float("inf")
    got = one(spark, N.is_finite(F.lit(nan)), N.is_finite(F.lit(-inf)), N.is_finite(F.lit(None)), N.is_finite(F.lit(2)))
    assert tuple(got) == (False, False, False, True)
    assert one(spark, N.coverage_ratio(F.lit(0), F.lit(0)), N.coverage_ratio(F.lit(1), F.lit(4))) == (0.0, 0.25)
    got = one(spark, N.fraction(F.lit("30000/1001")), N.fraction(F.lit("25")), N.fraction(F.lit("1/0")), N.fraction(F.lit("x")))
    assert abs(got[0] - 29.97003) < 1e-5 and tuple(got)[1:] == (25.0, None, None)
    got = one(spark, *[N.percent_of(F.lit(x)) for x in (0.5, 1.0, 42.4, 300.0, -1.0, nan)])
    assert tuple(got) == (50, 100, 42, 100, 0, 0)
    assert one(spark, N.close_to(F.lit(1.0 + 1e-11), F.lit(1.0)), N.close_to(F.lit(1.0 + 1e-9), F.lit(1.0))) == (True, False)
    assert one(spark, N.eta_ms(F.lit(100), F.lit(10), F.lit(30), F.lit(0)))[0] == 200.0
    assert one(spark, N.eta_ms(F.lit(100), F.lit(0), F.lit(0), F.lit(4)))[0] is None


def test_string_rules(spark):
    lit = F.lit
    got = one(spark, S.trailing_number(lit("front_00000012")), S.trailing_number(lit("none")), S.base_name(lit("a\\b/c.png/")), S.mask_path(lit("a.b/c.JPG")))
    assert tuple(got) == (12, None, "c.png", "a.b/c.png")
    got = one(spark, S.safe_directory_name(lit("a<b>>c")), S.safe_directory_name(lit("??")), S.safe_directory_name(lit("Com1.x")), S.safe_directory_name(lit("é" * 100)))
    assert tuple(got)[:3] == ("a-b-c", None, "Com1.x-project") and got[3] == "é" * 60
    got = one(spark, S.redact(lit("cannot open /usr/local/x y")), S.redact(lit("at C:\\Program Files\\x")), S.redact(lit("see http://a/b")), S.redact(lit("(/Users/me/x")))
    assert tuple(got) == ("cannot open <path>", "at <windows path>", "see http://a/b", "(/Users/<user>")
    assert one(spark, S.fingerprint(lit("abc")))[0].startswith("ba7816bf")
    got = one(spark, S.epoch_ms(lit("1700000000")), S.epoch_ms(lit("2023-11-14T22:13:20Z")), S.epoch_ms(lit("x")), S.epoch_ms(lit(1700000000000)))
    assert tuple(got) == (1700000000000, 1700000000000, None, 1700000000000)
    got = one(spark, *[S.duration_text(lit(x)) for x in (None, 500, 61_000, 3_720_000)])
    assert tuple(got) == ("Not timed yet", "Less than 1 second", "1 min 01 sec", "1 hr 02 min")
    got = one(spark, S.version_at_least(lit("tool 4.1.1 (x)"), (4, 1, 1)), S.version_at_least(lit("4.1.0"), (4, 1, 1)), S.version_at_least(lit("none"), (4, 1, 1)), S.is_version(lit("1.02.3")))
    assert tuple(got) == (True, False, False, False)
    assert tuple(one(spark, *S.brand_and_model(lit("DJI"), lit("dji - Osmo 360")))) == ("DJI", "Osmo 360")


def series(spark, rows, source="s"):
    return spark.createDataFrame([(source, float(t), i, q) for i, (t, q) in enumerate(rows)], SERIES)


def at(spark, samples, probes, **options):
    p = spark.createDataFrame([("s", float(x)) for x in probes], "source string, ts double")
    rows = asof.attitude_at(samples, p, ["source"], **options).collect()
    return {r.ts: r.q for r in rows}


def test_asof(spark):
    got = at(spark, series(spark, [(100, Z90), (0, IDENT)]), [50, -1, 101, 0, 100])
    assert abs(angle(got[50.0], IDENT) - 45) < 1e-9 and got[-1.0] is None and got[101.0] is None
    assert got[0.0] == IDENT and np.allclose(got[100.0], Z90)
    got = at(spark, series(spark, [(0, IDENT), (0, Z90), (50, Z90)]), [0])
    assert angle(got[0.0], IDENT) > 89.9  # the later row of a time counts
    got = at(spark, series(spark, [(0, IDENT), (200, Z90)]), [0, 100, 200], max_gap_ms=100)
    assert got[0.0] and got[200.0] and got[100.0] is None


def test_asof_over_bucket_borders(spark):
    samples = series(spark, [(0, IDENT), (9_000_000, Z90)])
    assert abs(angle(at(spark, samples, [4_500_000])[4_500_000.0], IDENT) - 45) < 1e-9
    p = spark.createDataFrame([("s", float("nan")), ("other", 1.0)], "source string, ts double")
    assert [r.q for r in asof.attitude_at(samples, p, ["source"]).collect()] == [None, None]


def test_diagnostics(spark):
    rows = series(spark, list(zip([0, 100, 50, 50, 200], [IDENT, IDENT, Z90, [0.0] * 4, [0.0, 0.0, 0.0, 1.0]])))
    r = motion.attitude_diagnostics(rows, ["source"]).first()
    assert (r.total, r.valid, r.invalid, r.backward, r.duplicate, r.first_ms, r.last_ms) == (5, 4, 1, 1, 1, 0, 200)
    assert r.jumps == 0 and abs(r.max_step_deg - 90) < 1e-6


def test_gyro(spark):
    def run(ts, rate=450.0):
        df = spark.createDataFrame([("s", float(t), i, [0.0, 0.0, rate]) for i, t in enumerate(ts)], "source string, ts double, pos long, gyro array<double>")
        return motion.integrate_gyro(df, ["source"]).orderBy("ts").collect()

    rows = run([0, 100])
    assert abs(angle(rows[0].q, rows[1].q) - 45) < 1e-6
    assert run([0, 2001])[0].problem == "gap too long" and run([0])[0].problem == "too few samples"


def test_gravity_fusion(spark):
    still = [("s", i * 10.0, [0.0, 0.0, 0.0], [0.0, 0.0, 9.81]) for i in range(201)]
    df = spark.createDataFrame(still, "source string, ts double, gyro array<double>, accl array<double>")
    rows = motion.fuse_gravity(df, ["source"]).collect()
    assert len(rows) >= 50 and all(np.allclose(r.v, [0, 0, -1]) for r in rows)


def rotations(n, step, f):
    out = []
    for i in range(n):
        axis = np.array([math.sin(0.31 * i), math.cos(0.23 * i), math.sin(0.17 * i + 1)])
        axis /= np.linalg.norm(axis)
        h = math.radians(f(i)) / 2
        out.append((i * step, np.concatenate(([math.cos(h)], math.sin(h) * axis))))
    return out


def test_calibration(spark):
    h = math.radians(52) / 2
    axis = np.array([0.3, -0.8, 0.4]) / np.linalg.norm([0.3, -0.8, 0.4])
    x = np.concatenate(([math.cos(h)], math.sin(h) * axis))
    tele = rotations(90, 40, lambda i: 12 * math.sin(0.42 * i) + 7 * math.cos(0.17 * i))
    visual = series(spark, [(t, motion.product(x, q).tolist()) for t, q in tele])
    telemetry = series(spark, [(t + 80, q.tolist()) for t, q in tele])
    r = calibration.calibrate(visual, telemetry, ["source"]).first()
    assert r.valid and r.convention == "as-provided" and abs(r.offset_ms - 80) <= 5 and r.correlation > 0.99
    assert angle(r.x, x) < 1e-4 and r.residual_deg < 1e-4
    still = series(spark, [(t, [math.cos(0.0004 * i), math.sin(0.0004 * i), 0.0, 0.0]) for i, (t, _) in enumerate(tele[:16])])
    assert calibration.best_offset(still, still, ["source"]).first().problem == "low excitation"
    with pytest.raises(ValueError):
        calibration.Config(offset_step_ms=0)


@pytest.mark.parametrize(
    "gravity,problem,degrees",
    [([[0.0, -1.0, 0.0]] * 8, None, 0), ([[1.0, 0.0, 0.0]] * 8, None, 90), ([[0.0, -1.0, 0.0]] * 7, "too few observations", None),
     ([[0.0, -1.0, 0.0]] * 8 + [[0.0, 1.0, 0.0]] * 2, None, 0), ([[0.0, 1.0, 0.0]] * 8, "upside down", None),
     ([[0.0, -1.0, 0.0], [0.0, 1.0, 0.0]] * 5, "directions cancel", None)],
)
def test_gravity_alignment(spark, gravity, problem, degrees):
    images = spark.createDataFrame([(1, f"f{i}", IDENT) for i in range(len(gravity))], "m int, name string, q array<double>")
    priors = spark.createDataFrame([(1, f"f{i}", g) for i, g in enumerate(gravity)], "m int, name string, gravity array<double>")
    r = statistics.gravity_alignment(images, priors, ["m"]).first()
    assert r.problem == problem
    if problem is None:
        assert abs(r.rotation_deg - degrees) < 1e-6 and r.inliers == 8


def test_pearson(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5)], "x double, y double")
    assert abs(df.agg(statistics.pearson("x", "y")).first()[0] - np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1]) < 1e-12
    assert df.agg(statistics.pearson("x", F.lit(1.0))).first()[0] is None
    assert df.limit(1).agg(statistics.pearson("x", "y")).first()[0] is None


def frames(rows):
    return [{"ts": t, "q": q, "proxy": p, "is_last": last} for t, q, p, last in rows]


def test_pruner():
    turn = lambda d: [math.cos(math.radians(d) / 2), 0.0, 0.0, math.sin(math.radians(d) / 2)]
    config = selection.Pruning(min_rotation_deg=5, min_gap_ms=100, max_gap_ms=1000, min_novelty=0.05)
    p = selection.Pruner(config)
    got = [p.decide(**f) for f in frames([(0.0, turn(0), None, False), (50.0, turn(9), None, False), (200.0, turn(10), None, False)])]
    assert [g["reason"] for g in got] == ["first", "belowThreshold", "rotation"]
    assert abs(got[2]["rotation_deg"] - 10) < 1e-9 and abs(got[2]["speed_dps"] - 50) < 1e-9
    p = selection.Pruner(config)
    flat, lit = np.zeros((2, 4)), np.array([[0.0] * 4, [30.0] * 4])
    got = [p.decide(**f)["reason"] for f in frames([(0.0, None, flat, False), (200.0, None, lit, False), (210.0, None, lit, True)])]
    assert got == ["first", "visualNovelty", "last"]
    p = selection.Pruner(config)
    p.decide(100.0, None, None, False)
    assert "timestampDiscontinuity" in p.decide(50.0, None, None, False)["reason"]
    assert p.decide(60.0, [0.0] * 4, None, False)["reason"] == "invalidImu"
    with pytest.raises(ValueError):
        p.decide(float("nan"), None, None, False)


def test_best_pair_takes_the_minimum_and_the_earliest(spark):
    rows = spark.createDataFrame([(1, 0, 5.0), (1, 1, 5.0), (1, 2, 4.0)], "i int, seq int, score double")
    best = selection.best_per_interval(rows, ["i"], "score", "seq").filter("selected").collect()
    assert [r.seq for r in best] == [0]
    got = one(spark, selection.rate_interval(F.lit(1), 4.0, 1.0), selection.rate_interval(F.lit(5), 4.0, 1.0))
    assert tuple(got) == (0, 1)


def test_retrieval(spark):
    rows = [("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0]), ("b", 0, [0.99, 0.14]), ("b", 1, [0.14, 0.99]), ("c", 0, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "source string, frame int, descriptor array<double>")
    got = retrieval.retrieve(df).orderBy("frame_a").collect()
    assert [(r.source_a, r.source_b, r.frame_a, r.frame_b, r.mutual) for r in got] == [("a", "b", 0, 0, True), ("a", "b", 1, 1, True)]
    assert retrieval.Retrieval(max_anchors=10_000).max_anchors == 256
    with pytest.raises(ValueError):
        retrieval.Retrieval(top_k=0)


def test_components(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (None, 3), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(path).collect()}
    assert {got[i] for i in range(201)} == {0} and got[501] == 500 and len(got) == 203
    empty = graph.connected_components(path.limit(0))
    assert empty.count() == 0 and tuple(graph.component_summary(empty).first()) == (0, None)
    assert one(spark, graph.lenses_of(F.lit("lens1/x")), graph.lenses_of(F.lit("x"))) == ([1], [0, 1])


def test_gates(spark):
    row = "kp_rows int, kp_cols int, kp_bytes int, desc_rows int, desc_cols int, desc_bytes int"
    cases = [((1, 4, 16, 1, 128, 128), "complete"), ((0, 6, 0, 0, 128, 0), "complete"), ((None, None, None, 1, 128, 128), "incomplete"),
             ((1, 4, 4, 1, 128, 128), "keypoint bytes"), ((1, 3, 12, 1, 128, 128), "keypoint columns")]
    df = spark.createDataFrame([c for c, _ in cases], row)
    assert [r[0] for r in df.select(gates.feature_status()).collect()] == [s for _, s in cases]
    cam = "model int, width int, height int, params array<double>, source string, verified boolean"
    rows = [(5, 128, 128, [100.0, 100.0, 64.0, 64.0, 0.0, 0.0, 0.0, 0.0], "metadata", True), (5, 128, 128, [100.0, 100.0, 64.0, 64.0, 0.0, 0.0, 0.0, 0.0], "default", True),
            (5, 128, 128, [38.4, 38.4, 64.0, 64.0, 0.0, 0.0, 0.0, 0.0], "metadata", True), (17, 1, 1, [1.0], "metadata", True), (0, 10, 10, [1.0, 2.0], "metadata", True)]
    got = gates.focal_status(spark.createDataFrame(rows, cam)).select("status").collect()
    assert sorted(r[0] for r in got) == ["accepted", "default guess", "model", "parameter count", "source"]
    nan = F.array(F.lit(float("nan")), F.lit(float("nan")))
    mixed = F.array(F.lit(float("nan")), F.lit(1.0))
    assert tuple(one(spark, gates.matrix_state(nan), gates.matrix_state(mixed), gates.matrix_state(F.array(F.lit(1.0))))) == ("unknown", "mixed", "known")
    names = lambda *x: F.array(*[F.lit(n) for n in x])
    got = one(spark, gates.model_format(names("cameras.bin", "images.bin", "points3D.bin")), gates.model_format(names("cameras.txt")), gates.model_format(names("x")))
    assert tuple(got) == ("binary", "partial_text", "missing")
    assert one(spark, gates.promotes(F.lit(0.5), F.lit(1), F.lit(0.428), F.lit(6)))[0] is False
    blob = spark.createDataFrame([(np.arange(3.0).tobytes(),), (b"123",), (None,)], "b binary").mapInPandas(gates.unpack_doubles("b", "v"), "v array<double>")
    assert [r.v for r in blob.collect()] == [[0.0, 1.0, 2.0], None, None]


def test_upsert(spark):
    target = spark.createDataFrame([(1, 10, [1.0, 2.0, 3.0], None), (2, 20, None, None)], "id long, key long, position array<double>, g double")
    changes = spark.createDataFrame([(10, 5.0), (30, 6.0), (40, 7.0)], "key long, g double")
    unknown = F.array(*[F.lit(float("nan"))] * 3)
    out = {r.key: r for r in relational.upsert(target, changes, ["key"], "id", {"position": F.coalesce("position", unknown)}, ["g"], {"position": unknown}).collect()}
    assert out[10].position == [1.0, 2.0, 3.0] and out[10].g == 5.0 and out[20].g is None
    assert {out[30].id, out[40].id} == {3, 4} and math.isnan(out[30].position[0])
    twice = target.unionByName(target)
    with pytest.raises(Exception, match="ambiguous"):
        relational.upsert(twice, changes, ["key"], "id", {}, ["g"], {}).collect()


def test_checked_write(spark, tmp_path):
    df = spark.range(10)
    with pytest.raises(ValueError, match="odd"):
        relational.write_checked(df, f"{tmp_path}/x", [("odd rows", df.filter("id % 2 = 1"))])
    assert relational.write_checked(df, f"{tmp_path}/x", [("none", df.filter("id > 99"))]) == 10
    assert relational.schema_issues(df, spark.createDataFrame([], "id int, name string").schema) == ["missing name", "type of id"]
    assert materialize(df, "t").count() == 10


def test_colour(spark):
    rows = [(1, "color_profile", "D-Log M", "a_D.mp4"), (1, "encoder", "DJI Osmo 360", "a_D.mp4"), (2, "pictureProfile", "I-Log", "b"), (2, "model", "Insta360 X5", "b"), (3, "gamma_mode", "vivid", "c"), (4, "x", "y", "d")]
    got = {r.s: r for r in colour.detect(spark.createDataFrame(rows, "s int, key string, value string, path string"), "s").collect()}
    assert (got[1].profile, float(got[1].confidence), got[1].should_apply) == ("dlog_m", 0.99, True)
    assert (got[2].profile, float(got[2].confidence), got[2].should_apply) == ("ilog", 0.99, True)
    assert (got[3].profile, float(got[3].confidence)) == ("unknown", 0.9) and float(got[4].confidence) == 0
    assert one(spark, colour.resolve(F.lit("auto"), F.lit("ilog"), F.lit(False)))[0] == "none"


def test_documents(spark):
    doc = F.lit('{"a":{"b":[1,{"c":"x"}]},"t":true,"n":null}')
    assert [tuple(p) for p in one(spark, D.flatten(doc))[0]] == [("b", "1"), ("c", "x")]
    assert json.loads(one(spark, D.deep_merge(F.lit('{"a":{"x":1},"b":2}'), F.lit('{"a":{"y":3},"b":[]}')))[0]) == {"a": {"x": 1, "y": 3}, "b": []}
    assert one(spark, D.pointer(doc, "/a/b/1/c"))[0] == "x"
    assert one(spark, D.deep_merge(F.lit("bad"), F.lit('{"a":1}')))[0] == '{"a":1}'


@pytest.fixture()
def model_folder(tmp_path):
    (tmp_path / "cameras.txt").write_text("# c\n1 OPENCV 128 64 1.0 x 2.0\nbad\n")
    (tmp_path / "images.txt").write_text("# i\nbad line\n9 1 0 0 0 1 2 3 1 lens0/my frame.jpg\n1 2 5 3 4 -1 7 8\n10 1 0 0 0 1 2 3 1 b.jpg\n1 2 6\n")
    (tmp_path / "points3D.txt").write_text("5 1 2 3 10 20 30 0.5 9 0 10 1\n6 1 2 3 999 0 0 1\n")
    (tmp_path / "frames.txt").write_text("7 1 1 0 0 0 0 0 0 2 CAMERA 1 9 CAMERA 2\n")
    return str(tmp_path)


def test_text_model(spark, model_folder, tmp_path):
    model, missing = text_model.read_model(spark, model_folder)
    assert missing == []
    cam = model["cameras"].collect()
    assert [(c.camera_id, c.params) for c in cam] == [(1, [1.0, 2.0])]
    img = {r.image_id: r for r in model["images"].collect()}
    assert img[9].name == "lens0/my frame.jpg" and img[9].observed_point_count == 1 and img[9].frame_id == 7 and img[10].observed_point_count == 1
    pts = model["points3D"].collect()
    assert len(pts) == 1 and [tuple(t) for t in pts[0].track] == [(9, 0), (10, 1)]
    assert [len(f.data) for f in model["frames"].collect()] == [1]
    with pytest.raises(FileNotFoundError):
        text_model.require_model(spark, f"{tmp_path}/none")
    lines = spark.createDataFrame([(["LUT_3D_SIZE", "2"],)] + [(["0", "0.5", "1"],)] * 8, "tokens array<string>")
    assert text_model.colour_cube_status(lines).first().valid and not text_model.colour_cube_status(lines.limit(5)).first().valid
    assert tuple(text_model.pair_counts(spark.createDataFrame([(["a", "b"],), (["c"],)], "tokens array<string>")).first()) == (1, 1)


@pytest.mark.parametrize("size", [64, 150, 100_000])
def test_images_of_split_files(spark, tmp_path, size):
    """Files of many blocks give the images that one reading in order gives; runs of first lines go over blocks."""
    rng = np.random.default_rng(4)
    lines = []
    for i in range(300):
        kind = rng.integers(0, 6)
        lines.append(["", "# note", "no pose", "1.5 2.5 3 1.5 2.5 -1"][kind] if kind < 4 and not 100 < i < 140 else f"{i} 1 0 0 0 0 0 {i % 3} 7 a  b{i}.jpg")
    for name, part, end in (("a.txt", lines, "\n"), ("b.txt", lines[::-1], "\r\n")):
        (tmp_path / name).write_bytes(end.join(part).encode())
    want = []
    for part in (lines, lines[::-1]):
        data, i = [x.split() for x in part if x and not x.startswith("#")], 0
        while i < len(data):
            if len(data[i]) < 10:
                i += 1
                continue
            after = data[i + 1][2::3] if i + 1 < len(data) else []
            want.append((int(data[i][0]), " ".join(data[i][9:]), sum(x.lstrip("-").isdigit() and int(x) >= 0 for x in after)))
            i += 2
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        read = text_model.data_lines(spark, str(tmp_path))
        assert size > 1000 or read.select("file", "block").distinct().count() > 20
        got = text_model.images(read).select("image_id", "name", "observed_point_count").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted(map(tuple, got)) == sorted(want)


def test_files(spark, tmp_path):
    (tmp_path / "lens0").mkdir()
    (tmp_path / "lens0" / "f_0003.JPG").write_bytes(b"abc")
    (tmp_path / "lens0" / "f_0003.png").write_bytes(b"d")
    (tmp_path / "note.txt").write_text("x")
    listed = files.listing(spark, str(tmp_path))
    got = files.images(listed).orderBy("sort_key").collect()
    assert [(r.name, r.sequence) for r in got] == [("lens0/f_0003.JPG", 3), ("lens0/f_0003.png", 3)]
    assert all(r.conflict for r in files.mask_targets(listed).collect())
    digests = {r.name: r.sha256 for r in files.artifact_manifest(spark, str(tmp_path)).collect()}
    assert digests["lens0/f_0003.JPG"].startswith("ba7816bf")
    names = spark.createDataFrame([("sparse/1/x",), ("sparse/0/x",)], "name string")
    assert files.model_folder(names).first()[0] == "sparse/0"
    table = files.markdown_table(spark.createDataFrame([("A", 1, None), ("B", 2, 0.5)], "v string, n int, r double"), "v", ["n", "r"])
    assert table.splitlines()[2:] == ["| n | 1 | 2 |", "| r | - | 0.5 |"]
    kv = files.key_values(spark.createDataFrame([('NAME="x y"',), ("none",)], "value string")).collect()
    assert [tuple(r) for r in kv] == [("NAME", "x y")]
    files.write_document(spark.range(1), f"{tmp_path}/doc")
    assert files.json_documents(spark, f"{tmp_path}/doc", "id long, more string").first() == (0, None)


def test_raster():
    x = np.zeros((40, 40), np.uint8)
    assert raster.sharpness(x) == 0 and raster.sharpness((np.indices((40, 40)).sum(0) // 4 % 2 * 255).astype(np.uint8)) > 0
    assert raster.sharpness(np.zeros((3, 3), np.uint8)) == 0.0 and raster.global_descriptor(x) is None
    a = (np.indices((64, 64))[1] * 3).astype(np.uint8)
    assert abs(np.linalg.norm(raster.global_descriptor(a)) - 1) < 1e-12
    noise = np.random.default_rng(0).integers(40, 200, (64, 64)).astype(np.uint8)
    assert raster.block_means(noise, 8).shape == (8, 8) and raster.block_means(noise, 1)[0, 0] == noise.astype(int).sum() // noise.size
    assert selection.visual_novelty(raster.gradient_proxy(noise), raster.gradient_proxy(noise + 20)) < 0.01
    assert raster.resize_limit(1024, 256) == (512, 128) and raster.resize_limit(10, 20) == (10, 20)
    scale, left, top, w, h = raster.letterbox(200, 100, 100)
    assert (scale, left, top, w, h) == (0.5, 0, 25, 100, 50)
    assert raster.box_iou((0, 0, 2, 2), (1, 0, 3, 2)) == pytest.approx(1 / 3) and raster.box_iou((0, 0, 0, 0), (0, 0, 0, 0)) == 0
    boxes = np.array([[0, 0, 10, 10], [1, 0, 11, 10], [0, 0, 10, 10]], float)
    assert raster.suppress(boxes, np.array([0.9, 0.8, 0.7]), np.array([0, 0, 1])) == [0, 2]
    mask = raster.boxes_to_mask(np.ones((1, 4, 4)), np.array([[1.0]]), np.array([[1, 1, 3, 3]]))
    assert mask.sum() == 4 and mask[1:3, 1:3].all()
    assert not raster.sky_mask(np.ones((2, 2))).any() and raster.sky_mask(np.array([[0.0, 1.0]])).tolist() == [[False, True]]
    valid = raster.valid_region(100, 100, 0.49, [(0.2, 0.7), (0.5, 0.9), (0.8, 0.7)])
    assert valid[50, 50] and not valid[0, 0] and not valid[95, 50]
    assert raster.keep_mask(valid, [np.ones((2, 2), bool)]).min() == 255
    assert raster.letterbox_planes(np.zeros((4, 8, 3), np.uint8), 8).shape == (3, 8, 8)
    assert raster.standardise_planes(np.zeros((4, 8, 3), np.uint8)).shape == (3, 4, 8)
    assert raster.image(2, 2, b"123") is None


def test_stream_pruning_matches_the_table(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for s in ("a", "b"):
        for i in range(60):
            d = float(rng.uniform(0, 30))
            rows.append((s, i, i * 90.0, [math.cos(d / 50), math.sin(d / 50), 0.0, 0.0], [float(rng.integers(0, 255))], i == 59))
    schema = "source string, seq long, ts double, q array<double>, proxy array<double>, is_last boolean"
    df = spark.createDataFrame(rows, schema)
    want = {(r.source, r.seq): (r.kept, r.reason) for r in selection.prune_keyframes(df.drop("is_last"), ["source"]).collect()}
    for lo, hi in ((0, 20), (20, 45), (45, 60)):
        df.filter(f"seq >= {lo} and seq < {hi}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = (
        events.prune_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    assert q.exception() is None
    got = {(r.source, r.seq): (r.kept, r.reason) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want


def test_stream_sessions_and_log(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1)), (1, datetime(2024, 1, 1, 0, 0, 5)), (1, datetime(2024, 1, 1, 0, 5))]
    df = spark.createDataFrame(rows, "job int, ts timestamp")
    assert sorted(r.events for r in events.sessions(df, ["job"], "ts", "1 minute", "1 minute").collect()) == [1, 2]
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    files.event_log(stream, f"{tmp_path}/log", f"{tmp_path}/ck").awaitTermination(120)
    assert spark.read.json(f"{tmp_path}/log").count() == 3
    bound = events.bind_logs(df, df.select("job", "ts").limit(1), "job", "ts", "10 seconds", "1 minute")
    assert bound.count() >= 1
