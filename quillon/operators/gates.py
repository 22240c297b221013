"""Row validation and quality gates: each gives a status or a list of issues, never an exception mid-query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.numeric import col, coverage_ratio, is_finite
from quillon.functions.quaternion import covariance_is_psd

# The camera models by number, with the count of their parameters.
MODEL_PARAMETERS = {
    0: 3, 1: 4, 2: 4, 3: 5, 4: 8, 5: 8, 6: 12, 7: 5, 8: 4, 9: 5, 10: 12, 11: 16, 12: 4, 13: 5, 14: 3, 15: 4, 16: 6,
}
ONE_FOCAL = (0, 2, 3, 7, 8, 9, 12, 14)
MAX_DIMENSION = 100_000
TRUSTED_SOURCES = ("metadata", "view_graph_calibrator", "viewgraphcalibrator", "view-graph-calibrator")


def issues(*pairs) -> Column:
    """Names of the conditions that hold, in order; a null condition does not hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in pairs]))


def first_issue(*pairs, other: str | None = None) -> Column:
    out = F.lit(other)
    for name, cond in reversed(pairs):
        out = F.when(cond, F.lit(name)).otherwise(out)
    return out


def camera_models(spark: SparkSession) -> DataFrame:
    """model, n_params, focal and principal positions (from 0) of the seventeen models."""
    rows = [
        (m, n, [0] if m in ONE_FOCAL else [0, 1], [1, 2] if m in ONE_FOCAL else [2, 3]) for m, n in MODEL_PARAMETERS.items()
    ]
    return spark.createDataFrame(rows, "model int, n_params int, focal array<int>, principal array<int>")


def feature_status() -> Column:
    """State of an image's features by kp_rows, kp_cols, kp_bytes, desc_rows, desc_cols, desc_bytes.

    Either part missing is incomplete; all else that does not fit is corrupt.
    """
    kr, kc, kb, dr, dc, db = (F.col(c) for c in ("kp_rows", "kp_cols", "kp_bytes", "desc_rows", "desc_cols", "desc_bytes"))
    return first_issue(
        ("incomplete", kr.isNull() | dr.isNull()),
        ("negative keypoints", (kr < 0) | (kc < 0)),
        ("negative descriptors", (dr < 0) | (dc < 0)),
        ("keypoint columns", ~kc.isin(2, 4, 6)),
        ("descriptor columns", dc != 128),
        ("row counts differ", kr != dr),
        ("keypoint bytes", kb != kr * kc * 4),
        ("descriptor bytes", db != dr * dc),
        other="complete",
    )


def focal_status(cameras: DataFrame) -> DataFrame:
    """Adds ``status`` to cameras (model, width, height, params, source, verified).

    The models are a fixed table of seventeen rows.
    """
    models = F.broadcast(camera_models(cameras.sparkSession))
    out = cameras.join(models, "model", "left")
    pick = lambda places: F.transform(places, lambda i: F.get("params", i))
    focal, principal = pick("focal"), pick("principal")
    guess = F.lit(0.3) * F.greatest("width", "height")
    near = lambda x, y: F.abs(x - y) <= 1e-12
    rest = F.filter(F.sequence(F.lit(0), F.size("params") - 1), lambda i: ~F.array_contains(F.concat("focal", "principal"), i))
    default = (
        F.forall(focal, lambda x: near(x, guess))
        & near(F.get(principal, F.lit(0)), F.col("width") / 2)
        & near(F.get(principal, F.lit(1)), F.col("height") / 2)
        & F.forall(rest, lambda i: F.abs(F.get("params", i)) <= 1e-12)
    )
    bad_size = ~(F.col("width").between(1, MAX_DIMENSION) & F.col("height").between(1, MAX_DIMENSION))
    status = first_issue(
        ("model", F.col("n_params").isNull()),
        ("size", bad_size),
        ("parameter count", F.size("params") != F.col("n_params")),
        ("not finite", ~F.forall("params", is_finite)),
        ("focal length", F.exists(focal, lambda x: x <= 0)),
        ("source", ~F.lower(F.trim("source")).isin(*TRUSTED_SOURCES)),
        ("not verified", ~F.col("verified")),
        ("default guess", default),
        other="accepted",
    )
    return out.withColumn("status", status).drop("n_params", "focal", "principal")


def matrix_state(values: Column) -> Column:
    """unknown if all are NaN, known if all are finite, mixed otherwise."""
    return (
        F.when(F.forall(values, lambda x: F.isnan(x)), "unknown").when(F.forall(values, is_finite), "known").otherwise("mixed")
    )


def rig_status(pose: Column) -> Column:
    """State of a sensor's pose: seven finite values, a quaternion of length one within a thousandth."""
    size = F.sqrt(reduce(lambda a, b: a + b, [F.get(pose, F.lit(i)) * F.get(pose, F.lit(i)) for i in range(4)]))
    return first_issue(
        ("missing", pose.isNull()),
        ("length", F.size(pose) != 7),
        ("not finite", ~F.forall(pose, is_finite)),
        ("norm", F.abs(size - 1) > 1e-3),
        other="valid",
    )


def unpack_doubles(blob: str, out: str):
    """A function for mapInPandas that turns little-endian doubles of column ``blob`` into array ``out``; odd sizes are null."""
    import numpy as np

    def run(batches):
        for pdf in batches:
            pdf[out] = [None if b is None or len(b) % 8 else np.frombuffer(b, "<f8").tolist() for b in pdf[blob]]
            yield pdf.drop(columns=[blob])

    return run


def prior_issues(max_residual_deg: float = 5.0) -> Column:
    """Issues of an orientation prior (id, ts, q, covariance, weight, residual_deg)."""
    q = F.col("q")
    size = F.sqrt(F.aggregate(q, F.lit(0.0), lambda s, x: s + x * x))
    return issues(
        ("id", F.coalesce(F.trim("id"), F.lit("")) == ""),
        ("timestamp", ~is_finite("ts")),
        ("quaternion", (F.size(q) != 4) | ~F.forall(q, is_finite) | (size <= 2.220446049250313e-16)),
        ("covariance", F.col("covariance").isNotNull() & ~covariance_is_psd(F.col("covariance"))),
        ("weight", F.col("weight").isNotNull() & ~(is_finite("weight") & (F.col("weight") > 0))),
        ("residual", F.col("residual_deg").isNotNull() & ~(is_finite("residual_deg") & (F.col("residual_deg") <= max_residual_deg))),
    )


def prior_report(priors: DataFrame, expected: DataFrame, covered: DataFrame, by: list[str], offset_ms: float,
                 version: str, min_coverage: float = 0.8, max_offset_ms: float = 250.0) -> DataFrame:
    """One row per group: coverage, largest residual, order of times, and the issues of the set.

    ``expected`` are the frames, ``covered`` those with a prior near their time.
    """
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = F.when(is_finite("ts"), F.col("ts"))
    rows = priors.withColumn("_back", F.col("ts") < F.last(t, ignorenulls=True).over(w)).withColumn("_bad", F.size(prior_issues()) > 0)
    each = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("priors"), F.countDistinct("id").alias("ids"), F.max(F.when(is_finite("residual_deg"), F.col("residual_deg"))).alias("max_residual_deg"),
        F.count_if("_back").alias("backward"), F.count_if("_bad").alias("invalid"),
        F.count_if(~F.col("version").eqNullSafe(F.lit(version))).alias("other_version"),
    )
    total = expected.groupBy(*by).agg(F.count(F.lit(1)).alias("expected"))
    near = covered.groupBy(*by).agg(F.count(F.lit(1)).alias("covered"))
    out = total.join(near, by, "left").join(each, by, "left").fillna(0, ["covered", "priors", "ids", "backward", "invalid", "other_version"])
    out = out.withColumn("coverage", coverage_ratio("covered", "expected"))
    found = issues(
        ("offset", F.lit(abs(offset_ms) > max_offset_ms)),
        ("invalid prior", F.col("invalid") > 0),
        ("version", F.col("other_version") > 0),
        ("duplicate id", F.col("ids") < F.col("priors")),
        ("not monotonic", F.col("backward") > 0),
        ("coverage", F.col("coverage") < min_coverage),
    )
    out = out.withColumn("issues", found)
    return out.select(*by, "expected", "covered", "coverage", "max_residual_deg", (F.col("backward") == 0).alias("monotonic"),
                      "issues", (F.size("issues") == 0).alias("valid"))


def model_format(names: Column) -> Column:
    """Format of a model from the set of its file names."""
    has = lambda ext: [F.array_contains(names, f"{n}.{ext}") for n in ("cameras", "images", "points3D")]
    every = lambda xs: reduce(lambda a, b: a & b, xs)
    some = lambda xs: reduce(lambda a, b: a | b, xs)
    text, binary = has("txt"), has("bin")
    return (
        F.when(every(text), "text").when(every(binary), "binary").when(some(text), "partial_text")
        .when(some(binary), "partial_binary").otherwise("missing")
    )


def is_partial(missing: Column, needs_converter: Column, *core: Column) -> Column:
    """Whether a report lacks an input, needs a converter, or has an unknown core metric."""
    return reduce(lambda a, b: a | b, [c.isNull() for c in core], F.coalesce(missing > 0, F.lit(True)) | needs_converter)


def streams_match(width_a, width_b, height_a, height_b, fps_a, fps_b, ms_a, ms_b) -> Column:
    """Issues of two lens streams: equal sizes, rates within 0.01, durations within a second where both are known."""
    return issues(
        ("size", (col(width_a) != col(width_b)) | (col(height_a) != col(height_b))),
        ("frame rate", F.abs(col(fps_a) - col(fps_b)) > 0.01),
        ("duration", F.abs(col(ms_a) - col(ms_b)) > 1000),
    )


def promotes(seed_coverage, seed_components, coverage, components) -> Column:
    """Inferred from documents: whether a candidate model may replace the seed."""
    return (col(coverage) >= col(seed_coverage) - 0.1) & (col(components) <= col(seed_components) + 2)


def boundary_connected(pairs: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Inferred from documents: boundaries with their distinct verified pairs and whether they are enough."""
    out = pairs.groupBy(*by).agg(F.countDistinct("frame_a", "frame_b").alias("verified"))
    return out.withColumn("connected", F.col("verified") >= least)


def choose_seed(components: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Inferred from documents: the component to start from: enough joint frames, then most, then most images."""
    order = Window.partitionBy(*by).orderBy(
        (F.col("joint_frames") >= least).desc(), F.col("joint_frames").desc(), F.col("images").desc(), "component"
    )
    return components.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def continues(components, complete, expected) -> Column:
    """Inferred from documents: whether a fragmented start below 90 percent coverage gets another run."""
    return (col(components) > 1) & (coverage_ratio(complete, expected) < 0.9)


def fixed_rotation_issues(common: dict[str, Column], gravity: Column | None = None, coverage: Column | None = None,
                          manifest: Column | None = None, handshake: Column | None = None) -> Column:
    """What a run with fixed rotations lacks: common needs, then those of the gravity or of the external solver.

    With ``coverage`` the gravity solver is meant, which reads no manifest;
    with ``handshake`` (an issue, null if all is well) the external one.
    """
    pairs = [(~F.coalesce(ok, F.lit(False)), name) for name, ok in common.items()]
    if coverage is not None:
        pairs.append((~F.coalesce(gravity, F.lit(False)), "gravity"))
        pairs.append((~F.coalesce(is_finite(coverage) & coverage.between(MIN_COVERAGE, 1.0), F.lit(False)), "gravity coverage"))
    else:
        pairs.append((~F.coalesce(manifest, F.lit(False)), "manifest"))
        pairs.append((handshake.isNotNull(), handshake))
    return F.array_compact(F.array(*[F.when(when, F.lit(name) if isinstance(name, str) else name) for when, name in pairs]))


MIN_COVERAGE = 0.8
#: What an external solver must say that it supports.
SUPPORTS = ("OrientationPriors", "WxyzHamilton", "RigFrames", "FixedRotation")


def capability_issue(document: Column, protocol: str, manifest_format: str, stock: tuple[str, ...]) -> Column:
    """The first thing wrong with a solver's answer, null if it can be used."""
    read = lambda name: F.get_json_object(document, f"$.{name}")
    checks = [
        (read("protocol").isNull() | (read("protocol") != protocol), "protocol"),
        (read("manifestFormat").isNull() | (read("manifestFormat") != manifest_format), "manifest format"),
        (F.trim(F.coalesce(read("executableVersion"), F.lit(""))) == "", "version"),
        (F.lower(F.coalesce(read("backend"), F.lit(""))).isin(*stock), "backend"),
        *[(~F.coalesce(read(f"supports{n}") == "true", F.lit(False)), n) for n in SUPPORTS],
    ]
    out = F.lit(None).cast("string")
    for when, name in reversed(checks):
        out = F.when(when, F.lit(name)).otherwise(out)
    return out
