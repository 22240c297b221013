"""Robust statistics and set-level reports as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import quaternion as Q
from quillon.functions.numeric import INF, clamp, col, coverage_ratio, finite
from quillon.storage import materialize


def finite_median(x) -> Column:
    """Median of the finite values, the mean of the middle two; null if there are none."""
    return F.median(finite(x))


def exact_ranks(rows: DataFrame, by: list[str], values: dict[str, Column], upper_least: int = 1) -> DataFrame:
    """``name`` (median) and ``name_upper`` (sorted[n div 2], null below ``upper_least`` values) of each group.

    Nulls are left out; a group has a row if any value has.  No task holds a
    group: equal values are counted first, in buckets of about one percent of a
    value, the buckets' sums tell in which one a rank lies, and only that one
    is put in order.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("n"), c.cast("double").alias("x")) for n, c in values.items()])
    long = rows.select(*by, F.explode(pairs).alias("_p")).select(*by, F.col("_p.n").alias("_name"), F.col("_p.x").alias("_x"))
    size = F.floor(F.log2(F.abs("_x")) * 64) + 200_000
    bucket = F.when(F.col("_x") > 0, size).when(F.col("_x") < 0, -size).when(F.isnan("_x"), F.lit(1 << 40)).otherwise(F.lit(0))
    each = long.filter("_x is not null").withColumn("_b", bucket).groupBy(*by, "_name", "_b", "_x").agg(F.count(F.lit(1)).alias("_n"))
    key = [*by, "_name"]
    sums = each.groupBy(*key, "_b").agg(F.sum("_n").alias("_m"))
    up = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumns({"_to": F.sum("_m").over(up), "_all": F.sum("_m").over(Window.partitionBy(*key))})
    half = lambda n: F.call_function("div", n, F.lit(2).cast("long"))
    low, high = half(F.col("_all") - 1), half(F.col("_all"))
    sums = sums.withColumns({"_low": low, "_high": high, "_before": F.col("_to") - F.col("_m")})
    holds = lambda r: (F.col(r) >= F.col("_before")) & (F.col(r) < F.col("_to"))
    chosen = sums.filter(holds("_low") | holds("_high")).select(*key, "_b", "_before", "_low", "_high", "_all")
    inside = Window.partitionBy(*key, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = each.join(chosen, [*key, "_b"]).withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
    start = F.col("_end") - F.col("_n")
    pick = lambda r: F.max(F.when((F.col(r) >= start) & (F.col(r) < F.col("_end")), F.col("_x")))
    out = at.groupBy(*key).agg(pick("_low").alias("_l"), pick("_high").alias("_h"), F.max("_all").alias("_all"))
    cols = []
    for n in values:
        own = F.col("_name") == n
        cols.append(F.max(F.when(own, (F.col("_l") + F.col("_h")) / 2)).alias(n))
        cols.append(F.max(F.when(own & (F.col("_all") >= upper_least), F.col("_h"))).alias(f"{n}_upper"))
    return out.groupBy(*by).agg(*cols)


def pearson(x, y) -> Column:
    """Correlation of pairs in which both are known; null below two pairs or without variance; held to -1 .. 1."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    # central moments as the engine keeps them, so large means do not cancel
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y)) * F.count(x)
    ok = (F.count(x) >= 2) & (spread > Q.EPS_TELEMETRY)
    return F.when(ok, clamp(F.try_divide(F.covar_pop(x, y) * F.count(x), F.when(ok, spread)), -1.0, 1.0))


def rms(x) -> Column:
    x = col(x)
    return F.sqrt(F.avg(x * x))


def weighted_progress(progress, status, weight) -> Column:
    """Rounded percent of the weights done; a completed row counts whole."""
    done = F.when(col(status) == "completed", F.lit(1.0)).otherwise(clamp(col(progress).cast("double"), 0.0, 100.0) / 100)
    return F.floor(F.try_divide(F.sum(col(weight) * done), F.sum(col(weight))) * 100 + 0.5).cast("int")


def centroid(vectors: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Unit mean direction of each group; null if lengths differ or nothing is left of it."""
    at = vectors.select(*by, F.size(vector).alias("_n"), F.posexplode(vector).alias("_p", "_x"))
    sums = at.groupBy(*by, "_p").agg(F.sum(F.col("_x").cast("double")).alias("_s"))
    sums = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_p", "_s"))).alias("_v"))
    sizes = at.groupBy(*by).agg((F.min("_n") == F.max("_n")).alias("_same"))
    total = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, e: s + e["_s"] * e["_s"]))
    unit = F.transform("_v", lambda e: e["_s"] / F.col("_norm"))
    out = sums.join(sizes, by).withColumn("_norm", total)
    return out.select(*by, F.when(F.col("_same") & (F.col("_norm") > Q.EPS_RETRIEVAL), unit).alias(vector))


def dot_product(a, b) -> Column:
    """Sum of products in double precision."""
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a, b) -> Column:
    """1 - dot of unit vectors, the dot held to -1 .. 1; infinite if the lengths differ."""
    near = 1 - clamp(dot_product(a, b), -1.0, 1.0)
    return F.when(F.size(col(a)) == F.size(col(b)), near).otherwise(F.lit(INF))


#: Fixed values of the gravity gates.
MIN_MATCHED, MIN_COVERAGE, MIN_INLIERS = 8, 0.8, 0.7
MAX_MEDIAN_DEG, INLIER_RANGE_DEG, ALIGNED_DEG = 10.0, (5.0, 20.0), 0.05
TARGET = (0.0, -1.0, 0.0)


def gravity_alignment(images: DataFrame, priors: DataFrame, by: list[str]) -> DataFrame:
    """The rotation that levels each model, from directions seen in its images.

    ``images`` (by, name, q) and ``priors`` (by, name, gravity) meet by name;
    images without a prior count against the coverage.  A component-wise median
    seeds the direction; what lies within the median residual plus three
    deviations (median absolute, at least half a degree) is summed up.  A group
    that fails a gate has that gate's name in ``problem`` and no rotation.
    """
    seen = images.join(priors, [*by, "name"])
    world = Q.chain(
        (*Q.of("q"), *Q.of("gravity", 3)),
        lambda v: (*Q.normalize(v[:4], Q.EPS_RETRIEVAL), *Q.normalize(v[4:], Q.EPS_RETRIEVAL)),
        lambda u: Q.rotate(Q.conjugate(u[:4]), u[4:]),
        lambda w: Q.normalize(w, Q.EPS_RETRIEVAL),
    )
    obs = seen.select(*by, world.alias("_w"))
    obs = obs.select(*by, *[c.alias(n) for c, n in zip(Q.of("_w", 3), "xyz")]).filter("x is not null")
    obs = materialize(obs, "gravity")  # four aggregates read it
    count = images.groupBy(*by).agg(F.countDistinct("name").alias("images"))
    seed = obs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("matched"), *[F.median(c).alias(f"m{c}") for c in "xyz"]
    )
    seeds = Q.normalize((F.col("mx"), F.col("my"), F.col("mz")), Q.EPS_RETRIEVAL)
    seed = seed.select(*by, "matched", *[c.alias(f"s{n}") for c, n in zip(seeds, "xyz")])
    at = obs.join(seed, by)
    v, s = (F.col("x"), F.col("y"), F.col("z")), (F.col("sx"), F.col("sy"), F.col("sz"))
    at = materialize(at.withColumn("residual", Q.vector_angle(v, s)), "gravity-residuals")
    middle = at.groupBy(*by).agg(F.median("residual").alias("median_residual_deg"))
    at = at.join(middle, by)
    spread = at.groupBy(*by).agg(F.median(F.abs(F.col("residual") - F.col("median_residual_deg"))).alias("mad"))
    limit = clamp(F.col("median_residual_deg") + 3.0 * F.greatest("mad", F.lit(0.5)), *INLIER_RANGE_DEG)
    at = at.join(spread, by).withColumn("inlier_threshold_deg", limit).filter("residual <= inlier_threshold_deg")
    held = at.groupBy(*by).agg(F.count(F.lit(1)).alias("inliers"), *[F.sum(c).alias(f"t{c}") for c in "xyz"])
    out = count.join(seed, by, "left").join(middle, by, "left").join(spread, by, "left").join(held, by, "left")
    out = out.fillna(0, ["matched", "inliers"]).withColumn("inlier_threshold_deg", limit)
    sums = (F.col("tx"), F.col("ty"), F.col("tz"))
    out = out.withColumn("_before", Q.chain(sums, lambda v: Q.normalize(v, 1e-12)))
    before = Q.of("_before", 3)
    out = out.withColumn("_turn", Q.pack(Q.shortest_arc(before, Q.lit(*TARGET))))
    turn = Q.of("_turn")
    coverage, ratio = coverage_ratio("matched", "images"), coverage_ratio("inliers", "matched")
    problem = (
        F.when(F.col("matched") < MIN_MATCHED, "too few observations")
        .when(coverage < MIN_COVERAGE, "coverage")
        .when(F.col("sx").isNull(), "directions cancel")
        .when(~(F.col("median_residual_deg") <= MAX_MEDIAN_DEG), "inconsistent")
        .when((F.col("inliers") < MIN_MATCHED) | (ratio < MIN_INLIERS), "too few inliers")
        .when(before[0].isNull(), "directions cancel")
        .when(turn[0].isNull(), "upside down")
    )
    out = out.withColumn("problem", problem)
    ok = F.col("problem").isNull()
    angle = F.degrees(2 * F.acos(F.least(F.abs(turn[0]), F.lit(1.0))))
    return out.select(
        *by, "images", "matched", "inliers", coverage.alias("coverage"), ratio.alias("inlier_ratio"), "median_residual_deg",
        "inlier_threshold_deg", F.when(ok, Q.pack(before)).alias("gravity_before"), F.when(ok, Q.pack(turn)).alias("rotation"),
        F.when(ok, angle).alias("rotation_deg"), F.when(ok, angle <= ALIGNED_DEG).alias("already_aligned"), "problem",
    )


def model_quality(images: DataFrame, points: DataFrame, components: DataFrame, by: list[str]) -> DataFrame:
    """Counts, medians and coverage of each model.

    ``images`` (by, image_id), ``points`` (by, point_id, err, track_length),
    ``components`` (by, node, component).  Missing inputs leave nulls; coverage
    is 0 without images.
    """
    counts = images.groupBy(*by).agg(F.count(F.lit(1)).alias("image_count"))
    middle = exact_ranks(points, by, {"median_track_length": F.col("track_length"), "median_error": finite("err")})
    at = points.groupBy(*by).agg(F.count(F.lit(1)).alias("point_count"))
    at = at.join(middle.select(*by, "median_track_length", "median_error"), by, "left")
    each = components.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("n"))
    graph = each.groupBy(*by).agg(F.count(F.lit(1)).alias("component_count"), F.max("n").alias("largest_component"))
    out = counts.join(at, by, "left").join(graph, by, "left").fillna(0, ["point_count", "component_count"])
    return out.withColumn("coverage", coverage_ratio(F.coalesce("largest_component", F.lit(0)), "image_count"))
