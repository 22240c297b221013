"""Cross-source retrieval: close sources, then mutual or distinct neighbours of their anchors.

Both stages are bounded by their caps: anchors per source, pairs of sources,
and candidates per pair, so the anchor comparison never meets whole tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.numeric import clamp, is_finite
from quillon.operators.statistics import centroid, cosine_distance

FLOAT_EPS = 1.1920928955078125e-07


@dataclass(frozen=True)
class Retrieval:
    """Caps beyond the hard limits are held to them; a threshold that is not finite is an error."""

    max_anchors: int = 20
    max_source_pairs: int = 128
    max_matches: int = 4
    top_k: int = 2
    source_distance: float = 0.9
    distance: float = 0.65
    ratio: float = 0.85

    def __post_init__(self) -> None:
        for name, hard in (("max_anchors", 256), ("max_source_pairs", 4096), ("max_matches", 256), ("top_k", 16)):
            value = getattr(self, name)
            if value < 1:
                raise ValueError(f"{name} must be positive")
            object.__setattr__(self, name, min(value, hard))
        for name in ("source_distance", "distance", "ratio"):
            if not abs(getattr(self, name)) < float("inf"):
                raise ValueError(f"{name} must be finite")


def source_pairs(anchors: DataFrame, config: Retrieval) -> DataFrame:
    """The closest pairs of sources by their mean direction.

    Every pair of sources is compared, once: the sources' table has a row per
    source, not per anchor.
    """
    mean = centroid(anchors, ["source"], "descriptor").filter("descriptor is not null")
    a = mean.select(F.col("source").alias("source_a"), F.col("descriptor").alias("da"))
    b = mean.select(F.col("source").alias("source_b"), F.col("descriptor").alias("db"))
    out = a.join(b, F.col("source_a") < F.col("source_b")).withColumn("source_distance", cosine_distance("da", "db"))
    out = out.filter(is_finite("source_distance") & (F.col("source_distance") <= config.source_distance))
    return out.select("source_a", "source_b", "source_distance").orderBy("source_distance", "source_a", "source_b").limit(
        config.max_source_pairs
    )


def match_anchors(anchors: DataFrame, pairs: DataFrame, config: Retrieval) -> DataFrame:
    """Matches between the anchors of each pair of sources.

    A left anchor's ``top_k`` nearest stand for election.  One is taken if the
    left anchor is also the nearest of the right one, or if both anchors' best
    distance is clearly below their second best.
    """
    a = anchors.select(F.col("source").alias("source_a"), F.col("frame").alias("frame_a"), F.col("pos").alias("pa"), F.col("descriptor").alias("da"))
    b = anchors.select(F.col("source").alias("source_b"), F.col("frame").alias("frame_b"), F.col("pos").alias("pb"), F.col("descriptor").alias("db"))
    both = pairs.join(a, "source_a").join(b, "source_b").withColumn("distance", cosine_distance("da", "db")).drop("da", "db")
    pair = ["source_a", "source_b"]
    left = Window.partitionBy(*pair, "pa").orderBy("distance", "pb")
    right = Window.partitionBy(*pair, "pb").orderBy("distance", "pa")
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)

    def ratio(w):
        best, second = (F.nth_value("distance", n).over(w.rowsBetween(*whole)) for n in (1, 2))
        ok = is_finite(best) & is_finite(second) & (second > FLOAT_EPS)
        return F.when(ok, clamp(F.try_divide(best, F.when(ok, second)), 0.0, 1.0))

    both = both.withColumns(
        {
            "rank_a": F.row_number().over(left), "ratio_a": ratio(left), "ratio_b": ratio(right),
            "mutual": F.row_number().over(right) == 1,
        }
    )
    distinct = F.coalesce((F.col("ratio_a") <= config.ratio) & (F.col("ratio_b") <= config.ratio), F.lit(False))
    near = (F.col("rank_a") <= config.top_k) & is_finite("distance") & (F.col("distance") <= config.distance)
    found = both.filter(near & (F.col("mutual") | distinct))
    order = Window.partitionBy(*pair).orderBy("distance", "frame_a", "frame_b", "pa", "pb")
    first = Window.partitionBy(*pair, "frame_a", "frame_b").orderBy("distance", "pa", "pb")
    found = found.withColumn("_d", F.row_number().over(first)).filter("_d = 1")
    found = found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= config.max_matches)
    return found.select(*pair, "source_distance", "frame_a", "frame_b", "distance", "ratio_a", "ratio_b", "mutual")


def first_anchors(vectors: DataFrame, config: Retrieval) -> DataFrame:
    """The first anchors of each source, numbered from 0."""
    w = Window.partitionBy("source").orderBy("frame")
    return vectors.withColumn("pos", F.row_number().over(w) - 1).filter(F.col("pos") < config.max_anchors)


def retrieve(vectors: DataFrame, config: Retrieval = Retrieval()) -> DataFrame:
    """Matches over all sources of (source, frame, descriptor)."""
    anchors = first_anchors(vectors, config)
    return match_anchors(anchors, source_pairs(anchors, config), config)
