"""Colour profile of a source from its metadata markers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.strings import first_containing, marker_key, stem

# Parts of marker keys that name a profile, and values that stand for one.
DLOG_KEYS = ("colorprofile", "pictureprofile", "gamma", "transfer", "logcurve", "colorspace")
LOG_KEYS = ("colorprofile", "pictureprofile", "gammamode", "transfer", "logcurve")
PLAIN_KEYS = ("colorprofile", "pictureprofile", "gammamode", "filter")
REC709_KEYS = ("colorprofile", "pictureprofile", "outputprofile", "transferfunction")
PLAIN_VALUES = ("flat", "stand", "standard", "vivid", "vividbright")
REC709_VALUES = ("bt709", "rec709", "bt709mpeg")
#: Model names by parts of the joined markers, tried in order.
MODELS = [
    ("avata360", "DJI Avata 360"), ("insta360x5", "Insta360 X5"), ("insta360onex2", "Insta360 ONE X2"),
    ("insta360x2", "Insta360 ONE X2"), ("insta360onex", "Insta360 ONE X"), ("insta360x3", "Insta360 X3"),
    ("insta360oners", "Insta360 ONE RS"), ("insta360oner", "Insta360 ONE R"), ("insta360sphere", "Insta360 Sphere"),
    ("osmo360", "DJI Osmo 360"),
]
ILOG_MODELS, LOG_MODELS = ("Insta360 X5",), tuple(m for _, m in MODELS if m.startswith("Insta360") and m != "Insta360 X5")
APPLY_FROM = 0.9


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def marker_classes(key: Column, value: Column) -> dict[str, Column]:
    """Which of the five kinds of marker a (key, value) is; one may be several."""
    k, v = marker_key(key), marker_key(value)
    return {
        "dlog": v.contains("dlogm") | (_any(k, DLOG_KEYS) & v.isin("dlog", "dlogcurve")),
        "ilog": v.contains("ilog") & (_any(k, LOG_KEYS) | (v == "ilog")),
        "log": _any(k, LOG_KEYS) & v.isin("log", "instalog"),
        "plain": _any(k, PLAIN_KEYS) & v.isin(*PLAIN_VALUES),
        "rec709": _any(k, REC709_KEYS) & v.isin(*REC709_VALUES),
        "transfer": (k.contains("colortransfer") | (k == "transfer")) & (v == "bt709"),
        "primaries": k.contains("colorprimaries") & (v == "bt709"),
        "dji": F.lower(F.concat_ws(" ", key, value)).rlike("dji|osmo 360|osmo360"),
    }


def detect(markers: DataFrame, by: str, key: str = "key", value: str = "value", path: str = "path") -> DataFrame:
    """Profile, confidence, model and whether to apply its table, for each source of marker rows.

    Evidence is counted per kind; the first kind in order that has any decides.
    """
    kinds = marker_classes(F.coalesce(F.col(key), F.lit("")), F.coalesce(F.col(value), F.lit("")))
    order = F.array_sort(F.collect_list(F.concat_ws(" ", F.col(key), F.col(value))))
    out = markers.groupBy(by).agg(
        *[F.count_if(c).alias(n) for n, c in kinds.items()], F.max(path).alias("path"), F.array_join(order, " ").alias("text")
    )
    out = out.withColumn("model", first_containing(marker_key("text"), MODELS))
    named = F.coalesce(F.lower(stem("path")).endswith("_d"), F.lit(False))
    osmo = F.coalesce(F.col("model") == "DJI Osmo 360", F.lit(False))
    n = F.col
    own_ilog = F.coalesce(F.col("model").isin(*ILOG_MODELS), F.lit(False))
    own_log = F.coalesce(F.col("model").isin(*LOG_MODELS), F.lit(False))
    dlog, ilog, log, plain, rec = named | (n("dlog") > 0), n("ilog") > 0, n("log") > 0, n("plain") > 0, n("rec709") > 0
    weak = (n("transfer") > 0) & (n("primaries") > 0)
    profile = F.when(dlog, "dlog_m").when(ilog, "ilog").when(log, "insta_log").when(plain, "unknown").when(rec, "rec709").otherwise("unknown")
    confidence = (
        F.when(dlog, F.when((n("dlog") >= 2) | (named & osmo), 0.99).when(n("dlog") > 0, 0.94).otherwise(0.55))
        .when(ilog, F.when(own_ilog, 0.99).otherwise(0.92))
        .when(log, F.when(own_log, 0.99).otherwise(0.90))
        .when(plain, 0.90)
        .when(rec, F.when(n("rec709") >= 2, 0.95).otherwise(0.86))
        .when(weak, 0.45)
        .when(n("dji") > 0, 0.35)
        .otherwise(0.0)
    )
    out = out.withColumns({"profile": profile, "confidence": confidence})
    table = F.when(n("profile") == "dlog_m", osmo).when(n("profile") == "ilog", own_ilog).when(n("profile") == "insta_log", own_log)
    apply = F.coalesce(table, F.lit(False)) & (F.col("confidence") >= APPLY_FROM)
    return out.select(by, "profile", "confidence", "model", apply.alias("should_apply"))


def resolve(mode: Column, profile: Column, should_apply: Column) -> Column:
    """What to do with a source: ``native`` never converts, a forced profile always, ``auto`` where detection says so."""
    return (
        F.when(mode == "native", "none").when(mode == "auto", F.when(should_apply, profile).otherwise("none"))
        .when(mode.isin("dlog_m", "ilog", "insta_log"), mode).otherwise("none")
    )
