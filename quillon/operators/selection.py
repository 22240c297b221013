"""Pairing of two streams, the best pair of each interval, and keyframe pruning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.quaternion import EPS_TELEMETRY

#: The defaults of keyframe pruning.
MIN_ROTATION_DEG, MIN_GAP_MS, MAX_GAP_MS, MIN_NOVELTY = 5.0, 200.0, 600.0, 0.08


def pair_lenses(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every left row with every right row of the same keys; the engine chooses the join."""
    a = left.select(*keys, *[F.col(c).alias(f"{c}_0") for c in left.columns if c not in keys])
    b = right.select(*keys, *[F.col(c).alias(f"{c}_1") for c in right.columns if c not in keys])
    return a.join(b, keys)


def rate_interval(sequence, candidate_fps: float, base_fps: float) -> Column:
    """The interval of a 1-based sequence number: floor(((max(seq - 1, 0)) / candidate) * base)."""
    seq = F.col(sequence) if isinstance(sequence, str) else sequence
    return F.floor(F.when(seq > 1, seq - 1).when(seq <= 1, F.lit(0)).cast("double") / candidate_fps * base_fps)


def best_per_interval(pairs: DataFrame, by: list[str], score: str, order: str) -> DataFrame:
    """All rows with ``selected``: true for the highest score, the earliest on ties, of each interval."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), order)
    return pairs.withColumn("_r", F.row_number().over(w)).withColumn("selected", F.col("_r") == 1).drop("_r")


@dataclass(frozen=True)
class Pruning:
    min_rotation_deg: float = MIN_ROTATION_DEG
    min_gap_ms: float = MIN_GAP_MS
    max_gap_ms: float = MAX_GAP_MS
    min_novelty: float = MIN_NOVELTY

    def __post_init__(self) -> None:
        values = (self.min_rotation_deg, self.min_gap_ms, self.max_gap_ms, self.min_novelty)
        if not all(np.isfinite(v) and v >= 0 for v in values):
            raise ValueError("limits must be finite and not negative")
        if self.max_gap_ms < self.min_gap_ms or self.min_novelty > 1:
            raise ValueError("limits are out of order")


class Pruner:
    """Keeps what differs from the last kept frame; its state is that one frame.

    An attitude that is invalid keeps the frame and clears the reference, so
    the next rotation is unknown.  A step back in time keeps the frame, and the
    next one is compared with the new time.
    """

    def __init__(self, config: Pruning, state: tuple | None = None):
        self.config = config
        self.ts, self.q, self.proxy = state or (None, None, None)

    def state(self) -> tuple:
        return self.ts, self.q, self.proxy

    def decide(self, ts: float, q, proxy, is_last: bool) -> dict:
        if not np.isfinite(ts):
            raise ValueError("a frame's time must be finite")
        c, unit = self.config, None
        given = q is not None and len(q) == 4
        if given:
            q = np.asarray(q, float)
            size = np.linalg.norm(q)
            unit = q / size if np.isfinite(q).all() and size > EPS_TELEMETRY else None
        first = self.ts is None
        elapsed = None if first or ts < self.ts else ts - self.ts
        angle = None
        if self.q is not None and unit is not None:
            angle = float(np.degrees(2 * np.arccos(min(abs(float(np.dot(self.q, unit))), 1.0))))
        speed = angle / (elapsed / 1000) if angle is not None and elapsed is not None and elapsed > EPS_TELEMETRY else None
        novelty = None
        if proxy is not None and self.proxy is not None:
            novelty = visual_novelty(np.asarray(proxy), np.asarray(self.proxy))
        open_ = elapsed is not None and elapsed >= c.min_gap_ms
        rules = [
            ("first", first),
            ("last", bool(is_last)),
            ("maxGap", elapsed is not None and elapsed >= c.max_gap_ms),
            ("rotation", open_ and angle is not None and angle >= c.min_rotation_deg),
            ("visualNovelty", open_ and novelty is not None and novelty >= c.min_novelty),
            ("invalidImu", given and unit is None),
            ("timestampDiscontinuity", not first and elapsed is None),
        ]
        held = [name for name, on in rules if on]
        if held:
            self.ts, self.q, self.proxy = float(ts), unit, proxy
        return {
            "kept": bool(held), "reason": "+".join(held) if held else "belowThreshold",
            "rotation_deg": angle, "speed_dps": speed, "novelty": novelty,
        }


def visual_novelty(a: np.ndarray, b: np.ndarray) -> float:
    """The larger of the lenses' mean absolute differences, as a share of the range; a row is a lens."""
    a, b = np.atleast_2d(a).astype(float), np.atleast_2d(b).astype(float)
    return float(np.clip(np.abs(a - b).mean(axis=1).max() / 255.0, 0, 1))


DECISION = "kept boolean, reason string, rotation_deg double, speed_dps double, novelty double"


def prune_keyframes(frames: DataFrame, by: list[str], config: Pruning = Pruning()) -> DataFrame:
    """Decisions for (by, seq, ts, q, proxy), in order of seq; the last frame of a source always stays.

    A source's frames are read in order by one task that holds a frame at a time.
    """
    w = Window.partitionBy(*by)
    rows = frames.withColumn("is_last", F.col("seq") == F.max("seq").over(w)).repartition(*by).sortWithinPartitions(*by, "seq")
    keep = [*by, "seq", "ts"]
    schema = ", ".join(f"{c} {dict(frames.dtypes)[c]}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, pruner = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                own = tuple(getattr(row, c) for c in by)
                if own != key:
                    key, pruner = own, Pruner(config)
                out.append({**{c: getattr(row, c) for c in keep}, **pruner.decide(row.ts, row.q, row.proxy, row.is_last)})
            yield pd.DataFrame(out, columns=[*keep, "kept", "reason", "rotation_deg", "speed_dps", "novelty"])

    return rows.select(*by, "seq", "ts", "q", "proxy", "is_last").mapInPandas(run, f"{schema}, {DECISION}")
