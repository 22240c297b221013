"""Registered queries read their whole tables: compared with plain Python over every row."""

import math
import os
from collections import Counter
from statistics import median

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillon.operators import motion
from quillon.plans.base import Tables
from quillon.registry import QUERIES

DIR = os.environ.get("QUILLON_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the synthetic tables are not here")


@pytest.fixture(scope="module")
def events(spark):
    return sorted(Tables(spark, DIR).ev.collect(), key=lambda r: r.event_id)


def test_box_overlap_of_late_events(spark, events, tmp_path):
    """The same events under higher numbers, as larger tables have them."""
    shifted = pq.read_table(f"{DIR}/events.parquet")
    at = shifted.schema.get_field_index("event_id")
    numbers = [x + 2500 for x in shifted["event_id"].to_pylist()]
    pq.write_table(shifted.set_column(at, shifted.schema.field(at), [numbers]), tmp_path / "events.parquet")
    want = {}
    for a, b in zip(events, events[1:]):
        w = max(min(a.value, b.value) + 20 - max(a.value, b.value), 0)
        h = max(min(a.k, b.k) + 30 - max(a.k, b.k), 0)
        want[b.event_id + 2500] = w * h / (1200 - w * h)
    got = {r.event_id: r.iou for r in QUERIES["box_overlap"](spark, str(tmp_path)).collect()}
    assert len(got) == len(events) - 1
    assert got == pytest.approx(want, abs=1e-6)


def test_finite_projection_keeps_every_event(spark, events):
    got = {r.event_id: r.x for r in QUERIES["finite_projection"](spark, DIR).collect()}
    assert got == {r.event_id: None if r.k % 7 == 0 else r.value for r in events}


def test_model_quality_of_every_line(spark):
    lines = pq.read_table(f"{DIR}/lineitem.parquet", columns=["l_orderkey", "l_suppkey"]).to_pylist()
    tracks = {}
    for r in lines:
        tracks.setdefault(r["l_orderkey"], set()).add(r["l_suppkey"])
    root = {i: i for t in tracks.values() for i in t}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for t in tracks.values():
        for i in t:
            root[find(i)] = find(min(t))
    sizes = Counter(find(i) for i in root)
    got = QUERIES["model_quality"](spark, DIR).collect()
    assert [r.asDict() for r in got] == [
        {
            "image_count": len(root), "point_count": len(tracks), "median_track_length": median(len(t) for t in tracks.values()),
            "component_count": len(sizes), "largest_component": max(sizes.values()),
            "coverage": pytest.approx(max(sizes.values()) / len(root), abs=1e-6),
        }
    ]


def test_every_source_is_calibrated(spark, events):
    got = QUERIES["calibration_model"](spark, DIR).collect()
    assert sorted(r.source for r in got) == sorted({r.user_id for r in events})
    assert all(r.valid and r.offset_ms == 80 and r.recovered for r in got)


def test_every_source_is_fused(spark, events):
    got = QUERIES["gravity_fusion"](spark, DIR).collect()
    assert sorted(r.source for r in got) == [r.event_id for r in events]
    assert all(0 < r.samples <= 301 and r.corrections > 0 and r.z < -0.99 for r in got)


def test_sampling_grid_of_whole_ranges(spark, events):
    ranges = {}
    for r in events:
        lo, hi = ranges.get(r.user_id, (r.ms, r.ms))
        ranges[r.user_id] = (min(lo, r.ms), max(hi, r.ms))
    got = {r.user_id: r.points for r in QUERIES["sampling_grid"](spark, DIR).collect()}
    assert got == {u: min(math.ceil((hi - lo) / 1000), 100_000) + 1 for u, (lo, hi) in ranges.items()}


def test_sampling_grid_reaches_the_end(spark):
    """As the reference: the end is a point, and beyond the limit the steps are wider."""
    rows = [("long", 5.0, 1_000_005.0, 1.0), ("short", 0.0, 2500.0, 0.01), ("point", 7.0, 7.0, 1.0)]
    ranges = spark.createDataFrame(rows, "s string, first_ms double, last_ms double, rate_hz double")
    got = {}
    for r in motion.sampling_grid(ranges, ["s"], most=101).orderBy("s", "i").collect():
        got.setdefault(r.s, []).append(r.ts)
    assert got["long"] == [5.0 + i * 10_000 for i in range(101)]
    assert got["short"] == [0.0, 1000.0, 2000.0, 2500.0] and got["point"] == [7.0]
