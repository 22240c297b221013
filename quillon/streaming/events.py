"""Progress events and frames as streams: keyed state, watermarks, and the same folds over finished tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.operators.selection import DECISION, Pruner, Pruning

TERMINAL = ("completed", "failed", "cancelled")
#: Rows of log that a task keeps.
MOST_LOGS = 100


def suppress_after_terminal(events: DataFrame, job: str, ts: str, status: str, ignored: DataFrame | None = None) -> DataFrame:
    """A finished table's events up to and with each job's first terminal one; ignored jobs have none."""
    if ignored is not None:
        events = events.join(ignored.select(job), job, "left_anti")
    w = Window.partitionBy(job).orderBy(*([ts] if isinstance(ts, str) else ts)).rowsBetween(Window.unboundedPreceding, -1)
    done = F.max(F.when(F.col(status).isin(*TERMINAL), 1).otherwise(0)).over(w)
    return events.withColumn("_done", F.coalesce(done, F.lit(0))).filter("_done = 0").drop("_done")


def fold_progress(events: DataFrame, by: list[str], ts: str, phase: str, order: str) -> DataFrame:
    """Phases of each key in order: start, end (the next phase's start), events, last message; the newest rows.

    A phase that comes again after another is a new row here; a key keeps its
    last ``MOST_LOGS``.
    """
    w = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.lag(phase).over(w).eqNullSafe(F.col(phase)), 0).otherwise(1)
    rows = events.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    each = rows.groupBy(*by, "_run").agg(
        F.first(phase).alias("phase"), F.min(ts).alias("started"), F.max(ts).alias("latest"), F.count(F.lit(1)).alias("events")
    )
    runs = Window.partitionBy(*by).orderBy("_run")
    back = Window.partitionBy(*by).orderBy(F.col("_run").desc())
    each = each.withColumn("finished", F.lead("started").over(runs))
    took = F.col("finished") - F.col("started")
    each = each.withColumn("duration", F.when(took >= 0, took).when(took < 0, F.lit(0.0)))
    each = each.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= MOST_LOGS)
    return each.drop("_back").withColumnRenamed("_run", "run")


def latest_rows(rows: DataFrame, by: list[str], order: str, most: int = MOST_LOGS) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def sessions(events: DataFrame, by: list[str], ts: str, gap: str, watermark: str) -> DataFrame:
    """Sessions by gap of a stream or a table; ``ts`` is a timestamp, lateness is bounded by the watermark."""
    if events.isStreaming:
        events = events.withWatermark(ts, watermark)
    out = events.groupBy(*by, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(*by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def rate_windows(events: DataFrame, by: list[str], ts: str, size: str, watermark: str) -> DataFrame:
    """Counts in tumbling windows of a stream or a table."""
    if events.isStreaming:
        events = events.withWatermark(ts, watermark)
    out = events.groupBy(*by, F.window(ts, size).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(*by, F.col("w.start").alias("start"), "events")


def bind_logs(logs: DataFrame, starts: DataFrame, job: str, ts: str, within: str, watermark: str) -> DataFrame:
    """Log rows with their job's task, those that came before the job was bound too: a join of two streams in time."""
    a = logs.withWatermark(ts, watermark).alias("a") if logs.isStreaming else logs.alias("a")
    b = starts.withColumnRenamed(ts, "bound_ts")
    b = b.withWatermark("bound_ts", watermark).alias("b") if starts.isStreaming else b.alias("b")
    near = (F.col(f"a.{ts}") >= F.col("b.bound_ts") - F.expr(f"interval {within}")) & (
        F.col(f"a.{ts}") <= F.col("b.bound_ts") + F.expr(f"interval {within}")
    )
    return a.join(b, (F.col(f"a.{job}") == F.col(f"b.{job}")) & near).drop(F.col(f"b.{job}"))


class KeyframeState(StatefulProcessor):
    """Pruning over a stream: each source's state is its last kept frame.

    Rows of a source are taken in the order of their sequence within a batch;
    a stream does not know its last frame, so ``is_last`` comes with the rows.
    """

    def __init__(self, config: Pruning = Pruning()):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "ts double, q array<double>, proxy array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.kept.get() if self.kept.exists() else None
        pruner, out = Pruner(self.config, tuple(state) if state is not None else None), []
        frames = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for row in frames.itertuples(index=False):
            out.append({"source": key[0], "seq": row.seq, "ts": row.ts, **pruner.decide(row.ts, row.q, row.proxy, row.is_last)})
        ts, q, proxy = pruner.state()
        if ts is not None:
            plain = lambda v: None if v is None else [float(x) for x in v]
            self.kept.update((ts, plain(q), plain(proxy)))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def prune_stream(frames: DataFrame, config: Pruning = Pruning()) -> DataFrame:
    """Decisions over a stream of (source, seq, ts, q, proxy, is_last)."""
    source = dict(frames.dtypes)["source"]
    return frames.groupBy("source").transformWithStateInPandas(
        statefulProcessor=KeyframeState(config),
        outputStructType=f"source {source}, seq long, ts double, {DECISION}",
        outputMode="Append",
        timeMode="None",
    )


def pipeline_state(events: DataFrame, job: str, order: str, stage: str, status: str, stages: list[str]) -> DataFrame:
    """Per job: the furthest stage, its state, and what comes next.

    A completed stage starts the next one; a failed or cancelled one stops the
    job; the last stage's completion ends it.
    """
    last = events.groupBy(job).agg(F.max_by(F.struct(stage, status), order).alias("e")).select(job, f"e.{stage}", f"e.{status}")
    at = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col(stage))
    following = F.get(F.array(*[F.lit(s) for s in stages]), at.cast("int"))
    state = F.col(status)
    return last.withColumn(
        "next",
        F.when(state.isin("failed", "cancelled"), "stop").when(state == "completed", F.coalesce(following, F.lit("end"))).otherwise("wait"),
    )


def recover(checkpoints: DataFrame, now_ms: float) -> DataFrame:
    """After a restart: running rows become cancelled, with the time they took so far; others stay."""
    running = F.col("status") == "running"
    took = F.lit(now_ms) - F.col("started_ms")
    took = F.when(took >= 0, took).when(took < 0, F.lit(0.0))
    return checkpoints.withColumns(
        {
            "status": F.when(running, "cancelled").otherwise(F.col("status")),
            "finished_ms": F.when(running, F.lit(now_ms)).otherwise(F.col("finished_ms")),
            "duration_ms": F.when(running, took).otherwise(F.col("duration_ms")),
        }
    )
