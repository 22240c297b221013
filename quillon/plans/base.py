"""What the named queries share: tables, registration, and the stand-in series made of the event table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.shipping import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Which operators of the inventory a query runs.
COVERS: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        ship_package(spark)
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def ev(self) -> DataFrame:
        """event_id, user_id, event_type, value, ms, k."""
        ms = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") / F.lit(1000.0).cast("double")
        k = F.get_json_object("props", "$.k").try_cast("bigint")
        return self.events.select("event_id", "user_id", "event_type", "value", ms.alias("ms"), k.alias("k"))

    def series(self, kind: str) -> DataFrame:
        """source, ts, pos and attitude q of one kind of event."""
        e = self.ev.filter(F.col("event_type") == kind)
        return e.select(F.col("user_id").alias("source"), F.col("ms").alias("ts"), F.col("event_id").alias("pos"), attitude().alias("q"))


#: The same stand-ins in SQL.
EV = """ev as (select event_id, user_id, event_type, value, epoch_us(ts) / 1000.0 as ms,
    cast(json_extract_string(props, '$.k') as bigint) as k from events)"""
HALF = "(value * 0.01)"
Q_SQL = (
    f"cos({HALF}) as qw, case when k % 3 = 0 then sin({HALF}) else 0.0 end as qx,"
    f" case when k % 3 = 1 then sin({HALF}) else 0.0 end as qy, case when k % 3 = 2 then sin({HALF}) else 0.0 end as qz"
)


def attitude() -> Column:
    """A unit quaternion from value (half angle) and k (axis)."""
    half = F.col("value") * 0.01
    part = lambda i: F.when(F.col("k") % 3 == i, F.sin(half)).otherwise(F.lit(0.0))
    return F.array(F.cos(half), part(0), part(1), part(2))


def series_sql(kind: str, name: str) -> str:
    return f"{name} as (select user_id as source, ms as ts, event_id as pos, {Q_SQL} from ev where event_type = '{kind}')"


def query(name: str, covers: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        COVERS[name] = covers
        return f

    return add


def r6(x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x, 6)


# ---- the algebra in SQL text, for the oracles


def sql_mul(a: str, b: str) -> list[str]:
    w, x, y, z = (f"{a}{c}" for c in "wxyz")
    p, q, r, s = (f"{b}{c}" for c in "wxyz")
    return [
        f"({w}*{p} - {x}*{q} - {y}*{r} - {z}*{s})", f"({w}*{q} + {x}*{p} + {y}*{s} - {z}*{r})",
        f"({w}*{r} - {x}*{s} + {y}*{p} + {z}*{q})", f"({w}*{s} + {x}*{r} - {y}*{q} + {z}*{p})",
    ]


def sql_dot(a: str, b: str, parts: str = "wxyz") -> str:
    return "(" + " + ".join(f"{a}{c}*{b}{c}" for c in parts) + ")"


def sql_angle(a: str, b: str) -> str:
    return f"degrees(2 * acos(least(abs({sql_dot(a, b)}), 1.0)))"


def sql_slerp(a: str, b: str, t: str) -> list[str]:
    """Components of the short-path interpolation of unit quaternions, before the last normalisation."""
    d = sql_dot(a, b)
    sign = f"(case when {d} < 0 then -1.0 else 1.0 end)"
    th = f"acos(least(abs({d}), 1.0))"
    ka = f"(case when abs({d}) > 0.9995 then 1 - {t} else sin((1 - {t}) * {th}) / sin({th}) end)"
    kb = f"(case when abs({d}) > 0.9995 then {t} else sin({t} * {th}) / sin({th}) end * {sign})"
    return [f"({ka}*{a}{c} + {kb}*{b}{c})" for c in "wxyz"]
