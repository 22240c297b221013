"""JSON documents: tolerant reads, recursive flattening, merging, redaction and search."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.numeric import clamp, col


PAIRS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))


def pointer(document, path: str) -> Column:
    """The text at a slash-separated pointer; null if there is none."""
    keys = [p.replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:]]
    steps = "".join(f"[{k}]" if k.isdigit() else f"['{k}']" for k in keys)
    return F.get_json_object(col(document), f"${steps}")


def _load(text):
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


def _scalars(value, key: str = ""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _scalars(v, k)
    elif isinstance(value, list):
        for v in value:
            yield from _scalars(v, key)
    elif isinstance(value, str):
        yield key, value
    elif value is not None and not isinstance(value, bool):
        yield key, json.dumps(value)


@F.pandas_udf(PAIRS)
def flatten(documents: pd.Series) -> pd.Series:
    """(last key, text) of every text and number at any depth; booleans and nulls are dropped."""
    return pd.Series([[{"key": k, "value": v} for k, v in _scalars(_load(d))] for d in documents])


def merge_values(a, b):
    """Objects merge key by key, anything else is replaced."""
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: merge_values(a[k], b[k]) if k in a and k in b else b.get(k, a.get(k)) for k in {**a, **b}}
    return b


@F.pandas_udf(T.StringType())
def deep_merge(base: pd.Series, over: pd.Series) -> pd.Series:
    """The second document laid over the first, keys in order; a document that cannot be read changes nothing."""
    out = []
    for a, b in zip(base, over):
        a, b = _load(a), _load(b)
        merged = a if b is None else b if a is None else merge_values(a, b)
        out.append(None if merged is None else json.dumps(merged, sort_keys=True, separators=(",", ":")))
    return pd.Series(out, dtype=object)


def redactor(replacements: list[tuple[str, str]]):
    """A column function that replaces literal texts in every string of a document, keys too deep or not."""
    pairs = sorted(((a, b) for a, b in replacements if a), key=lambda p: -len(p[0]))
    pattern = re.compile("|".join(re.escape(a) for a, _ in pairs)) if pairs else None
    by = dict(pairs)

    def walk(v):
        if isinstance(v, dict):
            return {k: walk(x) for k, x in v.items()}
        if isinstance(v, list):
            return [walk(x) for x in v]
        return pattern.sub(lambda m: by[m[0]], v) if isinstance(v, str) and pattern else v

    @F.pandas_udf(T.StringType())
    def redact(documents: pd.Series) -> pd.Series:
        loaded = [_load(d) for d in documents]
        return pd.Series(
            [None if v is None else json.dumps(walk(v), sort_keys=True, separators=(",", ":")) for v in loaded], dtype=object
        )

    return redact


def finder(names: set[str]):
    """A column function: the first text or number under one of the keys, objects before their children's."""
    wanted = {n.lower() for n in names}

    def search(v):
        if isinstance(v, dict):
            for k, x in v.items():
                if k.lower() in wanted and isinstance(x, (str, int, float)) and not isinstance(x, bool):
                    return x if isinstance(x, str) else json.dumps(x)
            v = list(v.values())
        if isinstance(v, list):
            for x in v:
                found = search(x)
                if found is not None:
                    return found
        return None

    @F.pandas_udf(T.StringType())
    def find(documents: pd.Series) -> pd.Series:
        return pd.Series([search(_load(d)) for d in documents], dtype=object)

    return find


def setting(document, names: list[str], default: float, low: float, high: float) -> Column:
    """A number under any of the names, as number or text, held to its range; else the default."""
    found = F.coalesce(*[F.get_json_object(col(document), f"$.{n}").try_cast("double") for n in names])
    return clamp(F.coalesce(F.when(~F.isnan(found), found), F.lit(float(default))), float(low), float(high))


def flag(document, names: list[str], default: bool) -> Column:
    found = F.coalesce(*[F.get_json_object(col(document), f"$.{n}").try_cast("boolean") for n in names])
    return F.coalesce(found, F.lit(default))


def issue_list(document, known: list[str]) -> Column:
    """Codes in ``issues``, then warnings of the older form that are not among them."""
    read = lambda name, kind: F.coalesce(F.from_json(F.get_json_object(col(document), f"$.{name}"), kind), F.array().cast(kind))
    codes = F.transform(read("issues", "array<struct<code:string>>"), lambda i: i["code"])
    kept = F.filter(codes, lambda c: c.isin(*known))
    return F.concat(kept, F.array_except(read("warnings", "array<string>"), codes))


def merged_maps(first: Column, *more: Column) -> Column:
    """Union of maps; of equal keys the last one's value counts."""

    def merge(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    return reduce(merge, more, first)


def phase_durations(document) -> Column:
    """Milliseconds by phase from four spellings of an object, or an array of phases; later spellings win.

    A value is a number, a text of one, or an object with durationMs.
    """
    out = F.create_map().cast("map<string,double>")
    for name in ("phases", "phaseDurations", "phase_durations", "timings"):
        raw = F.get_json_object(col(document), f"$.{name}")
        rows = F.when(raw.startswith("["), F.from_json(raw, "array<struct<name:string,durationMs:string>>"))
        listed = F.map_from_entries(
            F.transform(
                F.filter(F.coalesce(rows, F.array().cast("array<struct<name:string,durationMs:string>>")), lambda r: r["name"].isNotNull()),
                lambda r: F.struct(r["name"], r["durationMs"].try_cast("double")),
            )
        )
        keyed = F.when(raw.startswith("{"), F.from_json(raw, "map<string,string>"))
        keyed = F.coalesce(keyed, F.create_map().cast("map<string,string>"))
        keyed = F.transform_values(
            keyed, lambda _, v: F.coalesce(v.try_cast("double"), F.get_json_object(v, "$.durationMs").try_cast("double"))
        )
        for found in (listed, keyed):
            out = merged_maps(out, F.map_filter(found, lambda _, v: v.isNotNull()))
    return out
