"""Registry of queries, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


#: Tables whose rows cost much more to work on than to move.
TEXTS = {"documents", "pages"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pick(key: str, values: list[str]) -> Column:
    """The value at key % len(values)."""
    out = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        out = F.when(F.col(key) % len(values) == i, F.lit(v)).otherwise(out)
    return out


def pick_sql(key: str, values: list[str]) -> str:
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then {quote(v)}" for i, v in enumerate(values)) + " end"


def nest(x: str, steps: list[tuple[str, str, str]]) -> str:
    """Nested SQL calls: ("replace" or "re", pattern, to)."""
    for kind, a, b in steps:
        x = f"replace({x}, {quote(a)}, {quote(b)})" if kind == "replace" else f"regexp_replace({x}, {quote(a)}, {quote(b)}, 'g')"
    return x
