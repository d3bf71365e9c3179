"""Named queries: a Spark builder each, with the equal SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, places: int = 6, skip=()) -> DataFrame:
    """Round doubles at the output and fold -0.0 into 0.0."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "double" and f.name not in skip:
            c = (F.round(c, places) + F.lit(0.0)).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def r(expr: str, name: str, places: int = 6) -> str:
    """SQL text of a rounded output column."""
    return f'round({expr}, {places}) + 0.0::double as "{name}"'
