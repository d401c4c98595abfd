"""Named queries over the shared tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bindings import DUCK_VIEWS, Tables, with_clause
from .oracle_views import ORACLE_VIEWS


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query; ``covers`` lists the inventory ids it exercises."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, tuple(covers.split()), fn, sql)
        return fn

    return wrap


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles and floats to a fixed number of places, without negative zero."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), places) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(q.run(Tables(spark, folder)))

    run.__name__ = q.name
    return run


def load() -> dict[str, Query]:
    from . import queries_data, queries_eval, queries_io, queries_select, queries_streams  # noqa: F401

    return QUERIES


def oracle(q: Query) -> str:
    return with_clause(q.sql, {**DUCK_VIEWS, **ORACLE_VIEWS})
