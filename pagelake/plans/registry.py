"""Registry of named queries: a Spark builder and, where SQL can say it, the
equivalent DuckDB SQL used as the correctness oracle.

Output columns are flat scalars with 64-bit integers so that the Spark and
SQL results compare value by value: list outputs are rendered as sorted,
'|'-joined strings or exploded to rows, and floating results are rounded to
6 dp on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.session import configure


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


QUERIES: dict[str, Query] = {}


def normalise(df: DataFrame) -> DataFrame:
    """Widen small integer types to bigint and floats to double."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def wrap(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return normalise(fn(spark, sf_dir))

        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        if name in QUERIES:
            raise KeyError(f"query {name} registered twice")
        QUERIES[name] = Query(name, build, sql, (fn.__doc__ or "").strip())
        return fn

    return wrap


MODULES = [
    "q_extract",
    "q_store",
    "q_stats",
    "q_quality",
    "q_reliability",
    "q_reports",
    "q_selectors",
    "q_graph",
    "q_streams",
    "q_io",
    "q_sites",
    "q_attempts",
    "q_requests",
    "q_records",
    "q_stored",
    "q_markup",
]


def load_all() -> dict[str, Query]:
    """Import every query module so that all registrations run."""
    import importlib

    for m in MODULES:
        importlib.import_module(f"pagelake.plans.{m}")
    return QUERIES
