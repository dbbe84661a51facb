"""Registry of the training-data queries (one ``opN_<name>`` per operator)."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pagelake.session import configure


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}

MODULES = [
    "packing",
    "bpe",
    "substrings",
    "maxent",
    "naming",
    "hilbert",
    "merkle",
    "ordermin",
    "htmltext",
    "langid",
    "phrases",
    "mixing",
    "whitening",
]


def query(name: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def wrap(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        build.__doc__ = fn.__doc__
        QUERIES[name] = Query(name, build, sql)
        return fn

    return wrap


def load_all() -> dict[str, Query]:
    """Import every operator module so that all registrations run."""
    for m in MODULES:
        importlib.import_module(f"pagelake.llm.{m}")
    return QUERIES
