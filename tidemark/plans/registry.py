"""All registered queries of the catalog operators, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.fixtures import Tables, with_tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODULES = ("texts", "listings", "catalog", "classification", "audits", "streams")


def query(sql: str | None = None, tables: tuple[str, ...] = ()):
    """Register a function of Tables under its name, with its SQL over the derived tables named."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            if tables and sql.lstrip().startswith("with "):
                _SQL[f.__name__] = with_tables(*tables).rstrip() + ", " + sql.lstrip().removeprefix("with ")
            else:
                _SQL[f.__name__] = (with_tables(*tables) if tables else "") + sql
        return f

    return register


def _load() -> None:
    for m in MODULES:
        import_module(f"tidemark.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
