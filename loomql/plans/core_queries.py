"""Registry of the core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from loomql.plans import packed_queries
from loomql.sources.tables import table

MODULES = ("relational", "aggregation", "joins", "scalars", "fuzzy_queries", "sampling_dml", "streams", "extras", "further")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        "o_orderkey", "o_orderpriority", "l_linenumber", "l_returnflag"
    )


def _registries():
    return [import_module(f"loomql.plans.{m}").R for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p5_found": packed_queries.p5_found}
    for r in _registries():
        found |= r.queries
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for r in _registries():
        found |= r.sql
    return found
