"""A foreign table: rows of an SQLite file behind Spark's data source API, with filters sent to the other side."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class Span(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class ForeignReader(DataSourceReader):
    """Reads ranges of row numbers in parallel; comparisons of a column with a literal are evaluated by the other side."""

    def __init__(self, options: dict, names: list[str]) -> None:
        self.path, self.query, self.parts, self.names = options["path"], options["query"], int(options.get("parts", 4)), names
        self.sent: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in SIGNS and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)):
                self.sent.append((f.attribute[0], SIGNS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Span]:
        with sqlite3.connect(self.path) as con:
            (rows,) = con.execute(f"SELECT count(*) FROM ({self.query})").fetchone()
        step = max(1, -(-rows // self.parts))
        return [Span(i, i + step) for i in range(0, max(rows, 1), step)]

    def read(self, partition: Span) -> Iterator[tuple]:
        where = " AND ".join(f'"{c}" {sign} ?' for c, sign, _ in self.sent) or "1"
        columns = ", ".join(f'"{n}"' for n in self.names)
        sql = f"SELECT {columns} FROM (SELECT * FROM ({self.query}) LIMIT ? OFFSET ?) WHERE {where}"
        with sqlite3.connect(self.path) as con:
            yield from con.execute(sql, [partition.high - partition.low, partition.low, *[v for _, _, v in self.sent]])


class ForeignTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomql_sqlite"

    def reader(self, schema) -> ForeignReader:
        return ForeignReader(dict(self.options), schema.fieldNames())


def foreign_table(spark: SparkSession, path: str, query: str, schema: str, parts: int = 4) -> DataFrame:
    """The rows of ``query`` in the SQLite file ``path``; the query must return its rows in a fixed order.

    The file must lie where all executors read it. Other servers with a JDBC driver are read with ``jdbc_table``.
    """
    spark.dataSource.register(ForeignTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("loomql_sqlite").schema(schema).option("path", path).option("query", query).option("parts", parts).load()


def jdbc_table(spark: SparkSession, url: str, table_or_query: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table, or a query in brackets with an alias, of a JDBC server; filters, limits and aggregates are pushed down by Spark.

    ``column`` with ``bounds`` reads ranges in parallel; other options go to the driver.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table_or_query).option("pushDownAggregate", "true").option("pushDownLimit", "true").options(**options)
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()
