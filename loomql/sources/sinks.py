"""Writers: bulk text export, partitioned tables, materialised views, shuffled copies."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomql.session import durable, shared_dir


def copy_to(
    df: DataFrame, path: str, *, delimiter: str = "\t", null: str = "\\N", header: bool = False, force_quote: bool = False
) -> None:
    """Bulk text export; ``force_quote`` quotes every value that is not null."""
    writer = df.write.mode("overwrite").option("sep", delimiter).option("nullValue", null).option("header", str(header).lower())
    writer.option("quoteAll", str(force_quote).lower()).csv(path)


def range_partitioned(df: DataFrame, key: Column, name: str, table: str) -> DataFrame:
    """A copy of ``df`` partitioned by a derived column, so that filters on it prune directories."""
    path = f"{shared_dir(df.sparkSession)}/loomql-{table}-{uuid.uuid4().hex}"
    df.withColumn(name, key).repartition(name).write.partitionBy(name).parquet(path)
    return df.sparkSession.read.parquet(path)


def hash_partitioned(df: DataFrame, keys: list[str], n: int, table: str) -> DataFrame:
    """A copy in ``n`` folders by the hash of the keys (column ``part``)."""
    return range_partitioned(df, F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"), "part", table)


def list_partitioned(df: DataFrame, column: str, lists: dict[str, list], table: str, default: str | None = None) -> DataFrame:
    """A copy in one folder for each list of values (column ``part``); other values go to ``default``, or raise without one."""
    part = F.lit(default) if default is not None else F.raise_error(F.lit("no partition for a row")).cast("string")
    for name, values in lists.items():
        hit = F.col(column).isin(*[v for v in values if v is not None])
        part = F.when(hit | F.col(column).isNull() if None in values else hit, F.lit(name)).otherwise(part)
    return range_partitioned(df, part, "part", table)


def bucketed(df: DataFrame, keys: list[str], n: int, table: str) -> DataFrame:
    """A copy bucketed and sorted by the keys: equi-joins and aggregates on them need no shuffle."""
    name = f"{table}_{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession)}/loomql-{name}"
    df.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def create_table_as(df: DataFrame, name: str, with_data: bool = True) -> DataFrame:
    """CREATE TABLE name AS query [WITH NO DATA]: stored once, then a view of that name."""
    path = f"{shared_dir(df.sparkSession)}/loomql-{name}-{uuid.uuid4().hex}"
    (df if with_data else df.limit(0)).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.createOrReplaceTempView(name)
    return out


def with_identity(df: DataFrame, column: str, start: int = 1, step: int = 1) -> DataFrame:
    """``df`` with an identity column: numbers from ``start`` without gaps, fixed by being written.

    Rows are numbered within the task that wrote them; the counts of the tasks, one number each, shift them.
    """
    marked = durable(df.withColumn("_id", F.monotonically_increasing_id()), "identity")
    task, own = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = {r[0]: r[1] for r in marked.groupBy(task.alias("t")).agg(F.count(F.lit(1))).collect()}
    before, total = [], 0
    for t in sorted(counts):
        before.append((t, total))
        total += counts[t]
    shift = F.broadcast(df.sparkSession.createDataFrame(before, "_t bigint, _before bigint"))  # one row for each task
    return marked.withColumn("_t", task).join(shift, "_t").withColumn(column, start + step * (F.col("_before") + own)).drop("_id", "_t", "_before")


def rows_to_xml(df: DataFrame, element: str = "row", nulls: bool = False) -> DataFrame:
    """One XML element for each row (column ``xml``), a child for each column; null columns are left out or marked nil."""
    def escaped(c: Column) -> Column:
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(raw), F.lit(safe))
        return c

    parts = []
    for name in df.columns:
        full = F.concat(F.lit(f"<{name}>"), escaped(F.col(name).cast("string")), F.lit(f"</{name}>"))
        parts.append(F.coalesce(full, F.lit(f'<{name} xsi:nil="true"/>' if nulls else "")))
    return df.select(F.concat(F.lit(f"<{element}>"), *parts, F.lit(f"</{element}>")).alias("xml"))


class MaterializedView:
    """A stored result that changes only on refresh; readers see the old files until the new ones are complete."""

    def __init__(self, spark: SparkSession, name: str, query: Callable[[], DataFrame]) -> None:
        self.spark, self.name, self.query, self.path = spark, name, query, None

    def refresh(self) -> MaterializedView:
        path = f"{shared_dir(self.spark)}/loomql-view-{self.name}-{uuid.uuid4().hex}"
        self.query().write.parquet(path)
        self.path = path
        return self

    def read(self) -> DataFrame:
        if self.path is None:
            raise ValueError(f"materialized view {self.name} has not been populated")
        return self.spark.read.parquet(self.path)


def shuffled_copy(df: DataFrame, seed: int) -> DataFrame:
    """The rows in a random order that the seed repeats (range-partitioned sort on a random key)."""
    return df.withColumn("_r", F.rand(seed)).orderBy("_r").drop("_r")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, the most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column))
