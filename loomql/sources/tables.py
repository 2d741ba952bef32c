"""Readers for the table layouts the engine is run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet`` (one file or a directory of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temp views over the named tables, for the SQL entry point."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    *,
    delimiter: str = "\t",
    null: str = "\\N",
    quote: str | None = None,
    escape: str | None = None,
    header: bool = False,
    encoding: str = "UTF-8",
    force_null: tuple[str, ...] = (),
    force_not_null: tuple[str, ...] = (),
) -> DataFrame:
    """Bulk text load with an explicit schema (no inference pass over the data).

    ``force_null``: quoted null markers in these columns become null too;
    ``force_not_null``: nulls in these columns become empty strings.
    """
    from pyspark.sql import functions as F

    reader = (
        spark.read.schema(schema)
        .option("sep", delimiter)
        .option("nullValue", null)
        .option("header", str(header).lower())
        .option("encoding", encoding)
        .option("quote", quote if quote is not None else "")
        .option("escape", escape if escape is not None else (quote or "\\"))
        .option("mode", "FAILFAST")
    )
    df = reader.csv(path)
    for c in force_null:
        df = df.withColumn(c, F.when(F.col(c) != null, F.col(c)))
    for c in force_not_null:
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    return df


def tbl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Pipe-separated benchmark files with a trailing separator on each line."""
    return spark.read.schema(schema).option("sep", "|").csv(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per line, explicit schema."""
    return spark.read.schema(schema).json(path)
