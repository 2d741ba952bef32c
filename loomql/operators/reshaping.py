"""Pivots and hierarchy walks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomql.session import durable


def crosstab(df: DataFrame, row: str, category: str, value: str, categories: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Category-aligned pivot; categories not listed are left out, missing ones are null."""
    out = df.groupBy(F.col(row).alias("row_name")).pivot(category, list(categories)).agg(F.first(value))
    return out.select("row_name", *[F.col(f"`{c}`").alias(n) for c, n in zip(categories, names, strict=True)])


def crosstab_fill(df: DataFrame, row: str, order: str, value: str, n: int) -> DataFrame:
    """Values of a row name filled from left to right in ``order``; the rest is null."""
    w = Window.partitionBy(row).orderBy(F.asc_nulls_last(order))
    ranked = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return ranked.groupBy(F.col(row).alias("row_name")).agg(
        *[F.max(F.when(F.col("_rn") == i, F.col(value))).alias(f"c{i}") for i in range(1, n + 1)]
    )


def connect_by(df: DataFrame, key: str, parent: str, start, delimiter: str, max_depth: int = 0) -> DataFrame:
    """Hierarchy below ``start``: k, p, level and branch. A key on its own branch (a cycle) ends the branch.

    One join for each level, until a level is empty; a ``max_depth`` of 0 is no bound.
    """
    rows = df.select(F.col(key).alias("k"), F.col(parent).alias("p"))
    path = F.array(F.col("k").cast("string"))
    level = durable(rows.where(F.col("k") == start).select("k", "p", F.lit(0).alias("level"), path.alias("path")), "level")
    found, depth = level, 0
    while not level.isEmpty() and (not max_depth or depth < max_depth):
        depth += 1
        above = level.select(F.col("k").alias("_k"), F.col("path").alias("_path"))
        below = rows.join(above, rows.p == above._k)
        below = below.where(~F.array_contains("_path", F.col("k").cast("string")))
        level = durable(below.select("k", "p", F.lit(depth).alias("level"), F.concat("_path", path).alias("path")), "level")
        found = found.unionByName(level)
    return found.select("k", "p", "level", F.array_join("path", delimiter).alias("branch"))
