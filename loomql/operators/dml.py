"""Data modification as copy-on-write: each function gives the new table and the affected rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(target: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new table, inserted rows): columns by name, missing ones null."""
    new = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in target.dtypes])
    return target.unionByName(new), new


def update(target: DataFrame, where: Column, changes: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(new table, changed rows as they are now). A null condition leaves the row."""
    hit = F.coalesce(where, F.lit(False))
    types = dict(target.dtypes)
    marked = target.withColumn("_hit", hit)
    new = marked.withColumns({c: F.when(F.col("_hit"), v.cast(types[c])).otherwise(F.col(c)) for c, v in changes.items()})
    return new.drop("_hit"), new.where("_hit").drop("_hit")


def delete(target: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """(new table, deleted rows)."""
    hit = F.coalesce(where, F.lit(False))
    return target.where(~hit), target.where(hit)


def truncate(target: DataFrame) -> DataFrame:
    return target.limit(0)


def _match(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k] == b[k] for k in keys])


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """ON CONFLICT DO NOTHING: of several new rows with one key the smallest is taken; null keys never conflict."""
    first = rows.where(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(
        F.min(F.struct(*[c for c in rows.columns if c not in keys])).alias("_r")
    ).select(*keys, "_r.*")
    loose = rows.where(reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys]))
    new = first.join(target.select(*keys), keys, "left_anti").unionByName(loose)
    return insert(target, new)


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], changes: list[str]) -> DataFrame:
    """ON CONFLICT DO UPDATE: matching rows take the new values of ``changes``, the rest is inserted.

    Two new rows with one key raise: they would change a row twice. One full outer join.
    """
    if not rows.groupBy(*keys).count().where(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys], F.col("count") > 1)).isEmpty():
        raise ValueError("the new rows hold a key twice")
    old, new = target.alias("o"), rows.alias("n")
    cond = reduce(lambda x, y: x & y, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys])
    has_new, has_old = F.col(f"n.{keys[0]}").isNotNull(), F.col(f"o.{keys[0]}").isNotNull()

    def pick(c: str) -> Column:
        if c in keys:
            return F.coalesce(f"o.{c}", f"n.{c}").alias(c)
        new_value = F.col(f"n.{c}") if c in rows.columns else F.lit(None)
        if c in changes:
            return F.when(has_new, new_value).otherwise(F.col(f"o.{c}")).alias(c)
        return F.when(has_old, F.col(f"o.{c}")).otherwise(new_value).alias(c)

    return old.join(new, cond, "full").select(*[pick(c) for c in target.columns])
