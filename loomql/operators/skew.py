"""Joining many rows on a key that a few values may dominate."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000


def _spread(rows: DataFrame, chunks: Column) -> Column:
    """A number below ``chunks`` for each row, the same again if a task is repeated."""
    plain = [c for c, kind in rows.dtypes if "map<" not in kind and kind != "variant"]
    return F.pmod(F.xxhash64(F.spark_partition_id(), *plain), chunks)


@dataclass(frozen=True)
class Hot:
    """The hot keys (``on``, ``_parts``) of joins on the same keys, told once for all of them; None: there are none."""

    keys: DataFrame | None
    hot_keys: int


def hot_of(sizes: DataFrame, on: list[str], weight: str, hot_keys: int = HOT_KEYS) -> Hot:
    """At most ``hot_keys`` keys, those that hold a ``1 / hot_keys`` part of ``weight`` or more. ``sizes`` is read twice."""
    total, most = sizes.agg(F.sum(weight), F.max(weight)).first()
    if not total or most * hot_keys < total:
        return Hot(None, hot_keys)
    parts = F.ceil(F.col(weight) * hot_keys / F.lit(float(total))).cast("int").alias("_parts")
    return Hot(sizes.where(F.col(weight) * hot_keys >= F.lit(total)).select(*on, parts), hot_keys)


def hot_cold_join(
    rows: DataFrame,
    dim: DataFrame,
    on: list[str],
    weight: str | DataFrame | Hot | None = None,
    how: str = "left",
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Join ``rows`` to ``dim`` without gathering a hot key in one task; both are read once.

    ``weight`` is a column of ``dim`` proportional to the rows each key has in ``rows`` (then ``dim`` is unique in
    ``on``), or a table (``on``, ``n``) of such numbers; without one the rows are counted first (map-side combined). In
    these two cases, and with the hot keys that ``hot_of`` told before, ``dim`` may repeat its keys. At most
    ``hot_keys`` keys can hold a ``1 / hot_keys`` part of the rows or more. Only these keys and their
    number of parts are broadcast (a proven bound on rows and bytes): the rows of a hot key are cut into that many
    parts, each about ``1 / hot_keys`` of all rows, and the matching rows of ``dim`` are repeated once for each part.

    Keys are compared with ``=`` (a null key matches nothing; with ``how='left'`` its row stays
    with null values, spread over all tasks; with ``how='inner'`` it goes). ``weight`` is not in the result.
    """
    if how not in ("left", "inner"):
        raise ValueError(how)
    if isinstance(weight, Hot):
        hot, hot_keys = weight.keys, weight.hot_keys
    elif weight is None:
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
        hot = hot_of(rows.where(known).groupBy(*on).agg(F.count(F.lit(1)).alias("_w")), on, "_w", hot_keys).keys
    elif isinstance(weight, DataFrame):
        hot = hot_of(weight, on, "n", hot_keys).keys
    else:
        hot = hot_of(dim, on, weight, hot_keys).keys
        dim = dim.drop(weight)
    if hot is None:
        return rows.join(dim, on, how)
    hot = F.broadcast(hot)
    cut = F.when(F.col("_parts").isNotNull(), _spread(rows, F.col("_parts")))
    if how == "left":
        lost = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
        cut = cut.when(lost, _spread(rows, F.lit(hot_keys)))
    left = rows.join(hot, on, "left").withColumn("_part", F.coalesce(cut.cast("int"), F.lit(0))).drop("_parts")
    every = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    right = dim.join(hot, on, "left").withColumn("_part", F.explode(every)).drop("_parts")
    return left.join(right, [*on, "_part"], how).drop("_part")
