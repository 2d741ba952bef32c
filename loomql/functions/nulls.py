"""Null ordering and null counting: nulls sort as the largest value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def asc(c: Column | str) -> Column:
    """Ascending, nulls last."""
    return F.asc_nulls_last(c)


def desc(c: Column | str) -> Column:
    """Descending, nulls first."""
    return F.desc_nulls_first(c)


def num_nulls(*cols: Column | str) -> Column:
    return reduce(lambda a, b: a + b, [(F.col(c) if isinstance(c, str) else c).isNull().cast("int") for c in cols])


def num_nonnulls(*cols: Column | str) -> Column:
    return F.lit(len(cols)) - num_nulls(*cols)
