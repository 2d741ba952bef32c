"""Relational operators without a direct Spark spelling, as DataFrame rewrites."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomql.session import durable


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key group in ``order`` (which should end in a unique column).

    A window with rank 1: Spark turns the filter into a per-partition group limit, so at most one
    row per key and task is shuffled, whatever the size of a group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, offset: int = 0) -> DataFrame:
    """Correlated LIMIT / OFFSET: rows offset+1 .. offset+k of each key group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rn = F.row_number().over(w)
    return df.withColumn("_rn", rn).where((F.col("_rn") > offset) & (F.col("_rn") <= offset + k)).drop("_rn")


def lockstep(df: DataFrame, arrays: dict[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """Several set-returning expressions advancing together, padded with null.

    A row disappears when all its arrays are empty or null.
    """
    filled = [F.coalesce(a, F.array()).alias(n) for n, a in arrays.items()]
    zipped = F.arrays_zip(*filled)
    return df.select(*keep, F.inline(zipped))


def with_ordinality(df: DataFrame, array: Column, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """Elements with their position from 1."""
    return df.select(*keep, F.posexplode(array).alias("_p", name)).withColumn(
        "ordinality", (F.col("_p") + 1).cast("bigint")
    ).drop("_p")


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggs: Sequence[Column]) -> DataFrame:
    """GROUP BY GROUPING SETS with the rule for empty inputs: each empty set yields one row.

    Non-empty sets run in one Expand; every ``()`` is a global aggregate. ``grouping_id`` has one bit per
    key, the last key lowest.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    full = [s for s in sets if s]
    parts = []
    if full:
        expr = df.groupingSets([[F.col(k) for k in s] for s in full], *[F.col(k) for k in keys])
        parts.append(expr.agg(*aggs, F.grouping_id().cast("bigint").alias("grouping_id")))
    for s in sets:
        if not s:
            total = df.agg(*aggs).withColumn("grouping_id", F.lit(2 ** len(keys) - 1).cast("bigint"))
            types = dict(df.dtypes)
            total = total.withColumns({k: F.lit(None).cast(types[k]) for k in keys})
            parts.append(total)
    return reduce(DataFrame.unionByName, parts)


def fixed_point(seed: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 100) -> DataFrame:
    """WITH RECURSIVE ... UNION: the step runs on rows not seen before until there are none.

    Every round is written to the shared folder, so the plan does not grow with the depth.
    """
    seen = new = durable(seed.distinct(), "recursion")
    for _ in range(max_rounds):
        # EXCEPT compares nulls as equal, as the deduplication of UNION does
        new = durable(step(new).select(*seen.columns).subtract(seen), "recursion")
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
    raise RuntimeError(f"no fixed point within {max_rounds} rounds")


def full_equal_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """USING join that treats nulls as equal, as set operations and grouping do."""
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in on])
    return left.join(right, cond).drop(*[right[c] for c in on])


def hypothetical(df: DataFrame, value: float, column: str, by: Sequence[str] = ()) -> DataFrame:
    """rank, dense_rank, percent_rank and cume_dist that ``value`` would have in each group (nulls sort last)."""
    v = F.lit(value)
    below = F.count_if(F.col(column) < v)
    upto = F.count_if(F.col(column) <= v)
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        (below + 1).alias("rank"),
        (F.count_distinct(F.when(F.col(column) < v, F.col(column))) + 1).alias("dense_rank"),
        (below / n).alias("percent_rank"),
        ((upto + 1) / (n + 1)).alias("cume_dist"),
    )


def groups_frame_sum(df: DataFrame, part: Sequence[str], order: str, value: str, before: int, after: int, out: str) -> DataFrame:
    """sum(value) OVER (... GROUPS BETWEEN before PRECEDING AND after FOLLOWING): frames count peer groups."""
    ranked = df.withColumn("_g", F.dense_rank().over(Window.partitionBy(*part).orderBy(F.asc_nulls_last(order))))
    w = Window.partitionBy(*part).orderBy("_g").rangeBetween(-before, after)
    return ranked.withColumn(out, F.sum(value).over(w)).drop("_g")


def exclude_frame_sum(df: DataFrame, part: Sequence[str], order: str, value: str, exclude: str, out: str) -> DataFrame:
    """sum(value) over the whole partition with EXCLUDE CURRENT ROW, GROUP or TIES; null for an empty frame."""
    whole, peers = Window.partitionBy(*part), Window.partitionBy(*part, order)
    v = F.coalesce(F.col(value), F.lit(0))
    have = F.col(value).isNotNull().cast("int")
    minus = {
        "current row": (v, have),
        "group": (F.sum(v).over(peers), F.sum(have).over(peers)),
        "ties": (F.sum(v).over(peers) - v, F.sum(have).over(peers) - have),
    }[exclude]
    left = F.sum(have).over(whole) - minus[1]
    return df.withColumn(out, F.when(left > 0, F.sum(v).over(whole) - minus[0]))


def numbered(df: DataFrame, part: Sequence[str], order: Sequence[str], out: str, rows: int = 50_000) -> DataFrame:
    """row_number() OVER (PARTITION BY part ORDER BY order), nulls last, without sorting a whole part in one task.

    The first order column, a number, date or timestamp, is cut into ranges of about ``rows`` rows; rows are numbered within
    part and range, and a small table of counts shifts each range by the ranges before it.
    """
    from loomql.operators.special_joins import ranges_of

    lost = F.when(F.col(order[0]).isNull(), 1).otherwise(0)
    cut = df.withColumn("_p", lost * 10_000 + ranges_of(df, order[0], rows))
    by = [F.asc_nulls_last(o) for o in order]
    own = cut.withColumn("_own", F.row_number().over(Window.partitionBy(*part, "_p").orderBy(*by)))
    counts = cut.groupBy(*part, "_p").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*part).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    counts = counts.select(*[F.col(p).alias(f"_b{i}") for i, p in enumerate(part)], F.col("_p").alias("_q"), "_before")
    same = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"_b{i}")) for i, p in enumerate(part)] + [F.col("_p") == F.col("_q")])
    return own.join(counts, same).withColumn(out, F.col("_own") + F.col("_before")).select(*df.columns, out)


def lag_by(df: DataFrame, part: Sequence[str], order: Sequence[str], value: str, offset: str, out: str, default: object = None) -> DataFrame:
    """lag(value, offset, default) where the offset is a column: a self join on the row number.

    ``default`` is taken where the row asked for does not exist; a value that is null stays null, a null offset gives null.
    """
    rows = numbered(df, part, order, "_rn")
    other = rows.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(part)], F.col("_rn").alias("_at"), F.col(value).alias(out))
    cond = reduce(
        lambda a, b: a & b,
        [rows[p].eqNullSafe(other[f"_p{i}"]) for i, p in enumerate(part)] + [rows["_rn"] - rows[offset] == other["_at"]],
    )
    met = rows.join(other, cond, "left")
    if default is not None:
        met = met.withColumn(out, F.when(F.col("_at").isNull() & F.col(offset).isNotNull(), F.lit(default)).otherwise(F.col(out)))
    return met.drop("_rn", "_at", *[f"_p{i}" for i in range(len(part))])


def limit_by_query(df: DataFrame, order: Sequence[Column], limit: DataFrame | int | None, offset: int | None = 0) -> DataFrame:
    """LIMIT (subquery) OFFSET n: the bound is evaluated first; a null limit is no limit, a null offset none."""
    n = limit.first()[0] if isinstance(limit, DataFrame) else limit
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if n is None else out.limit(max(0, int(n)))
