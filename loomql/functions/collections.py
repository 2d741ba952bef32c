"""Arrays, integer sets, enums, maps, ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_contains_all(a: Column, b: Column) -> Column:
    """a @> b."""
    return F.size(F.array_except(b, a)) == 0


def idx(a: Column, x) -> Column:
    """Position of x from 1, 0 if absent."""
    return F.array_position(a, x).cast("int")


def uniq(a: Column) -> Column:
    """Adjacent duplicates removed (as on a sorted array)."""
    return F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))


def subarray(a: Column, start: int, n: int) -> Column:
    return F.slice(a, start, n)


def push(a: Column, x) -> Column:
    return F.concat(a, F.array(F.lit(x)))


def int_query(a: Column, query: str) -> Column:
    """Boolean query over an integer array: numbers with & | ! and parentheses."""
    import re

    tokens = re.findall(r"\d+|[&|!()]", query)
    at = 0

    def atom() -> Column:
        nonlocal at
        tok = tokens[at]
        at += 1
        if tok == "!":
            return ~atom()
        if tok == "(":
            out = either()
            at += 1
            return out
        return F.array_contains(a, int(tok))

    def both() -> Column:
        nonlocal at
        out = atom()
        while at < len(tokens) and tokens[at] == "&":
            at += 1
            out = out & atom()
        return out

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at] == "|":
            at += 1
            out = out | both()
        return out

    return either()


class Enum:
    """Labels ordered by position."""

    def __init__(self, *labels: str) -> None:
        self.labels = labels

    def ordinal(self, c: Column) -> Column:
        """Position of a label from 1; null for an unknown one."""
        return F.nullif(F.array_position(F.array(*map(F.lit, self.labels)), c), F.lit(0)).cast("int")

    def first(self) -> Column:
        return F.lit(self.labels[0])

    def last(self) -> Column:
        return F.lit(self.labels[-1])

    def range(self, lo: str | None = None, hi: str | None = None) -> Column:
        a = 0 if lo is None else self.labels.index(lo)
        b = len(self.labels) if hi is None else self.labels.index(hi) + 1
        return F.array(*map(F.lit, self.labels[a:b]))


# ranges: struct<lo, hi, lo_inc, hi_inc>; a null bound is infinite; a null-free struct with lo > hi is not built: see empty


def make_range(lo: Column, hi: Column, bounds: str = "[)") -> Column:
    """Range with the given bounds; ``empty`` where it holds nothing."""
    lo_inc, hi_inc = bounds[0] == "[", bounds[1] == "]"
    empty = F.coalesce((lo > hi) | ((lo == hi) & F.lit(not (lo_inc and hi_inc))), F.lit(False))
    return F.struct(
        F.when(~empty, lo).alias("lo"), F.when(~empty, hi).alias("hi"), (F.lit(lo_inc) & ~empty & lo.isNotNull()).alias("lo_inc"),
        (F.lit(hi_inc) & ~empty & hi.isNotNull()).alias("hi_inc"), empty.alias("empty"),
    )


def is_empty(r: Column) -> Column:
    return r["empty"]


def _starts_before_end(a: Column, b: Column) -> Column:
    """The lower bound of a lies within or before the upper bound of b."""
    touch = (a["lo"] == b["hi"]) & a["lo_inc"] & b["hi_inc"]
    return a["lo"].isNull() | b["hi"].isNull() | F.coalesce(a["lo"] < b["hi"], F.lit(False)) | F.coalesce(touch, F.lit(False))


def overlaps(a: Column, b: Column) -> Column:
    """a && b."""
    return ~a["empty"] & ~b["empty"] & _starts_before_end(a, b) & _starts_before_end(b, a)


def _lo_le(a: Column, b: Column) -> Column:
    return a["lo"].isNull() | F.coalesce((a["lo"] < b["lo"]) | ((a["lo"] == b["lo"]) & (a["lo_inc"] | ~b["lo_inc"])), F.lit(False))


def _hi_ge(a: Column, b: Column) -> Column:
    return a["hi"].isNull() | F.coalesce((a["hi"] > b["hi"]) | ((a["hi"] == b["hi"]) & (a["hi_inc"] | ~b["hi_inc"])), F.lit(False))


def contains(a: Column, b: Column) -> Column:
    """a @> b for ranges."""
    return b["empty"] | (~a["empty"] & _lo_le(a, b) & _hi_ge(a, b))


def contains_value(a: Column, v: Column) -> Column:
    lo = a["lo"].isNull() | (a["lo"] < v) | ((a["lo"] == v) & a["lo_inc"])
    hi = a["hi"].isNull() | (a["hi"] > v) | ((a["hi"] == v) & a["hi_inc"])
    return ~a["empty"] & lo & hi


def left_of(a: Column, b: Column) -> Column:
    """a << b."""
    return ~a["empty"] & ~b["empty"] & ~_starts_before_end(b, a)


def adjacent(a: Column, b: Column) -> Column:
    """a -|- b: they meet in one point that exactly one of them holds."""
    one = lambda x, y: F.coalesce((x["hi"] == y["lo"]) & (x["hi_inc"] != y["lo_inc"]), F.lit(False))
    return ~a["empty"] & ~b["empty"] & (one(a, b) | one(b, a))


def _empty_like(a: Column) -> Column:
    n = F.when(F.lit(False), a["lo"])
    return F.struct(n.alias("lo"), n.alias("hi"), F.lit(False).alias("lo_inc"), F.lit(False).alias("hi_inc"), F.lit(True).alias("empty"))


def intersection(a: Column, b: Column) -> Column:
    """a * b."""
    lo, hi = F.when(_lo_le(a, b), F.lit(True)).otherwise(False), F.when(_hi_ge(a, b), F.lit(True)).otherwise(False)
    met = F.struct(
        F.when(lo, b["lo"]).otherwise(a["lo"]).alias("lo"), F.when(hi, b["hi"]).otherwise(a["hi"]).alias("hi"),
        F.when(lo, b["lo_inc"]).otherwise(a["lo_inc"]).alias("lo_inc"), F.when(hi, b["hi_inc"]).otherwise(a["hi_inc"]).alias("hi_inc"), F.lit(False).alias("empty"),
    )
    return F.when(overlaps(a, b), met).otherwise(_empty_like(a))


def merge(a: Column, b: Column) -> Column:
    """Smallest range that holds both."""
    lo, hi = _lo_le(a, b), _hi_ge(a, b)
    both = F.struct(
        F.when(lo, a["lo"]).otherwise(b["lo"]).alias("lo"), F.when(hi, a["hi"]).otherwise(b["hi"]).alias("hi"),
        F.when(lo, a["lo_inc"]).otherwise(b["lo_inc"]).alias("lo_inc"), F.when(hi, a["hi_inc"]).otherwise(b["hi_inc"]).alias("hi_inc"), F.lit(False).alias("empty"),
    )
    return F.when(a["empty"], b).when(b["empty"], a).otherwise(both)


def map_contains(a: Column, b: Column) -> Column:
    """a @> b for string maps: every pair of b is in a."""
    return F.forall(F.map_entries(b), lambda e: F.element_at(a, e["key"]).eqNullSafe(e["value"]) & F.map_contains_key(a, e["key"]))


def map_has_any(a: Column, keys: Column) -> Column:
    return F.arrays_overlap(F.map_keys(a), keys)


def map_has_all(a: Column, keys: Column) -> Column:
    return array_contains_all(F.map_keys(a), keys)


def map_delete(a: Column, key: str) -> Column:
    return F.map_filter(a, lambda k, v: k != key)


def map_merge(a: Column, b: Column) -> Column:
    """a || b: the right side wins."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def map_slice(a: Column, *keys: str) -> Column:
    return F.map_filter(a, lambda k, v: k.isin(*keys))
