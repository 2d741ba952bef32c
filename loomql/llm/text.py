"""Text helpers shared by the operators of this subpackage."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose to one base letter, and those letters."""
    marked, base = [], []
    for code in range(0xC0, 0x250):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            marked.append(chr(code))
            base.append(plain)
    return "".join(marked), "".join(base)


MARKED, BASE = _accents()


def fold(c: Column) -> Column:
    """Lower case without accents (composed or combining)."""
    return F.lower(F.regexp_replace(F.translate(c, MARKED, BASE), r"\p{M}", ""))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def lcs_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * LCS / (|a| + |b|); 1 for equal strings, null where one is null. Arrow batches."""
    return pd.Series(
        [
            None
            if x is None or y is None
            else 1.0
            if x == y
            else 2.0 * common_subsequence(x, y) / (len(x) + len(y))
            for x, y in zip(a, b, strict=True)
        ],
        dtype="float64",
    )
