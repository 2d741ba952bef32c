"""A scrollable cursor over a stored result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomql.operators.rewrites import numbered
from loomql.session import durable


class Cursor:
    """DECLARE ... SCROLL CURSOR: the rows are numbered in ``order`` and stored once; a fetch reads a range of numbers.

    The position is 0 before the first row and rows + 1 after the last; a fetch leaves it on the last row given.
    """

    def __init__(self, df: DataFrame, order: Sequence[str]) -> None:
        self.names = df.columns
        self.rows = durable(numbered(df.withColumn("_one", F.lit(1)), ["_one"], order, "_pos").drop("_one"), "cursor")
        self.size, self.at, self.open = self.rows.count(), 0, True

    def _range(self, low: int, high: int) -> DataFrame:
        if not self.open:
            raise ValueError("the cursor is closed")
        return self.rows.where(F.col("_pos").between(low, high)).select(F.col("_pos").alias("pos"), *self.names)

    def fetch(self, n: int | None = 1) -> DataFrame:
        """The next ``n`` rows (all with None); a negative ``n`` goes backward."""
        n = self.size if n is None else n
        if n >= 0:
            low, high = self.at + 1, min(self.at + n, self.size)
            self.at = self.at if not n else self.size + 1 if self.at + n > self.size else self.at + n
            return self._range(low, high) if n else self._range(self.at, self.at)
        low, high = max(self.at + n, 1), self.at - 1
        self.at = max(self.at + n, 0)
        return self._range(low, high)

    def move(self, n: int) -> int:
        """Moves without rows; gives the number of rows passed over."""
        before = self.at
        self.at = min(max(self.at + n, 0), self.size + 1)
        return min(self.at, self.size) - min(before, self.size) if n >= 0 else before - max(self.at, 1)

    def absolute(self, n: int) -> DataFrame:
        """Row ``n``; counted from the end if negative."""
        self.at = min(max(n if n >= 0 else self.size + 1 + n, 0), self.size + 1)
        return self._range(self.at, self.at)

    def close(self) -> None:
        self.open = False
