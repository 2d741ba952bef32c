"""Sampling methods behind one registry, so that further ones can be plugged in."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 100
METHODS: dict[str, Callable[..., DataFrame]] = {}


def method(name: str) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        METHODS[name] = f
        return f

    return add


def tablesample(df: DataFrame, name: str, *args, **kwargs) -> DataFrame:
    """TABLESAMPLE name(args) [REPEATABLE(seed)]; a null argument or an unknown method raises."""
    if name not in METHODS:
        raise ValueError(f"tablesample method {name} does not exist")
    if any(a is None for a in args):
        raise ValueError("TABLESAMPLE parameter cannot be null")
    return METHODS[name](df, *args, **kwargs)


def _percent(p: float) -> float:
    if not 0 <= p <= 100:
        raise ValueError("sample percentage must be between 0 and 100")
    return p / 100


@method("bernoulli")
def bernoulli(df: DataFrame, percent: float, key: list[str], seed: int = 0) -> DataFrame:
    """Each row by the hash of its key and the seed: the same rows however the table is split."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return df.where(u < _percent(percent) * 2**32)


@method("system")
def system(df: DataFrame, percent: float, seed: int = 0) -> DataFrame:
    """Blocks of ``BLOCK_ROWS`` neighbouring rows of a file: every row of a block is in or out together."""
    block = F.floor(F.col("_metadata.row_index") / BLOCK_ROWS)
    meta = df.withColumn("_f", F.col("_metadata.file_name")).withColumn("_b", block)
    u = F.pmod(F.xxhash64(F.lit(seed), "_f", "_b"), F.lit(1 << 30)) / float(1 << 30)
    return meta.where(u < _percent(percent)).drop("_f", "_b")


@method("system_rows")
def system_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly min(n, rows) rows in random order: a bounded sort, n rows per task."""
    if n < 0:
        raise ValueError("sample size must not be negative")
    return df.withColumn("_r", F.rand(seed)).orderBy("_r").limit(n).drop("_r")


@method("system_time")
def system_time(df: DataFrame, millis: float, seed: int = 0, slices: int = 32) -> DataFrame:
    """As many hash slices as can be counted within the time (not repeatable)."""
    if millis < 0:
        raise ValueError("sample collection time must not be negative")
    until, taken = time.time() + millis / 1000, 0
    part = F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(slices))
    while taken < slices and time.time() < until:
        df.where(part == taken).count()
        taken += 1
    return df.where(part < taken)
