"""p5: the packed lists of the film tables, one row per value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomql.operators.packed_values import unpack
from loomql.sources.tables import table

FIELDS = (
    ("imdb", "genres", "imdbid"),
    ("imdb", "cast_names", "imdbid"),
    ("omdbmovies", "genre", "id"),
    ("actors", "knownfortitles", "nconst"),
)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        table(spark, sf_dir, t).select(
            F.lit(t).alias("tbl"), F.lit(f).alias("fld"), F.col(k).cast("string").alias("row_key"), F.col(f).alias("raw")
        )
        for t, f, k in FIELDS
    ]
    return unpack(reduce(DataFrame.unionByName, rows))
