"""Records that are equal but for formatting, collapsed by dictionary encoding.

Every column, and every named field of a text line, is encoded through one dictionary: each distinct value is canonicalised
once, and each distinct canonical value of a field gets an integer of its own, assigned and written once. A record becomes
the sorted tuple of its integers; absent and null fields take no place in it, so null equals only
null. Columns of integers and dates are integers already and enter with their field's number beside them. Records are grouped by a
64-bit digest of the compact tuple; where a digest repeats, the tuples themselves are grouped.

Canonical form: letters and digits only, in order, case disregarded; a point directly between two
digits stays. Values that are no strings count as written.

Scale. The dictionary is built by one aggregate over all fields (map-side combined). It returns to the rows field by
field: a field's part is broadcast while it holds at most ``BROADCAST_ROWS`` short values, and joined by a shuffle that cuts
hot values and spreads nulls beyond that; the identifiers are the same either way. Groups are pre-aggregated before the shuffle
to (digest, smallest key, copies); only rows of digests with copies are grouped by their tuples, and no set of copies is gathered:
the smallest key returns to its rows by the skew join.
Each table is written as tuples before the next one begins, and then its dictionary and the shuffle files go: the disk holds
the shuffles of one query at a time.

Defined cases: rows with a null key are left out of the result (they cannot be named); a repeated key
counts as a further copy; a record whose fields are all null equals any other such record;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomql.operators.skew import hot_cold_join, hot_of
from loomql.session import durable, durable_by, shuffles_removed, stages

BROADCAST_ROWS = 50_000
BROADCAST_CHARACTERS = 4_000_000


def canonical(c: Column) -> Column:
    """Letters, digits and points between digits, case folded."""
    folded = F.lower(F.upper(c))
    return F.regexp_replace(folded, r"[^\p{L}\p{N}.]++|(?<!\p{N})\.|\.(?!\p{N})", "")


def dictionary(values: DataFrame) -> DataFrame:
    """(fld, val, canon) of all fields, as often as they occur -> (fld, val, n, vid), one row per distinct (fld, val).

    ``canon`` is a function of ``val`` and the same for all values of a field. ``vid`` is one integer per distinct
    (field, canonical form): a running number, so that two forms never share one.
    """
    found = values.where("val is not null").groupBy("fld", "val").agg(F.count(F.lit(1)).alias("n"), F.max("as_is").alias("as_is"))
    found = durable(found.select("fld", "val", "n", F.when(F.col("as_is"), F.col("val")).otherwise(canonical(F.col("val"))).alias("canon")), "canonical")
    forms = found.groupBy("fld", "canon").agg(F.count(F.lit(1)).alias("spellings")).withColumn("vid", F.monotonically_increasing_id())
    return hot_cold_join(found, durable(forms, "forms"), ["fld", "canon"], "spellings", "inner").select("fld", "val", "n", "vid")


def _digest(ids: Column) -> Column:
    """64-bit digest of a sorted tuple."""
    return F.xxhash64(ids)


def _integer(field: int, kind: str, c: Column) -> Column | None:
    """Identifier of a value that is an integer of up to 32 bits or a date: below 0, unique over fields; else None."""
    if kind not in ("tinyint", "smallint", "int", "date"):
        return None
    number = F.unix_date(c) if kind == "date" else c
    return -1 - (F.lit(field * 2**33).cast("long") + number.cast("long") + F.lit(2**31))


def encode_columns(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, ids): the sorted (field, value) integers of each record."""
    kinds = dict(df.dtypes)
    own = {i: n.alias(f"_i{i}") for i, f in enumerate(fields) if (n := _integer(i, kinds[f], F.col(f))) is not None}
    worded = [i for i in range(len(fields)) if i not in own]
    out = df.select(F.col(key).cast("string").alias("_key"), *own.values(), *[F.col(fields[i]).cast("string").alias(f"_v{i}") for i in worded])
    with stages(df.sparkSession) as scope, shuffles_removed(df.sparkSession):
        cells = F.array(*[F.struct(F.lit(i).alias("fld"), F.col(f"_v{i}").alias("val"), F.lit(kinds[fields[i]] != "string").alias("as_is")) for i in worded])
        if not worded:
            cells = F.array().cast("array<struct<fld:int,val:string,as_is:boolean>>")
        # one folder for each field, so that a field reads only its own part
        with stages(df.sparkSession) as building:
            words = dictionary(out.select(F.explode(cells).alias("c")).select("c.*"))
            words = df.sparkSession.read.schema(words.schema).parquet(durable_by(words, "fld", "dictionary"))
            building.keep(words)
        sizes = {r[0]: r[1:] for r in words.groupBy("fld").agg(F.count(F.lit(1)), F.sum(F.length("val"))).collect()}  # one row per field
        budget, room = BROADCAST_ROWS, BROADCAST_CHARACTERS
        # small fields first, so that wide rows are shuffled only with integers in place of their values
        for i in sorted(worded, key=lambda i: sizes.get(i, (0, 0))):
            rows, characters = sizes.get(i, (0, 0))
            part = words.where(F.col("fld") == i).select(F.col("val").alias(f"_v{i}"), "n", F.col("vid").alias(f"_i{i}"))
            if rows <= budget and characters <= room:
                budget, room = budget - rows, room - characters
                out = out.join(F.broadcast(part.drop("n")), f"_v{i}", "left").drop(f"_v{i}")
            else:
                out = hot_cold_join(out, part, [f"_v{i}"], "n", "left").drop(f"_v{i}")
        ids = F.array_compact(F.array(*[F.col(f"_i{i}") for i in range(len(fields))]))
        out = durable(out.select(F.col("_key").alias("key"), F.sort_array(ids).alias("ids")), "tuples")
        scope.keep(out)
    return out


# key = value notations of a line: JSON object, tagged, and two separator styles.
_JSON = r'"((?:[^"\\]|\\.)*)"\s*:\s*(?:"((?:[^"\\]|\\.)*)"|([^,}\s]+))'
_TAG = r"(?s)<([A-Za-z_][\w.-]*)>(.*?)</\1\s*>"
_COLON = r"(?s)(?:^|\|)\s*([A-Za-z_][\w ]*?)\s*:(.*?)(?=\|\s*[A-Za-z_][\w ]*?\s*:|$)"
_EQUAL = r"(?s)(?:^|[;\t|])\s*([A-Za-z_][\w ]*?)\s*=(.*?)(?=[;\t|]\s*[A-Za-z_][\w ]*?\s*=|$)"


def _pairs(line: Column, pattern: str) -> Column:
    p = F.lit(pattern)
    return F.arrays_zip(F.regexp_extract_all(line, p, F.lit(1)).alias("k"), F.regexp_extract_all(line, p, F.lit(2)).alias("v"))


def named_fields(line: Column) -> Column:
    """Array of (k, v) of a text line; the notation is told by its first characters.

    A line in no known notation becomes one field without a name that holds the whole line.
    """
    names = "array<struct<k:string,v:string>>"
    start = F.substring(F.ltrim(F.regexp_replace(line, r"^[\s\p{Z}]+", "")), 1, 1)
    # escapes are resolved by the JSON reader; a damaged object falls back to the pattern
    as_map = F.from_json(line, "map<string,string>", {"mode": "PERMISSIVE"})
    from_json = F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    by_json = F.when(F.size(as_map) > 0, from_json).otherwise(_pairs(line, _JSON)).cast(names)
    by_tag = _pairs(line, _TAG).cast(names)
    by_equal, by_colon = _pairs(line, _EQUAL).cast(names), _pairs(line, _COLON).cast(names)
    plain = F.when(line.rlike(r"^\s*[A-Za-z_][\w ]*?\s*="), by_equal).otherwise(by_colon)
    found = F.when(start == "{", by_json).when(start == "<", by_tag).otherwise(plain)
    whole = F.array(F.struct(F.lit("").alias("k"), line.alias("v"))).cast(names)
    return F.when(line.isNull(), F.array().cast(names)).when(F.size(found) > 0, found).otherwise(whole)


def encode_lines(df: DataFrame, key: str, line: str) -> DataFrame:
    """(key, ids) of text lines with named fields in any order and notation."""
    with stages(df.sparkSession) as scope, shuffles_removed(df.sparkSession):
        lines = df.select(F.col(key).cast("string").alias("key"), F.monotonically_increasing_id().alias("row"), named_fields(F.col(line)).alias("pairs"))
        lines = durable(lines, "lines")
        cells = durable(
            lines.select("row", F.explode("pairs").alias("p")).select("row", canonical(F.col("p.k")).alias("fld"), F.col("p.v").alias("val")), "cells"
        )
        words = durable(dictionary(cells.select("fld", "val", F.lit(False).alias("as_is"))), "dictionary")
        met = hot_cold_join(cells, words, ["fld", "val"], "n", "inner").groupBy("row").agg(F.sort_array(F.collect_list("vid")).alias("ids"))
        out = lines.join(met, "row", "left").select("key", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))
        out = durable(out, "tuples")
        scope.keep(out)
    return out


def collapse(encoded: dict[str, DataFrame]) -> DataFrame:
    """(tbl, first_key, copy_key): each record that is a copy, with the smallest key of its set.

    Keys compare as strings. ``encoded``: table name -> durable table (key, ids).
    """
    parts = [df.select(F.lit(t).alias("tbl"), "key", "ids", _digest(F.col("ids")).alias("d")) for t, df in encoded.items()]
    rows = reduce(DataFrame.unionByName, parts).where(F.col("key").isNotNull())
    with stages(rows.sparkSession) as scope, shuffles_removed(rows.sparkSession):
        repeated = rows.groupBy("tbl", "d").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
        # equal digests are not yet equal records: the few rows concerned are grouped by the tuples themselves
        alike = hot_cold_join(rows, durable(repeated, "repeated"), ["tbl", "d"], "copies", "inner").select("tbl", "key", "ids")
        alike = durable(alike, "alike")
        groups = alike.groupBy("tbl", "ids").agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
        groups = durable(groups, "groups")
        hot = hot_of(groups, ["tbl", "ids"], "copies")
        scope.keep(alike, groups)
    copies = hot_cold_join(alike, groups.drop("copies"), ["tbl", "ids"], hot, "inner")
    return copies.where(F.col("key") != F.col("first_key")).select("tbl", "first_key", F.col("key").alias("copy_key"))
