"""Several values packed in one field: one row per value, with its position.

Dialects are chosen by minimum description length. A dialect is a set of delimiters with a
quoting style; its parse of a field costs the code lengths of the values it yields plus the bits
that name the dialect. A value's code length is -log2 of its share among all values of the same
column (counted over the whole column in a distributed aggregate, from the parse that splits at every delimiter
outside quotes); a value never seen costs an escape (one in all values) plus its characters, at the entropy of the
column's characters. Each distinct string is parsed once under every dialect that can apply to it, dialects with equal values
count once, and the cheapest parse is taken.

So a delimiter inside a value that is elsewhere known as a whole (because it is quoted there) does not split it:
the choice depends on the column, not on a fixed list of separators.

Scale: the strings are reduced to distinct ones first (map-side combined) and parsed in one pass; value
counts and costs move only (string id, value) pairs; the joins cut hot keys, so a
value or string that holds a third of all rows never meets in one task.

Defined cases: null, empty, ``\\N`` and ``N/A`` fields (after trimming) give no row; empty values between
delimiters take no position; a field with one value gives position 1; repeated values stay; repeated
rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomql.operators.skew import hot_cold_join
from loomql.session import durable, stages

# The delimiters, and what is white space beside the separators of Unicode.
DELIMITERS = (",", ";", "|", "/", "\t", "\n", "\u00b7")
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85\ufeff" + "".join(c for c in map(chr, range(sys.maxunicode)) if unicodedata.category(c) in ("Zs", "Zl", "Zp"))
# The same as a class for Java's regular expressions.
SPACE = r"\s\p{Z}\x{1c}-\x{1f}\x{85}\x{feff}"
QUOTES = "\"'\u201c"
MISSING = ("", "\\N", "N/A")
DIALECT_BITS = 3.0


def strip(c: Column) -> Column:
    """Remove surrounding white space of any kind."""
    return F.btrim(c, F.lit(SPACES))


def _class(delimiters: str) -> str:
    return "".join("\\x{%x}" % ord(d) for d in delimiters)


def _unquote(token: Column, quotes: str) -> Column:
    """Value of a token: white space and quotes off, a doubled quote made one."""
    t = strip(token)
    inner = t.substr(F.lit(2), F.length(t) - 2)
    out = t
    for q, closing in (("'", "'"), ("\u201c", "\u201d"), ('"', '"')):
        if q == "'" and q not in quotes:
            continue
        body = inner if q == "\u201c" else F.replace(inner, F.lit(q + q), F.lit(q))
        out = F.when(t.startswith(q) & t.endswith(closing) & (F.length(t) > 1), body).otherwise(out)
    return strip(out)


def parse(raw: Column, delimiters: str, quotes: str) -> Column:
    """Values of ``raw`` under one dialect, in order, without empty ones.

    ``quotes`` is a subset of ``"``, ``'`` and ``\u201c`` (which closes with ``\u201d``). A quote opens only at the start
    of a value and must close before a delimiter or the end; otherwise it is an ordinary character.
    """
    d = _class(delimiters)
    quoted = []
    if '"' in quotes:
        quoted.append(r'"(?:[^"]|"")*+"')
    if "'" in quotes:
        quoted.append(r"'(?:[^']|'(?![%s]*[%s]|[%s]*$))*+'" % (SPACE, d, SPACE))
    if "\u201c" in quotes:
        quoted.append("\u201c[^\u201d]*+\u201d")
    plain = f"[^{d}]+" if d else r"[\s\S]+"
    ends = f"(?=[{d}]|$)" if d else "$"
    pattern = "|".join([rf"[{SPACE}]*+(?:{q})[{SPACE}]*{ends}" for q in quoted] + [plain])
    tokens = F.regexp_extract_all(raw, F.lit(pattern), F.lit(0))
    bare = F.transform(F.regexp_extract_all(raw, F.lit(plain), F.lit(0)), strip)
    with_quotes = F.transform(tokens, lambda t: _unquote(t, quotes))
    # most strings hold no quote at all and need only the plain pattern
    vals = F.when(F.translate(raw, QUOTES, "") == raw, bare).otherwise(with_quotes)
    return F.filter(vals, lambda v: v != "")


def _list_body(raw: Column) -> tuple[Column, Column]:
    t = strip(raw)
    return F.regexp_extract(t, r"(?s)^\[(.*)\]$", 1), t.rlike(r"(?s)^\[.*\]$")


ALL = 2 + 2 * len(DELIMITERS)


def _candidates(raw: Column) -> Column:
    """Array of (dialect number, values) for the dialects that can apply to ``raw``; the finest parse comes first.

    The finest splits at every delimiter outside quotes.
    """
    body, is_list = _list_body(raw)
    has = [F.contains(raw, F.lit(d)) for d in DELIMITERS]
    quoted = raw.rlike('["\u201c]')
    several = reduce(lambda a, b: a + b, [h.cast("int") for h in has]) > 1
    found = []

    def add(k: int, when: Column, vals: Column) -> None:
        found.append(F.when(when, F.struct(F.lit(k).alias("k"), vals.alias("vals"))))

    add(1, is_list, parse(body, ",", "\"'"))
    add(ALL, several, parse(raw, "".join(DELIMITERS), '"\u201c'))
    for n, d in enumerate(DELIMITERS):
        add(2 + 2 * n, has[n], parse(raw, d, '"\u201c'))
        add(3 + 2 * n, has[n] & quoted, parse(raw, d, ""))
    add(ALL + 1, several & quoted, parse(raw, "".join(DELIMITERS), ""))
    add(0, F.lit(True), parse(raw, "", '"\u201c'))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _different(cands: str) -> Column:
    """Candidates of a column without those whose values an earlier one has."""
    return F.filter(cands, lambda x, i: F.array_position(F.transform(cands, lambda y: y["vals"]), x["vals"]) == i + 1)


def choose(strings: DataFrame) -> DataFrame:
    """(sid, tbl, fld, n, cands) -> (sid, k): the cheapest dialect of each string with more than one parse."""
    first = F.get("cands", F.lit(0))["vals"]
    values = durable(
        strings.select("tbl", "fld", "n", F.explode(first).alias("val")).groupBy("tbl", "fld", "val").agg(F.sum("n").alias("seen")), "values"
    )
    letters = values.select("tbl", "fld", F.explode(F.split("val", "")).alias("c")).groupBy("tbl", "fld", "c").agg(F.count(F.lit(1)).alias("n"))
    all_letters = letters.groupBy("tbl", "fld").agg(F.sum("n").alias("of"))
    entropy = letters.join(all_letters, ["tbl", "fld"]).groupBy("tbl", "fld").agg(F.sum(F.col("n") / F.col("of") * F.log2(F.col("of") / F.col("n"))).alias("letter_bits"))
    totals = values.groupBy("tbl", "fld").agg(F.sum("seen").alias("total")).join(entropy, ["tbl", "fld"], "left").select(
        "tbl", "fld", F.log2(F.col("total") + 1).alias("escape"), F.coalesce("letter_bits", F.lit(0.0)).alias("letter_bits"), F.log2("total").alias("all_bits")
    )
    totals = F.broadcast(durable(totals, "totals"))  # one row per column
    unsure = strings.withColumn("cands", _different("cands")).where(F.size("cands") > 1)
    tried = unsure.select("tbl", "fld", "sid", F.explode("cands").alias("c"))
    # a parse without any value (only delimiters) still has to appear, hence the outer explode
    pieces = tried.select("tbl", "fld", "sid", F.col("c.k").alias("k"), F.explode_outer("c.vals").alias("val"))
    priced = hot_cold_join(pieces, values.withColumn("uses", F.col("seen")), ["tbl", "fld", "val"], "uses", "left").join(totals, ["tbl", "fld"])
    bits = F.when(F.col("val").isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.col("all_bits") - F.log2("seen"), F.col("escape") + F.col("letter_bits") * F.length("val"))
    )
    # a list bracket names its dialect by itself; other dialects cost their number
    cost = priced.groupBy("sid", "k").agg(F.sum(bits).alias("bits"))
    cost = cost.withColumn("bits", F.col("bits") + F.when(F.col("k") <= 1, 0.0).otherwise(F.lit(DIALECT_BITS)))
    return cost.groupBy("sid").agg(F.min_by("k", F.struct("bits", "k")).alias("k"))


def unpack(rows: DataFrame) -> DataFrame:
    """(tbl, fld, row_key, raw) -> (tbl, fld, row_key, pos, val); see the module docstring.

    Other columns of ``rows`` are ignored.
    """
    rows = rows.select("tbl", "fld", "row_key", "raw").where(
        F.col("raw").isNotNull() & ~strip(F.col("raw")).isin(*MISSING)
    )
    with stages(rows.sparkSession) as scope:
        distinct = rows.groupBy("tbl", "fld", "raw").agg(F.count(F.lit(1)).alias("n"))
        strings = durable(distinct.withColumn("sid", F.monotonically_increasing_id()).withColumn("cands", _candidates(F.col("raw"))), "packed")
        picked = F.filter("cands", lambda x: F.col("k").isNull() | (x["k"] == F.col("k")))
        chosen = strings.join(choose(strings), "sid", "left").select("tbl", "fld", "raw", "n", F.get(picked, F.lit(0))["vals"].alias("vals"))
        chosen = durable(chosen, "chosen")
        scope.keep(chosen)
    return (
        hot_cold_join(rows, chosen, ["tbl", "fld", "raw"], "n", "inner")
        .select("tbl", "fld", "row_key", F.posexplode("vals").alias("pos", "val"))
        .withColumn("pos", F.col("pos") + 1)
    )
