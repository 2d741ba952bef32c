"""JSON containment, label trees and text search."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English words without weight in text search.
STOP = "a an and are as at be but by for from has have he her his i in is it its my no not of on or our she so that the their them they this to was we were will with you your".split()


@F.pandas_udf(T.BooleanType())
def json_contains(a: pd.Series, b: pd.Series) -> pd.Series:
    """a @> b of JSON texts: objects by key, arrays by element, scalars by value."""
    import json

    def holds(x, y) -> bool:
        if isinstance(y, dict):
            return isinstance(x, dict) and all(k in x and holds(x[k], v) for k, v in y.items())
        if isinstance(y, list):
            return isinstance(x, list) and all(any(holds(e, v) for e in x) for v in y)
        return type(x) is type(y) and x == y

    def one(x, y):
        if x is None or y is None:
            return None
        return holds(json.loads(x), json.loads(y))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="boolean")


def json_get(c: Column, *path: str | int) -> Column:
    """c -> path ->> last, as text."""
    return F.get_json_object(c, "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path))


def json_has_key(c: Column, key: str) -> Column:
    return F.array_contains(F.json_object_keys(c), key)


def label_level(c: Column) -> Column:
    """Number of labels of a path."""
    return F.when(c == "", 0).otherwise(F.size(F.split(c, r"\.")))


def subpath(c: Column, start: int, n: int) -> Column:
    return F.array_join(F.slice(F.split(c, r"\."), start + 1, n), ".")


def is_ancestor(a: Column, b: Column) -> Column:
    """a @> b: a is b or above it."""
    return (a == b) | F.startswith(b, F.concat(a, F.lit("."))) | (a == "")


def lca(a: Column, b: Column) -> Column:
    """Longest common ancestor of two paths (never the paths themselves)."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    limit = F.least(F.size(x), F.size(y)) - 1
    n = F.aggregate(
        F.sequence(F.lit(0), F.greatest(limit - 1, F.lit(0))), F.lit(0),
        lambda k, i: F.when((k == i) & (i < limit) & (F.get(x, i) == F.get(y, i)), k + 1).otherwise(k),
    )
    return F.array_join(F.slice(x, 1, n), ".")


def lquery(c: Column, query: str) -> Column:
    """Path pattern: ``*`` any labels, ``*{n}`` ``*{n,m}`` counted, ``a|b`` alternatives, ``!a`` not, ``a*`` prefix, ``a@`` any case."""
    out = ""
    for i, part in enumerate(query.split(".")):
        star = re.fullmatch(r"\*(?:\{(\d*)(,?)(\d*)\})?", part)
        if star:
            lo = star[1] or "0"
            hi = star[1] if star[1] is not None and not star[2] else (star[3] or "")
            out += rf"(?:[^.]+\.){{{lo},{hi}}}"
            continue
        negate, body = part.startswith("!"), part.lstrip("!")
        alts = []
        for a in body.split("|"):
            word = re.escape(re.sub(r"[*@%]+$", "", a))
            tail = r"[^.]*" if "*" in a[len(a.rstrip("*@%")) :] else ""
            alts.append(("(?i:" + word + ")" if a.rstrip("*%").endswith("@") else word) + tail)
        alt = "(?:" + "|".join(alts) + ")"
        out += rf"(?!{alt}\.)[^.]+\." if negate else rf"{alt}\."
    return F.concat(c, F.lit(".")).rlike("^" + out + "$")


def stem(w: Column) -> Column:
    """Light English stemming: plural and past endings."""
    w = F.when(w.rlike("sses$"), F.regexp_replace(w, "sses$", "ss")).when(w.rlike("ies$"), F.regexp_replace(w, "ies$", "i")).when(
        w.rlike("(x|z|ch|sh)es$"), F.regexp_replace(w, "es$", "")).when(
        w.rlike("[^s]s$") & (F.length(w) > 3), F.regexp_replace(w, "s$", "")).otherwise(w)
    cut = F.regexp_replace(w, "(ing|ed)$", "")
    w = F.when(w.rlike("(ing|ed)$") & cut.rlike("[aeiou]") & (F.length(cut) > 2), cut).otherwise(w)
    return F.when(w.rlike("[^aeiou]y$"), F.regexp_replace(w, "y$", "i")).otherwise(w)


def to_tsvector(c: Column) -> Column:
    """Map of stems to their word positions; stop words keep their place but are not listed."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    at = F.transform(words, lambda w, i: F.struct(stem(w).alias("lexeme"), (i + 1).alias("at"), w.alias("w")))
    return F.transform(F.filter(at, lambda e: ~e["w"].isin(*STOP)), lambda e: F.struct(e["lexeme"].alias("lexeme"), e["at"].alias("at")))


def ts_match(vector: Column, query: str) -> Column:
    """vector @@ query: words with & | ! ( ) and <-> (directly followed by)."""
    tokens = re.findall(r"<->|[&|!()]|\w+", query)
    at = 0

    def places(word: str) -> Column:
        return F.transform(F.filter(vector, lambda e: e["lexeme"] == stem(F.lit(word.lower()))), lambda e: e["at"])

    def atom() -> tuple[Column, Column]:
        nonlocal at
        tok = tokens[at]
        at += 1
        if tok == "!":
            return ~atom()[0], F.array().cast("array<int>")
        if tok == "(":
            out = either()
            at += 1
            return out, F.array().cast("array<int>")
        found = places(tok)
        while at < len(tokens) and tokens[at] == "<->":
            nxt = places(tokens[at + 1])
            at += 2
            found = F.array_intersect(F.transform(found, lambda p: p + 1), nxt)
        return F.size(found) > 0, found

    def both() -> Column:
        nonlocal at
        out = atom()[0]
        while at < len(tokens) and tokens[at] == "&":
            at += 1
            out = out & atom()[0]
        return out

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at] == "|":
            at += 1
            out = out | both()
        return out

    return either()


def ts_rank(vector: Column, *words: str) -> Column:
    """Sum over the query words of 1 + 1/4 + 1/9 ... over their occurrences, scaled to below 1 per word."""
    def places(word: str) -> Column:
        return F.size(F.filter(vector, lambda e: e["lexeme"] == stem(F.lit(word.lower()))))

    total = F.lit(0.0)
    for w in words:
        n = places(w)
        score = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, i: a + 1.0 / (i * i)) / F.lit(1.64493406685)).otherwise(0.0)
        total = total + score
    return total / len(words)


def ts_headline(c: Column, *words: str) -> Column:
    """The text with the query words marked <b>..</b>."""
    alt = "|".join(re.escape(w) for w in words)
    return F.regexp_replace(c, rf"(?i)\b({alt})\b", "<b>$1</b>")


def xml_table(df, column: str, row: str, fields: dict[str, tuple[str, object]], keep: list[str]):
    """Rows of the ``row`` elements below the root: one column per field with its type and default."""
    schema = f"`{row}` array<struct<{', '.join(f'`{n}`: {t}' for n, (t, _) in fields.items())}>>"
    rows = df.select(*keep, F.explode(F.from_xml(F.col(column), schema)[row]).alias("_row"))
    value = lambda n, d: F.col("_row")[n] if d is None else F.coalesce(F.col("_row")[n], F.lit(d))
    return rows.select(*keep, *[value(n, d).alias(n) for n, (_, d) in fields.items()])
