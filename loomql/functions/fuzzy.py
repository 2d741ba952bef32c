"""Fuzzy string matching: bounded and weighted edit distance, sound codes, trigrams."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: sound code of each letter A..Z (0: not coded).
SOUND = "01230120022455012623010202"


def levenshtein_less_equal(a: Column, b: Column, limit: int) -> Column:
    """Exact up to ``limit``, ``limit + 1`` beyond it (Spark's own bounded form gives -1 there)."""
    d = F.levenshtein(a, b, limit)
    return F.when(d == -1, F.lit(limit + 1)).otherwise(d)


def levenshtein_weighted(ins: int, delete: int, sub: int, limit: int | None = None):
    """Column function of two strings: edit distance with costs, bounded by ``limit`` (then limit + 1).

    Arrow batches; rows of the table are kept per pair only.
    """

    @F.pandas_udf(T.IntegerType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                out.append(None)
                continue
            row = [j * ins for j in range(len(y) + 1)]
            for i, cx in enumerate(x):
                nxt = [(i + 1) * delete]
                for j, cy in enumerate(y):
                    nxt.append(min(row[j] + (0 if cx == cy else sub), row[j + 1] + delete, nxt[j] + ins))
                row = nxt
                if limit is not None and min(row) > limit:
                    break
            d = min(row) if limit is not None and min(row) > limit else row[-1]
            out.append(d if limit is None or d <= limit else limit + 1)
        return pd.Series(out, dtype="Int32")

    return distance


def soundex(c: Column) -> Column:
    """Four-place sound code: leading non-letters are skipped, no letters give an empty code, and a letter is dropped
    only when the letter directly before it has the same code."""
    s = F.upper(F.regexp_replace(c, "^[^A-Za-z]+", ""))
    letters = F.filter(F.split(s, ""), lambda x: x.rlike("^[A-Z]$"))
    code = lambda x: F.substring(F.lit(SOUND), F.ascii(x) - 64, F.lit(1))
    chars = F.split(s, "")
    kept = F.transform(
        chars,
        lambda x, i: F.when(i == 0, x)
        .when(~x.rlike("^[A-Z]$"), "")
        .when(code(x) == "0", "")
        .when(F.get(chars, i - 1).rlike("^[A-Z]$") & (code(x) == code(F.get(chars, i - 1))), "")
        .otherwise(code(x)),
    )
    return F.when(F.size(letters) == 0, F.lit("")).otherwise(F.rpad(F.substring(F.array_join(kept, ""), 1, 4), 4, "0"))


def difference(a: Column, b: Column) -> Column:
    """Places in which two sound codes agree, 0 to 4."""
    x, y = soundex(a), soundex(b)
    return sum(((F.substring(x, i, 1) == F.substring(y, i, 1)).cast("int") for i in range(2, 5)), (F.substring(x, 1, 1) == F.substring(y, 1, 1)).cast("int"))


def trigrams(c: Column) -> Column:
    """Sorted distinct trigrams of the lower-cased words, each padded with two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))))
    return F.array_sort(F.array_distinct(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both; 0 when there are none."""
    return set_similarity(trigrams(a), trigrams(b))


def set_similarity(x: Column, y: Column) -> Column:
    """The same from trigram arrays already made (compute each side once before a join)."""
    shared, all_ = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(all_ > 0, shared / all_).otherwise(0.0)


def _extent_similarity(grams: set[str], ordered: list[str], starts: list[int], ends: list[int]) -> float:
    """Greatest similarity of ``grams`` to any run of ``ordered`` that begins at one of ``starts`` and ends at one of ``ends``."""
    best = 0.0
    for lo in starts:
        inside: set[str] = set()
        at = lo
        for hi in ends:
            if hi < lo:
                continue
            inside.update(ordered[at : hi + 1])
            at = hi + 1
            shared = len(inside & grams)
            best = max(best, shared / (len(grams) + len(inside) - shared))
    return best


def _word_similarity(strict: bool):
    import re

    def padded(text: str) -> list[list[str]]:
        words = (f"  {w} " for w in re.findall(r"[^\W_]+", text.lower()))
        return [[w[i : i + 3] for i in range(len(w) - 2)] for w in words]

    def one(a: str, b: str) -> float:
        grams = {g for w in padded(a) for g in w}
        words = padded(b)
        ordered = [g for w in words for g in w]
        if not grams or not ordered:
            return 0.0
        if strict:
            ends, n = [], -1
            for w in words:
                n += len(w)
                ends.append(n)
            return _extent_similarity(grams, ordered, [0, *[e + 1 for e in ends[:-1]]], ends)
        # the best run begins and ends with a shared trigram
        hits = [i for i, g in enumerate(ordered) if g in grams]
        return _extent_similarity(grams, ordered, hits, hits)

    @F.pandas_udf(T.DoubleType())
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return similar


def word_similarity(a: Column, b: Column) -> Column:
    """Greatest trigram similarity of ``a`` to any run of the ordered trigrams of ``b``; null for a null. Arrow batches."""
    return _word_similarity(False)(a, b)


def strict_word_similarity(a: Column, b: Column) -> Column:
    """The same over runs of whole words of ``b``."""
    return _word_similarity(True)(a, b)


# The bounds of the similarity operators.
SIMILAR, WORD_SIMILAR, STRICT_WORD_SIMILAR = 0.3, 0.6, 0.5


def is_similar(a: Column, b: Column, limit: float = SIMILAR) -> Column:
    """``a % b``."""
    return similarity(a, b) >= limit


def is_word_similar(a: Column, b: Column, limit: float = WORD_SIMILAR) -> Column:
    """``a <% b``."""
    return word_similarity(a, b) >= limit


def distance(a: Column, b: Column) -> Column:
    """``a <-> b``."""
    return 1 - similarity(a, b)


def unaccent(c: Column) -> Column:
    """Accents removed (composed Latin letters and combining marks)."""
    marked, base = [], []
    for code in range(0xC0, 0x250):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != chr(code):
            marked.append(chr(code))
            base.append(plain)
    return F.regexp_replace(F.translate(c, "".join(marked), "".join(base)), r"\p{M}", "")


# How English letters sound, by what stands around them. The first rule that fits at a letter gives its code and
# consumes what it matched; a letter without a rule is silent.
SOUND_RULES = (
    ("(?<!M)B", "B"),
    ("C(?=IA)", "X"), ("(?<=S)C(?=[EIY])", ""), ("C(?=[EIY])", "S"), ("CH(?=R)", "K"), ("(?<=S)CH", "K"), ("CH", "X"), ("C", "K"),
    ("DG(?=[EIY])", "J"), ("D", "T"),
    ("(?<![BDH]..)(?<!H...)GH", "F"), ("G(?=H|N(?![A-Z])|NED)", ""), ("(?<!G)G(?=[EIY])", "J"), ("G", "K"),
    ("(?<![CGPST])H(?=[AEIOU])", "H"),
    ("(?<!C)K", "K"), ("P(?=H)", "F"), ("P", "P"), ("Q", "K"),
    ("S(?=I[AO])", "X"), ("SH", "X"), ("SCH(?=W)", "X"), ("S", "S"),
    ("T(?=I[AO])", "X"), ("TH", "0"), ("T", "T"),
    ("V", "F"), ("W(?=[AEIOU])", "W"), ("X", "KS"), ("Y(?=[AEIOU])", "Y"), ("Z", "S"),
    ("F", "F"), ("J", "J"), ("L", "L"), ("M", "M"), ("N", "N"), ("R", "R"),
)
FIRST_RULES = (("AE", "E"), ("[GKP]N", "N"), ("WH", "H"), ("WR", "R"), ("W[AEIOU]", "W"), ("X", "S"), ("A", "A"), ("E", "E"), ("I", "I"), ("O", "O"), ("U", "U"))


def metaphone(max_length: int = 255):
    """Column function: sound form by English spelling rules, cut to ``max_length`` (1 to 255). Arrow batches.

    Null for a null; empty for a text without letters A-Z. Other characters are silent, but part letters.
    """
    import re

    if not 0 < max_length <= 255:
        raise ValueError("max_length must be between 1 and 255")
    rules = [(re.compile(p), code) for p, code in SOUND_RULES]
    first = [(re.compile(p), code) for p, code in FIRST_RULES]

    def fits(at: int, word: str, table: list) -> tuple[str, int]:
        for pattern, code in table:
            if m := pattern.match(word, at):
                return code, m.end()
        return "", at

    def sound(text: str) -> str:
        word = re.sub("^[^A-Z]+", "", text.upper())
        out, at = fits(0, word, first)
        while at < len(word) and len(out) < max_length:
            again = at > 0 and word[at] == word[at - 1] and word[at] != "C"
            code, end = ("", at) if again else fits(at, word, rules)
            out += code
            at = max(end, at + 1)
        return out[:max_length]

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else sound(x))

    return run
