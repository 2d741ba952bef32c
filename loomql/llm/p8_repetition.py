"""Repetition inside a single document: a threshold table compiled into one projection.

A rule is (name, metric, comparison, bound). ``quality_table`` compiles every metric
a rule list needs into one Spark projection over the text (length, symbol, stop-word,
line and repeated-run ratios) and every rule into a boolean column beside it. No user
function, no shuffle, no Python worker: a document is judged where it is read, so the
plan is one scan and one projection at any size.

Repeated words. Words are maximal runs of letters or digits, case disregarded. A word
is repeated if it lies in a run of five consecutive words that occurred earlier (starting
at an earlier word) in the same text. Runs are compared by their 64-bit hash within one
document. ``n runs - n distinct runs`` is the number of repeated runs; only documents
with at least one go through the exact interval arithmetic, so sound documents pay
for one hash set.

Defined cases: null text gives null metrics and fires no rule; a text without words has
share 0; a text of fewer than six words cannot repeat a run (share 0); ties, repeated
rows and extra columns do not matter (each row is judged alone, all columns are kept;
a metric column replaces an input column of the same name).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 5
FOUND_SHARE = 0.25

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the and of to a in is it that was for on with as at by this his her their my our "
    "der die das und ist ein eine nicht mit auf zu von "
    "el la los las un una y en es que con por "
    "le les des et est dans une du pour sur"
).split()


@dataclass(frozen=True)
class Rule:
    """Fires where ``metric op bound``; op is one of < <= > >=."""

    name: str
    metric: str
    op: str
    bound: float


RULES: tuple[Rule, ...] = (
    Rule("too_short", "n_words", "<", 5),
    Rule("odd_word_length_low", "mean_word_length", "<", 2.5),
    Rule("odd_word_length_high", "mean_word_length", ">", 12),
    Rule("symbol_heavy", "symbol_share", ">", 0.30),
    Rule("digit_heavy", "digit_share", ">", 0.30),
    Rule("no_function_words", "stop_word_share", "<", 0.02),
    Rule("repeated_lines", "repeated_line_share", ">=", 0.30),
    Rule("list_like", "bullet_line_share", ">=", 0.90),
    Rule("cut_off_lines", "ellipsis_line_share", ">=", 0.30),
    Rule("repeated_words", "repeated_word_share", ">=", FOUND_SHARE),
)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _runs(words: Column) -> Column:
    """Hash of each run of five words, in order; empty for shorter texts."""
    return F.when(
        F.size(words) > RUN,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - RUN),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(RUN)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _repeated_starts(tagged: Column) -> Column:
    """Starts of the runs that occurred before, ascending.

    ``tagged``: (hash, start) in order. A start is repeated if the entry before it has the same hash.
    """
    return F.sort_array(
        F.filter(
            F.transform(
                F.sequence(F.lit(1), F.size(tagged) - 1),
                lambda j: F.when(F.get(tagged, j)["h"] == F.get(tagged, j - 1)["h"], F.get(tagged, j)["i"]),
            ),
            lambda i: i.isNotNull(),
        )
    )


def _covered(starts: Column) -> Column:
    """Size of the union of [s, s + 5): each start adds the words up to the next start, five at most."""
    return F.aggregate(
        F.sequence(F.lit(0), F.size(starts) - 1),
        F.lit(0),
        lambda acc, j: acc + F.coalesce(F.least(F.lit(RUN), F.get(starts, j + 1) - F.get(starts, j)), F.lit(RUN)),
    )


def repeated_word_share(
    df: DataFrame, text: str = "text", out: str = "repeated_word_share", at_least: float = 0.0
) -> DataFrame:
    """Add the share of repeated words (double; null for a null text).

    A repeated run adds at most five words, so five times the repeated runs bound the share
    from above: where this bound is below ``at_least`` the share is reported as 0 and the
    exact arithmetic is skipped. Shares of ``at_least`` and more are always exact.
    """
    df = df.withColumn("__p8_words", _words(F.col(text))).withColumn("__p8_runs", _runs(F.col("__p8_words")))
    df = df.withColumn("__p8_again", F.size("__p8_runs") - F.size(F.array_distinct("__p8_runs")))
    again = (F.col("__p8_again") > 0) & (RUN * F.col("__p8_again") >= at_least * F.size("__p8_words"))
    tag = F.sort_array(F.transform("__p8_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__p8_tagged", F.when(again, tag))
    df = df.withColumn("__p8_starts", F.when(again, _repeated_starts(F.col("__p8_tagged"))))
    share = (
        F.when(F.col("__p8_words").isNull(), F.lit(None).cast("double"))
        .when(again, _covered(F.col("__p8_starts")) / F.size("__p8_words"))
        .otherwise(F.lit(0.0))
    )
    return df.withColumn(out, share).drop("__p8_words", "__p8_runs", "__p8_again", "__p8_tagged", "__p8_starts")


def _share_of(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).when(whole.isNotNull(), F.lit(0.0))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def quality_table(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with one column per metric the rules name and one boolean ``is_<rule>`` per rule.

    Only the metrics the rules name are compiled into the plan. An unknown metric or
    comparison raises ValueError; a null text gives null metrics and false rules.
    """
    t = F.col(text)
    words, lines = F.col("__p8_w"), F.col("__p8_l")
    n_words, n_lines, n_chars = F.size(words), F.size(lines), F.length(t)
    present = t.isNotNull()
    metrics: dict[str, Column] = {
        "n_words": F.when(present, n_words),
        "mean_word_length": _share_of(F.length(F.array_join(words, "")), n_words),
        "symbol_share": _share_of(n_chars - F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\s.,;:!?'\"()-]", "")), n_chars),
        "digit_share": _share_of(n_chars - F.length(F.regexp_replace(t, r"\p{N}", "")), n_chars),
        "stop_word_share": _share_of(
            F.size(F.filter(words, lambda w: F.array_contains(F.array(*map(F.lit, STOP_WORDS)), w))), n_words
        ),
        "repeated_line_share": _share_of(n_lines - F.size(F.array_distinct(lines)), n_lines),
        "bullet_line_share": _share_of(F.size(F.filter(lines, lambda x: x.rlike(r"^[-*\u2022]"))), n_lines),
        "ellipsis_line_share": _share_of(F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|\u2026)$"))), n_lines),
    }
    ops = {
        "<": lambda m, b: m < b,
        "<=": lambda m, b: m <= b,
        ">": lambda m, b: m > b,
        ">=": lambda m, b: m >= b,
    }
    needed = list(dict.fromkeys(r.metric for r in rules))
    unknown = [m for m in needed if m not in metrics and m != "repeated_word_share"]
    if unknown or any(r.op not in ops for r in rules):
        raise ValueError(f"unknown metric {unknown} or comparison in {rules}")
    if "repeated_word_share" in needed:
        alone = needed == ["repeated_word_share"] and all(r.op in (">", ">=") for r in rules)
        df = repeated_word_share(df, text, at_least=min(r.bound for r in rules) if alone else 0.0)
        metrics["repeated_word_share"] = F.col("repeated_word_share")
    if needed != ["repeated_word_share"]:
        df = df.withColumn("__p8_w", _words(t)).withColumn("__p8_l", _lines(t))
    # A one-element generator binds the metrics: a filter on a rule stays above it, where pushing it
    # down would copy the metric expressions into the condition once per reference.
    kept = [c for c in df.columns if c not in needed]
    bound = F.explode_outer(F.array(F.struct(*[metrics[m].alias(m) for m in needed]))).alias("__p8_m")
    df = df.select(*kept, bound).select(*kept, *[F.col("__p8_m")[m].alias(m) for m in needed])
    df = df.withColumns({f"is_{r.name}": F.coalesce(ops[r.op](F.col(r.metric), r.bound), F.lit(False)) for r in rules})
    return df.drop("__p8_w", "__p8_l")
