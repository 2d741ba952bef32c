"""Free-entered values mapped to the entries of a reference list.

Token-level repair. Every entry gives forms: its tokens in full, the opening letters (four or
more) and the consonant skeleton of its tokens, and the entry written without spaces. Each
distinct value gives grams: runs of neighbouring tokens written together (as many as the longest entry has, four at
least), which undoes inserted and lost separators. Grams meet forms by edit distance: both sides list what is
left after up to two deletions, and equal remainders are joined (two strings within two edits,
a swap of neighbours counting as one, always share one). Abbreviated forms must be met
exactly. The repaired tokens are combined by soft TF-IDF on both sides: the entry's side is the share of the entry's
squared token weights that was met, each times its squared similarity, where a token of many entries weighs little and
tokens after the first (which names the entry) count ``LATER`` of their weight; the value's side is how much of the value was
explained, tokens that occur in many values counting little. The best entry wins if its
score reaches ``THRESHOLD``; otherwise the value is unmatched.

Scale: rows are reduced to distinct values first (map-side combined); the edit-distance
join is an equi-join on remainders, never a cross join; its size follows the distinct tokens. The
mapping returns to the rows by the hot/cold split, so a value holding a third of the rows is harmless.

Defined cases: null values give no row in ``p1_found``; blanks, punctuation and texts without letters or digits
are unmatched; grams longer than the longest form plus two letters cannot match and are not
expanded (long texts cost their length); ties go to the entry more often typed exactly, then the smaller in order;
null entries are ignored; an empty list makes every value unmatched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomql.operators.skew import hot_cold_join
from loomql.session import durable, stages

THRESHOLD = 0.45
UNMATCHED = "unmatched"
GRAM_TOKENS = 4
MIN_PREFIX = 4
LATER = 0.5
SIM_EDIT, SIM_PREFIX, SIM_SKELETON = 0.15, 0.85, 0.8


def tokens(c: Column) -> Column:
    """Lower-case maximal runs of letters or digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _edits(length: Column) -> Column:
    """Edits allowed for a string: none up to three letters, one up to five, else two."""
    return F.when(length <= 3, 0).when(length <= 5, 1).otherwise(2)


def _without(s: Column, i: Column) -> Column:
    return F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))


def remainders(s: Column) -> Column:
    """Array of (rest, cut): the string after 0, 1 or 2 deletions, as far as its length allows."""
    n = F.length(s)
    places = F.sequence(F.lit(1), n)
    none = F.array(F.struct(s.alias("rest"), F.lit(0).alias("cut")))
    one = F.when(_edits(n) >= 1, F.transform(places, lambda i: F.struct(_without(s, i).alias("rest"), F.lit(1).alias("cut"))))
    two = F.when(
        _edits(n) >= 2,
        F.flatten(
            F.transform(
                F.sequence(F.lit(2), n),
                lambda j: F.transform(
                    F.sequence(F.lit(1), j - 1),
                    lambda i: F.struct(_without(_without(s, j), i).alias("rest"), F.lit(2).alias("cut")),
                ),
            )
        ),
    )
    return F.concat(none, F.coalesce(one, F.slice(none, 1, 0)), F.coalesce(two, F.slice(none, 1, 0)))


def _forms(entries: DataFrame) -> DataFrame:
    """(entry, spot, form, exact, sim, part): spot -1 is the whole entry, spot 0 its first token.

    ``part``: the share of the token's squared weight in the entry's.
    """
    e = durable(entries.select("entry", tokens(F.col("entry")).alias("t")).where(F.size("t") > 0), "listed")
    tok = e.select("entry", F.posexplode("t").alias("spot", "tok"))
    n_entries = F.lit(e.count())
    held = tok.groupBy("tok").agg(F.count_distinct("entry").alias("df"), F.count(F.lit(1)).alias("n"))
    weighed = hot_cold_join(tok, durable(held, "held"), ["tok"], "n", "inner").withColumn(
        "w2", F.pow(F.log(1 + n_entries / F.col("df")) * F.when(F.col("spot") > 0, LATER).otherwise(1.0), 2)
    )
    of = weighed.groupBy("entry").agg(F.sum("w2").alias("of"))
    tok = durable(weighed.join(of, "entry").select("entry", "spot", "tok", (F.col("w2") / F.col("of")).alias("part")), "tokens")
    full = tok.select("entry", "spot", F.col("tok").alias("form"), F.lit(False).alias("exact"), F.lit(1.0).alias("sim"), "part")
    whole = e.select("entry", F.lit(-1).alias("spot"), F.array_join("t", "").alias("form"), F.lit(False).alias("exact"), F.lit(1.0).alias("sim"), F.lit(0.0).alias("part"))
    head = tok.where("spot = 0")
    prefix = head.where(F.length("tok") > MIN_PREFIX).select(
        "entry", "spot",
        F.explode(F.transform(F.sequence(F.lit(MIN_PREFIX), F.length("tok") - 1), lambda n: F.substring("tok", F.lit(1), n))).alias("form"),
        F.lit(True).alias("exact"), F.lit(SIM_PREFIX).alias("sim"), "part",
    )
    bones = F.concat(F.substring("tok", 1, 1), F.regexp_replace(F.substring("tok", 2, 1000), "[aeiou]", ""))
    skeleton = head.select(
        "entry", "spot", F.explode(F.array_distinct(F.array(bones, F.substring(bones, 1, 4)))).alias("form"),
        F.lit(True).alias("exact"), F.lit(SIM_SKELETON).alias("sim"), "part",
    ).where(F.length("form") >= 3)
    return full.unionByName(whole).unionByName(prefix).unionByName(skeleton)


def mapping(values: DataFrame, entries: DataFrame) -> DataFrame:
    """(value, n) x (entry, seen) -> (value, n, entry): the closest entry, null where none is close enough.

    ``values`` distinct and not null with their row counts; ``seen``: how often the entry was typed exactly.
    """
    forms = durable(_forms(entries.select("entry")), "forms")
    longest, most = forms.agg(F.max(F.length("form")), F.max("spot")).first()
    longest, run = longest or 0, max(GRAM_TOKENS, (most or 0) + 1)
    vals = durable(
        values.select("value", "n", tokens(F.col("value")).alias("t")).withColumn("vid", F.monotonically_increasing_id()), "values"
    )
    # weights of the value side: tokens that occur in many distinct values say little
    n_values = F.lit(vals.count())
    toks = vals.select("vid", F.posexplode("t").alias("i", "tok"))
    spread = durable(
        toks.groupBy("tok").agg(F.count_distinct("vid").alias("df"), F.count(F.lit(1)).alias("rows")), "spread"
    )
    weighted = hot_cold_join(toks, spread, ["tok"], "rows", "inner")
    weights = weighted.groupBy("vid").agg(
        F.map_from_entries(F.collect_list(F.struct("i", F.log(1 + n_values / F.col("df"))))).alias("w"),
        F.sum(F.log(1 + n_values / F.col("df"))).alias("w_all"),
    )
    grams = vals.select("vid", "t", F.posexplode("t").alias("i", "tok")).select(
        "vid", "i",
        F.explode(F.sequence(F.lit(1), F.least(F.lit(run), F.size("t") - F.col("i")))).alias("len"), "t",
    ).select("vid", "i", "len", F.array_join(F.slice("t", F.col("i") + 1, F.col("len")), "").alias("gram"))
    grams = durable(grams.where(F.length("gram") <= longest + 2), "grams")
    distinct = durable(grams.select("gram").distinct(), "distinct")
    fuzzy_forms = forms.where("not exact").select(
        "entry", "spot", "form", "sim", "part", F.explode(remainders(F.col("form"))).alias("r")
    ).select("entry", "spot", "form", "sim", "part", F.col("r.rest").alias("rest"), F.col("r.cut").alias("form_cut"))
    fuzzy_grams = distinct.select("gram", F.explode(remainders(F.col("gram"))).alias("r")).select(
        "gram", F.col("r.rest").alias("rest"), F.col("r.cut").alias("gram_cut")
    )
    edits = F.greatest("form_cut", "gram_cut")
    near = hot_cold_join(fuzzy_grams, fuzzy_forms, ["rest"], None, "inner").where(
        (edits <= _edits(F.least(F.length("form"), F.length("gram")))) & (F.levenshtein("form", "gram") <= 2 * edits)
    ).groupBy("gram", "entry", "spot").agg(F.max(F.col("sim") - SIM_EDIT * edits).alias("sim"), F.max("part").alias("part"))
    short = distinct.join(forms.where("exact"), distinct.gram == forms.form).select("gram", "entry", "spot", "sim", "part")
    met = near.unionByName(short).groupBy("gram", "entry", "spot").agg(F.max("sim").alias("sim"), F.max("part").alias("part"))
    # a common token meets all its values and all its entries: cut like any hot key
    pieces = hot_cold_join(grams, durable(met, "met"), ["gram"], None, "inner")
    # entry side
    per_spot = pieces.groupBy("vid", "entry", "spot").agg(F.max("sim").alias("sim"), F.max("part").alias("part"), F.collect_set(F.struct("i", "len")).alias("at"))
    cand = per_spot.groupBy("vid", "entry").agg(
        F.coalesce(F.max(F.when(F.col("spot") == -1, F.col("sim"))), F.lit(0.0)).alias("whole"),
        F.sqrt(F.sum(F.col("sim") * F.col("sim") * F.col("part"))).alias("by_token"),
        F.flatten(F.collect_list("at")).alias("at"),
    )
    spots = F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["i"], x["i"] + x["len"] - 1))))
    explained = F.aggregate(spots, F.lit(0.0), lambda a, i: a + F.coalesce(F.element_at("w", i), F.lit(0.0)))
    scored = (
        cand.join(weights, "vid").join(entries, "entry")
        .withColumn("score", F.greatest("whole", "by_token") * F.sqrt(explained / F.col("w_all")))
        .where(F.col("score") >= THRESHOLD)
    )
    best = scored.groupBy("vid").agg(
        F.min_by("entry", F.struct(-F.round("score", 9), -F.col("seen"), F.col("entry"))).alias("entry")
    )
    return vals.select("vid", "value", "n").join(best, "vid", "left").select("value", "n", "entry")


def map_rows(rows: DataFrame, key: str, value: str, listed: DataFrame, entry: str) -> DataFrame:
    """(key, entry or ``unmatched``) for each row whose value is not null and not exactly an entry."""
    rows = rows.select(F.col(key).alias("_key"), F.col(value).alias("value")).where(F.col("value").isNotNull())
    typed = durable(rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")), "typed")
    entries = listed.select(F.col(entry).alias("entry")).where(F.col("entry").isNotNull()).distinct()
    entries = durable(
        entries.join(typed, entries.entry == typed.value, "left").select("entry", F.coalesce("n", F.lit(0)).alias("seen")), "entries"
    )
    other = typed.join(entries, typed.value == entries.entry, "left_anti")
    with stages(rows.sparkSession) as scope:
        mapped = durable(mapping(other, entries), "mapped")
        scope.keep(mapped)
    return hot_cold_join(rows, mapped, ["value"], "n", "inner").select(
        F.col("_key").alias(key), F.coalesce("entry", F.lit(UNMATCHED)).alias(entry)
    )
