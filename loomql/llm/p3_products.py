"""Product listings that describe the same item, by generic merge resolution.

A listing is read into attributes: model code, series word, colour and measured values in one unit per kind
(volume, power, weight, length, memory, pack). Listings that match merge into a profile whose attributes are the union of
theirs (the most frequent value of each kind). In each round the listings still alone are blocked anew against
the profiles as they have become, by series and, where they name none, by the series that their group hint has
gained, and matched; complete attribute sets that fit no profile become profiles themselves and take part.
The rounds end only when one changes nothing. A listing without a code joins the one profile of its block that agrees
with at least one of its attributes, contradicts none and agrees best; several equally good
profiles are told apart by a patchy group hint (a majority of the hint's listings), or it stays alone. What is left is
merged as a repeated text.

Codes and series are learned from the data, no format is given. A code is a run of letters and digits (joined by dashes,
slashes, underscores or one space) that starts with a letter and is no measure; its base is the code without its last letters. A
spelling with a lost or an added space counts only if the code, or its base, is also written in one
piece. The series word of a base is a word that occurs in most listings of the base and nearly only beside codes with the
same first letters; bases with one series word form one block. Codes of one base that differ in their last letters are variants.

Scale: every round moves distinct attribute sets, not listings (a profile is an aggregate with map-side
combining). Blocks, codes and hints that hold many sets are cut by the skew join; the fits of a set are counted, not
collected. The assignment returns to the listings by the same join. The pairs of a group are emitted in blocks of
``PAIR_BLOCK`` rows, so no task holds a large group.

Defined cases: null texts read as empty; a null id is ignored; listings without any attribute stay alone
unless their whole text repeats; repeated ids are paired once; an empty table gives no pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomql.operators.skew import Hot, hot_cold_join, hot_of
from loomql.session import durable, stages

from .p2_formatting import canonical
from .text import fold

PAIR_BLOCK = 500
SERIES_SHARE, SERIES_SUPPORT = 0.9, 0.5

# Colour words, units with their factor to the unit of the kind.
COLOURS = "black|white|grey|gray|red|blue|green|yellow|silver|silvery|orange|brown|pink|purple|gold|beige"
UNITS: dict[str, dict[str, float]] = {
    "volume": {"ml": 1, "cl": 10, "l": 1000, "litre": 1000, "litres": 1000, "liter": 1000, "liters": 1000},
    "power": {"w": 1, "watt": 1, "watts": 1, "kw": 1000},
    "weight": {"g": 1, "gr": 1, "gram": 1, "grams": 1, "kg": 1000, "lb": 453.592, "lbs": 453.592, "oz": 28.3495},
    "length": {"mm": 1, "cm": 10, "m": 1000, "in": 25.4, "inch": 25.4, "inches": 25.4, '"': 25.4},
    "memory": {"gb": 1, "gigabyte": 1, "gigabytes": 1, "mb": 1 / 1024, "tb": 1024},
}
PACKS = ("pack", "pcs", "pieces", "piece", "pc")
DASH = "-‐-―_/"
_NAMES = "|".join(sorted((n for u in UNITS.values() for n in u), key=len, reverse=True))
MEASURE = rf"(\d+(?:[.,]\d+)?)\s*-?({_NAMES})(?![a-z0-9])"
# Runs with a digit in one piece, and short letters with a number after spaces or dashes.
RUN = rf"(?<![a-z0-9])(?:[a-z]++[{DASH}]{{0,2}}+)++\d[a-z0-9]*+(?:[{DASH}]{{1,2}}+[a-z0-9]++)*+"
SPACED = rf"(?<![a-z0-9])[a-z]{{1,3}}[\s\u00a0{DASH}]{{1,3}}+\d{{2,}}+(?:[\s\u00a0][a-z]{{1,2}}(?![a-z0-9])|[{DASH}]{{0,2}}[a-z]*+)"


def _two_digits(value: Column) -> Column:
    """Rounded to two significant digits, so that converted units meet."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(value)) - 1)
    return F.when(value > 0, F.round(value / scale) * scale)


def _pack(text: Column) -> Column:
    patterns = (r"(\d+)\s*-?\s*(?:" + "|".join(PACKS) + r")\b", r"\bset of (\d+)\b", r"(?<![a-z0-9])x\s?(\d+)\b", r"\bpack\s*[=:]?\s*x?(\d+)\b")
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("double") for p in patterns]).cast("string")


def _joined(runs: Column) -> Column:
    """Runs without what joins them."""
    return F.transform(runs, lambda t: F.regexp_replace(t, "[^a-z0-9]", ""))


def read_offers(offers: DataFrame) -> DataFrame:
    """(id, title, description, brand, price, hint) -> what each listing says, codes still undecided.

    Columns: id, hint, copy (hash of the whole text), maker, runs and spaced (possible codes in order, the title's first),
    words, labels (words before a number), measures (number, unit), colour, pack.
    """
    title, desc = fold(F.coalesce("title", F.lit(""))), fold(F.coalesce("description", F.lit("")))
    brand = fold(F.coalesce("brand", F.lit("")))
    df = offers.where("id is not null").select(
        F.col("id").cast("string").alias("id"), "hint", title.alias("t"), desc.alias("d"), brand.alias("br"),
        F.xxhash64(canonical(title), canonical(desc), canonical(fold(F.coalesce("price", F.lit(""))))).alias("copy"),
    ).withColumn("x", F.concat_ws(" . ", "t", "d"))
    colour_t = F.regexp_extract("t", rf"\b({COLOURS})\b", 1)
    colour_d = F.regexp_extract("d", rf"\bcolou?r\s*[=:]?\s*(?:[a-z]+\s)??({COLOURS})\b", 1)
    colour = F.when(colour_d != "", colour_d).when(colour_t != "", colour_t)
    colour = F.when(colour == "gray", "grey").when(colour == "silvery", "silver").otherwise(colour)
    words = F.concat(
        F.regexp_extract_all("t", F.lit(r"[a-z]{5,}"), F.lit(0)),
        F.regexp_extract_all("d", F.lit(r"(?:from the|series\s*[:=]?)\s+([a-z]{5,})"), F.lit(1)),
    )
    own = F.regexp_extract_all("br", F.lit(r"[a-z]{3,}"), F.lit(0))
    measured = F.transform(
        F.regexp_extract_all("x", F.lit(MEASURE), F.lit(0)),
        lambda m: F.struct(F.regexp_extract(m, MEASURE, 1).alias("number"), F.regexp_extract(m, MEASURE, 2).alias("unit")),
    )
    size = rf"^x?\d+(?:{_NAMES}|{'|'.join(PACKS)})?$"
    return df.select(
        "id", "hint", "copy", F.regexp_extract("br", "[a-z]+", 0).alias("maker"),
        F.filter(_joined(F.regexp_extract_all("x", F.lit(RUN), F.lit(0))), lambda t: ~t.rlike(size)).alias("runs"),
        _joined(F.regexp_extract_all("x", F.lit(SPACED), F.lit(0))).alias("spaced"),
        F.array_distinct(F.array_except(words, own)).alias("words"),
        F.array_distinct(F.regexp_extract_all("x", F.lit(r"(?<![a-z0-9])([a-z]{4,})\s*[:=]?\s+\d"), F.lit(1))).alias("labels"), measured.alias("measures"), colour.alias("colour"), _pack(F.col("x")).alias("pack"),
    )


def _base(code: Column) -> Column:
    return F.regexp_replace(code, "[a-z]+$", "")


def _glued(run: Column) -> Column:
    """Codes that a run may hold between words that lost their space: up to four letters, the number, up to two letters."""
    before, number, after = F.regexp_extract(run, r"^([a-z]+)", 1), F.regexp_extract(run, r"^[a-z]+(\d+)", 1), F.regexp_extract(run, r"^[a-z]+\d+([a-z]*)", 1)
    cuts = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(4), F.length(before))),
        lambda n: F.transform(
            F.sequence(F.lit(0), F.least(F.lit(2), F.length(after))),
            lambda m: F.concat(F.right(before, n), number, F.left(after, m)),
        ),
    )
    return F.filter(F.flatten(cuts), lambda c: c != run)


def _codes(read: DataFrame) -> DataFrame:
    """(id, code, base): the code of each listing that has one."""
    runs = read.select("id", "maker", F.posexplode("runs").alias("at", "code"))
    written = runs.groupBy("code", "maker").agg(F.count(F.lit(1)).alias("n")).groupBy("code").agg(
        F.sum("n").alias("n"), F.max(F.when(F.col("maker") != "", F.col("n"))).alias("top"), F.sum(F.when(F.col("maker") != "", F.col("n"))).alias("named")
    )
    # a word that lost the space before a number is no code: its letters are frequent as a word of their own
    plain = read.select(F.explode(F.array_union("words", "labels")).alias("letters")).groupBy("letters").agg(F.count(F.lit(1)).alias("as_word"))
    written = written.withColumn("letters", F.regexp_extract("code", "^[a-z]+", 0)).join(plain, "letters", "left")
    # what several makers write alike is no code of one of them
    one_maker = F.col("named").isNull() | (2 * F.col("top") >= F.col("named"))
    written = written.where(one_maker & (F.coalesce("as_word", F.lit(0)) <= F.col("n")))
    written = durable(written.select("code", "n", _base(F.col("code")).alias("base")), "written")
    # a run written once that begins or ends a known code is that code, damaged
    ends = F.concat(
        F.transform(F.sequence(F.lit(3), F.length("code") - 1), lambda n: F.left("code", n)),
        F.transform(F.sequence(F.lit(3), F.length("code") - 1), lambda n: F.right("code", n)),
    )
    ends = written.where((F.col("n") >= 2) & (F.length("code") > 3)).select(F.explode(ends).alias("code")).distinct()
    written = durable(written.where("n > 1").unionByName(written.where("n = 1").join(ends, "code", "left_anti")), "written")
    bases = written.groupBy("base").agg(F.sum("n").alias("base_n"), F.max(F.col("base") != F.col("code")).alias("varies"))
    tried = runs.select("id", "at", F.col("code").alias("run"), F.lit(0).alias("kind"), "code")
    tried = tried.unionByName(
        read.select("id", F.posexplode("spaced").alias("at", "run")).select("id", "at", "run", F.lit(1).alias("kind"), F.col("run").alias("code"))
    ).unionByName(
        read.select("id", F.posexplode(F.concat("runs", "spaced")).alias("at", "run")).where(F.length("run") > 6).select(
            "id", "at", "run", F.lit(2).alias("kind"), F.explode(_glued(F.col("run"))).alias("code")
        )
    )
    tried = durable(tried.withColumn("base", _base(F.col("code"))), "tried")
    kinds = tried.groupBy("code", "base").agg(F.count(F.lit(1)).alias("uses"))
    known = durable(
        kinds.join(written.select("code", "n"), "code", "left").join(bases, "base", "left")
        .select("code", "uses", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("base_n", F.lit(0)).alias("base_n"), F.coalesce("varies", F.lit(False)).alias("varies")),
        "known",
    )
    met = hot_cold_join(tried, known, ["code"], "uses", "inner")
    # a known base with up to two letters; longer tails may be a word that lost its space
    short = (F.col("base_n") >= 2) & (F.length("code") - F.length("base") <= 2)
    rank = (
        F.when((F.col("kind") == 0) & short, 0)
        .when((F.col("kind") == 1) & short, 1)
        .when((F.col("kind") == 2) & short & (F.col("n") > 0), 2)
        .when((F.col("kind") == 0) & (F.col("n") >= 2), 3)
        .when((F.col("kind") == 2) & short, 4)
        .when((F.col("kind") == 0) & (F.col("n") > 0), 5)
    )
    best = met.withColumn("rank", rank).where("rank is not null").groupBy("id").agg(
        F.min_by(
            F.struct("code", "base", "varies"),
            F.struct("rank", -F.when(F.col("kind") == 2, F.col("base_n")).otherwise(0), "at", -F.length("code"), "code"),
        ).alias("c")
    )
    # the bare base of codes that vary tells the block only
    return best.select("id", F.when((F.col("c.code") != F.col("c.base")) | ~F.col("c.varies"), F.col("c.code")).alias("code"), "c.base")


def _has_unit(units: dict[str, float]) -> Callable[[Column], Column]:
    return lambda m: m["unit"].isin(*units)


def _specs() -> Column:
    """Attributes of a listing whose code is decided; the number and letters of the code are no measure."""
    own = F.filter("measures", lambda m: ~F.coalesce(F.endswith(F.col("code"), F.concat(m["number"], m["unit"])), F.lit(False)))
    pairs = {"colour": F.col("colour"), "pack": F.col("pack")}
    for kind, units in UNITS.items():
        first = F.get(F.filter(own, _has_unit(units)), F.lit(0))
        factor = F.element_at(F.create_map(*[x for n, f in units.items() for x in (F.lit(n), F.lit(float(f)))]), first["unit"])
        pairs[kind] = _two_digits(F.replace(first["number"], F.lit(","), F.lit(".")).cast("double") * factor).cast("string")
    return F.map_filter(F.create_map(*[x for k, v in sorted(pairs.items()) for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


def _series(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, block, uses) of series words, (base, block) of the bases that have one."""
    coded = read.where("base is not null").select("base", "words", F.regexp_extract("base", "^[a-z]+", 0).alias("family"))
    sizes = coded.groupBy("base").agg(F.count(F.lit(1)).alias("offers"))
    uses = durable(
        coded.select("base", "family", F.explode("words").alias("word")).groupBy("word", "family", "base").agg(F.count(F.lit(1)).alias("n")), "uses"
    )
    total = uses.groupBy("word", "family").agg(F.sum("n").alias("n")).groupBy("word").agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    total = total.where(F.col("top") >= SERIES_SHARE * F.col("all")).select("word", "top")
    held = uses.join(total, "word").join(sizes, "base").where(F.col("n") >= SERIES_SUPPORT * F.col("offers"))
    held = durable(held.select("word", "base", "n"), "held")
    of_base = durable(held.groupBy("base").agg(F.max_by("word", F.struct("n", "word")).alias("block")), "of_base")
    of_word = held.join(of_base, "base").groupBy("word").agg(F.max_by("block", F.struct("n", "block")).alias("block"), F.sum("n").alias("uses"))
    return of_word, of_base


def _profiles(members: DataFrame) -> DataFrame:
    """(block, product, specs, n) of weighted attribute sets -> (block, product, profile): merged attributes."""
    # a set without attributes votes for none, so that its product has a profile too
    votes = members.select("block", "product", "n", F.explode_outer("specs").alias("kind", "value"))
    votes = votes.groupBy("block", "product", "kind", "value").agg(F.sum("n").alias("n"))
    best = votes.groupBy("block", "product", "kind").agg(F.max_by("value", F.struct("n", "value")).alias("value"))
    known = F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "value")))
    return best.groupBy("block", "product").agg(F.map_from_entries(known).alias("profile"))


def _hinted(done: DataFrame) -> DataFrame:
    """(hint, hinted, hinted_block): the product that most listings of a hint belong to."""
    hints = done.where("hint is not null").groupBy("hint", "block", "product").agg(F.sum("n").alias("n"))
    return hints.groupBy("hint").agg(
        F.max_by("product", F.struct("n", "product")).alias("hinted"), F.max_by("block", F.struct("n", "product")).alias("hinted_block")
    )


def _matched(alone: DataFrame, done: DataFrame, profiles: DataFrame, blocks: Hot, hints: Hot) -> DataFrame:
    """(set, in_block, won): the attribute sets that join a profile in this round.

    ``blocks`` and ``hints``: those with many sets, which are cut.
    """
    named = hot_cold_join(alone.where("hint is not null"), _hinted(done), ["hint"], hints, "left")
    named = named.unionByName(alone.where("hint is null"), allowMissingColumns=True)
    asked = named.withColumn("block", F.coalesce("block", "hinted_block")).where("block is not null")
    tried = hot_cold_join(asked, profiles.withColumnRenamed("product", "p"), ["block"], blocks, "inner")
    keys = F.map_keys("specs")
    same = F.size(F.filter(keys, lambda k: F.element_at("profile", k) == F.element_at("specs", k)))
    clash = F.size(F.filter(keys, lambda k: F.element_at("profile", k) != F.element_at("specs", k)))
    fits = tried.withColumn("same", same).where((clash == 0) & (F.col("same") > 0))
    # how many profiles fit equally well, counted per set and degree
    level = fits.groupBy("set", "block", "hinted", "same").agg(F.count(F.lit(1)).alias("many"), F.min("p").alias("p"), F.max(F.col("p") == F.col("hinted")).alias("as_hinted"))
    best = level.groupBy("set", "block", "hinted").agg(F.max_by(F.struct("many", "p"), "same").alias("top"), F.max("as_hinted").alias("as_hinted"))
    won = F.when(F.col("top.many") == 1, F.col("top.p")).when(F.col("as_hinted"), F.col("hinted"))
    return best.select("set", F.col("block").alias("in_block"), won.alias("won")).where("won is not null")


def _complete(alone: DataFrame, profiles: DataFrame, blocks: Hot) -> DataFrame:
    """(set, in_block, won): sets that have every kind which half the products of their block have; each is a product of its own."""
    # the kind without a name counts the products
    kinds = profiles.select("block", F.explode(F.array_append(F.map_keys("profile"), F.lit(""))).alias("kind")).groupBy("block", "kind").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy("block").agg(F.max(F.when(F.col("kind") == "", F.col("n"))).alias("products"), F.collect_list(F.struct("kind", "n")).alias("kinds"))
    usual = F.filter("kinds", lambda k: (k["kind"] != "") & (2 * k["n"] >= F.col("products")))
    kinds = kinds.select("block", F.transform(usual, lambda k: k["kind"]).alias("kinds")).where(F.size("kinds") > 0)
    rest = hot_cold_join(alone.where("block is not null"), kinds, ["block"], blocks, "inner")
    return rest.where(F.size(F.array_except("kinds", F.map_keys("specs"))) == 0).select(
        "set", F.col("block").alias("in_block"), F.concat_ws("|", "block", "sig").alias("won")
    )


def resolve(sets: DataFrame) -> DataFrame:
    """(set, block, product, sig, hint, specs, n) -> (set, product): sets that had no product and were given one.

    Merges until a round changes nothing. ``sets`` is a durable table with a unique ``set``. Each round writes the sets that
    had no product as they have become, so its plans do not grow with the rounds; what is hot is told once, from all sets.
    """
    coded = sets.where("product is not null and block is not null")
    now = sets.where("product is null")
    with stages(sets.sparkSession) as scope:
        sizes = lambda of: of.agg(F.count(F.lit(1)).alias("n"))
        blocks = hot_of(durable(sizes(sets.where("block is not null").groupBy("block")), "sizes"), ["block"], "n")
        hints = hot_of(durable(sizes(now.where("hint is not null").groupBy("hint")), "sizes"), ["hint"], "n")
        while True:
            alone, done = now.where("product is null"), coded.unionByName(now.where("product is not null"))
            with stages(sets.sparkSession) as one_round:
                profiles = durable(_profiles(done), "profiles")
                won = durable(_matched(alone, done, profiles, blocks, hints), "won")
                if won.isEmpty():
                    won = durable(_complete(alone, profiles, blocks), "won")
                    if won.isEmpty():
                        break
                became = {"block": F.coalesce("in_block", "block"), "product": F.coalesce("won", "product")}
                now = durable(now.join(won, "set", "left").withColumns(became).drop("in_block", "won"), "now")
                one_round.keep(now)
        scope.keep(now)
    return now.where("product is not null").select("set", "product")


def group(offers: DataFrame) -> DataFrame:
    """(id, title, description, brand, price, hint) -> (id, product): listings of one product share the label."""
    with stages(offers.sparkSession) as scope:
        read = durable(read_offers(offers), "offers")
        read = durable(read.join(_codes(read), "id", "left").withColumn("specs", _specs()).drop("runs", "spaced", "measures", "colour", "pack", "maker", "labels"), "coded")
        of_word, of_base = _series(read)
        of_word = durable(of_word, "series")
        uncoded = read.where("base is null").select("id", F.explode("words").alias("word"))
        named = hot_cold_join(uncoded, of_word, ["word"], "uses", "inner")
        named = named.groupBy("id").agg(F.min("block").alias("found"), F.max("block").alias("other")).where("found = other").select("id", "found")
        sizes = read.where("base is not null").groupBy("base").agg(F.count(F.lit(1)).alias("w"))
        read = hot_cold_join(read, durable(sizes.join(of_base, "base", "left"), "bases"), ["base"], "w", "left").join(named, "id", "left")
        read = durable(
            read.withColumn("block", F.coalesce("block", "base", "found")).drop("found", "words")
            .withColumn("sig", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("specs"))))).withColumnRenamed("code", "product"),
            "based",
        )
        # distinct attribute sets with their weight: what the rounds work on; null parts are named so that the sets can be met again
        keys = {"b": F.coalesce("block", F.lit("")), "p": F.coalesce("product", F.lit("")), "h": F.coalesce(F.concat(F.lit("h"), "hint"), F.lit(""))}
        read = read.withColumns(keys)
        sets = read.groupBy("b", "p", "sig", "h").agg(
            F.first("specs").alias("specs"), F.count(F.lit(1)).alias("n"), F.first("block").alias("block"), F.first("product").alias("product"), F.first("hint").alias("hint")
        ).withColumn("set", F.monotonically_increasing_id())
        sets = durable(sets, "sets")
        given = resolve(sets.select("set", "block", "product", "sig", "hint", "specs", "n"))
        assigned = durable(
            sets.where("product is null").join(given.withColumnRenamed("product", "won"), "set").select("b", "sig", "h", "n", "won"), "assigned"
        )
        free = hot_cold_join(read.where("product is null").select("id", "copy", "b", "sig", "h"), assigned, ["b", "sig", "h"], "n", "left")
        text = F.concat(F.lit("text|"), F.col("b"), F.lit("|"), F.col("copy").cast("string"))
        out = read.where("product is not null").select("id", "product").unionByName(free.select("id", F.coalesce("won", text).alias("product")))
        out = durable(out, "grouped")
        scope.keep(out)
        return out


def pairs(groups: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """(id, product) -> (id_a, id_b), id_a < id_b: all pairs of each group, block by block."""
    rows = durable(groups.distinct(), "members")
    sizes = rows.groupBy("product").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = durable(sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "sizes")
    rows = hot_cold_join(rows, sizes, ["product"], "n", "inner")
    rows = rows.withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    spread = rows.select("id", "product", "at", F.explode(every).alias("o")).select(
        "id", "product", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"), "at"
    )
    left = spread.where("at = i").select("product", "i", "j", F.col("id").alias("x"))
    right = spread.where("at = j").select("product", "i", "j", F.col("id").alias("y"))
    met = left.join(right, ["product", "i", "j"]).where("(i = j and x < y) or (i < j and x <> y)")
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
