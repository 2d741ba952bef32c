"""Variant spellings of names linked by suffix blocking and common-subsequence ratio.

Names are reduced to distinct strings and read into parts: surname, given and middle name,
generation, and for organisations named after a person their kind. Order does not matter: a comma, and
otherwise which tokens are given names, tells the surname (given names are the reference list's and
those that occur with many surnames). A learned name that is a nickname of the list, or shortens a longer given
name and stands before a fifth of its surnames like that one, tells the order only: it is a short form, not a name of its own.

Suffix blocking. The suffixes of the surname (read forwards and backwards, so that a typo at one end leaves the
other) are indexed together with the initial, and those of the given name together with either end of
the surname. A suffix is never used alone, and one that is still common after this refinement is kept as it is
and only paired block by block, so which names meet does not depend on how many share a suffix. Candidates are compared, where they meet
and before anything is written, by a bound of the ratio and then by the longest-common-subsequence ratio of their surnames; given and middle names must agree (equal,
nickname, initial, abbreviation or typo), generations and kinds must not differ. Two spellings more than one
letter apart that both occur as surnames of several persons are different surnames, two given names of the list are different names.

Scale: distinct names only, by their number; the join is an equi-join on refined suffixes and blocks between author names and all names;
the result returns to the rows by the distinct name, spread by the hot/cold split. The pairs that meet grow with the square of
the names under one key, in time; on disk are only the keyed names, their copies for the blocks and the pairs that agree.

Defined cases: null, blank and one-part names give no link; a surname of one letter gives none (it is an initial); a last token of two
letters is read both as surname and as initials; initials that fit two listed
authors of one surname give no link; equal strings are the same name and give no row;
repeated rows give one row each; nulls in other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomql.operators.skew import hot_cold_join
from loomql.session import durable, shuffles_removed, stages

from .text import fold, lcs_ratio

# Titles and roles, particles, generations, kinds of organisation.
ROLES = "dr|prof|professor|sir|mr|mrs|ms|miss|dame|rev|by|the|phd|md|author|editor|translator|illustrator"
PARTICLES = "de|del|della|der|den|di|da|du|la|le|van|von|zu"
GENERATIONS = "jr|sr|ii|iii|iv|junior|senior"
KINDS = {
    "institute": "institute|inst|instit",
    "department": "department|dept|dep",
    "society": "society|soc",
    "association": "association|assoc|assn|ass",
    "foundation": "foundation|fdn|found|fndn",
    "museum": "museum|mus",
    "press": "university|univ|press|uni",
    "publishing": "publishing|publ|pub|company|co|publishers",
}
LINKS = "of|for|f|and"
SURNAME_RATIO = 0.86
LEAST_RATIO = 0.79
ONE_TYPO = 0.9
GIVEN_RATIO = 0.79
KNOWN_SURNAME_INITIALS = 3
SHORT_SHARE = 0.2
BROADCAST_NAMES = 200_000
NAMES_PER_BLOCK = 400
HOT_KEYS = 1000
ROWS_PER_BLOCK = 1000


def _tokens(c: Column) -> Column:
    """Letters only; a hyphen inside a name joins its halves."""
    joined = F.regexp_replace(c, r"(?<=\p{L})['’](?=\p{L})", "")
    joined = F.regexp_replace(joined, r"(?<=\p{L}{3})-(?=\p{L}{3})", "")
    joined = F.regexp_replace(joined, r"(?<=\p{L})-(?=\p{L}{4})", "")
    return F.regexp_extract_all(joined, F.lit(r"\p{L}+"), F.lit(0))


def _in(t: Column, words: str) -> Column:
    return t.isin(*words.split("|"))


def read_names(names: DataFrame) -> DataFrame:
    """(id, name, listed) -> (id, listed, toks, kind, gen): folded tokens without roles and particles, in given-first order."""
    spaced = F.regexp_replace("name", r"(?<=\p{Ll}{2})(?=\p{Lu}\p{Ll})", " ")  # a lost space between two names
    text = F.regexp_replace(fold(spaced), r"\bet\s+al\b\.?|\bph\.?\s?d\b\.?|,\s*m\.d\.", " ")
    text = F.regexp_replace(text, r"\((author|editor|ed\.?|translator|illustrator)\)", " ")
    text = F.regexp_replace(text, rf",\s*({GENERATIONS})\b\.?", " $1 ")
    text = F.regexp_replace(text, r"[,\s]+$", "")
    before, after = F.substring_index(text, ",", 1), F.regexp_extract(text, r"(?s)^[^,]*,(.*)$", 1)
    ordered = F.concat_ws(" ", after, before)
    toks = _tokens(ordered)
    all_kinds = "|".join(KINDS.values())
    kind = F.get(F.filter(toks, lambda t: _in(t, all_kinds)), F.lit(0))
    named = F.lit(None).cast("string")
    for k, words in KINDS.items():
        named = F.when(_in(kind, words), F.lit(k)).otherwise(named)
    gen = F.get(F.filter(toks, lambda t: _in(t, GENERATIONS)), F.lit(0))
    gen = F.when(gen == "junior", "jr").when(gen == "senior", "sr").otherwise(gen)
    plain = F.filter(toks, lambda t: ~_in(t, f"{ROLES}|{PARTICLES}|{GENERATIONS}"))
    return names.select("id", "listed", plain.alias("toks"), named.alias("kind"), gen.alias("gen"))


def _short_forms(before: DataFrame, learned: DataFrame, known: DataFrame) -> DataFrame:
    """(g): learned names that contract a longer known name, or are its pet form, and share surnames with it.

    ``before`` has each first token ``g`` with the last tokens ``s`` it stands before, once each.
    """
    longer = F.broadcast(known.select(F.col("g").alias("f")))
    contraction = (F.length("g") <= 5) & F.regexp_like("f", F.regexp_replace("g", r"(?<=.)(?=.)", ".*"))
    pet = F.col("g").rlike("(ie|y)$") & (F.substring("g", 1, 3) == F.substring("f", 1, 3))
    fits = learned.join(longer, F.substring("g", 1, 1) == F.substring("f", 1, 1)).where(
        (F.length("g") < F.length("f")) & (contraction | pet)
    )
    met = before.join(F.broadcast(fits), "g").join(
        before.select(F.col("g").alias("f"), "s", F.lit(1).alias("shared")), ["f", "s"], "left"
    )
    share = met.groupBy("g", "f").agg((F.count("shared") / F.count(F.lit(1))).alias("share"))
    return share.where(F.col("share") >= SHORT_SHARE).select("g").distinct()


def _orgless(read: DataFrame) -> DataFrame:
    """The names read, those of organisations reduced to the person's."""
    all_kinds = "|".join(KINDS.values())
    # topic words of organisations: what follows "of" or "for" after a kind
    link_at = F.array_position(F.transform("toks", lambda t: _in(t, "of|for|f")), True)
    topics = read.where(F.col("kind").isNotNull()).select(
        F.explode(F.slice("toks", link_at + 1, F.when(link_at > 0, F.size("toks")).otherwise(0))).alias("t")
    )
    topics = topics.groupBy("t").count().where("count > 1").select("t")
    words = read.where(F.col("kind").isNotNull()).select("id", "listed", "kind", "gen", F.posexplode("toks").alias("i", "t"))
    words = words.where(~_in(F.col("t"), all_kinds) & ~(_in(F.col("t"), LINKS) & (F.col("i") > 0)))
    persons_of = (
        words.join(topics, "t", "left_anti").groupBy("id", "listed", "kind", "gen")
        .agg(F.sort_array(F.collect_list(F.struct("i", "t"))).alias("toks"))
        .withColumn("toks", F.transform("toks", lambda x: x["t"]))
    )
    return read.where(F.col("kind").isNull()).unionByName(persons_of)


def _parts(orgless: DataFrame, nicknames: DataFrame) -> DataFrame:
    """Surname, given and middle name of each name, once for each of its ``readings``."""
    # given names: the list's, and first tokens that occur before many last tokens
    nick = nicknames.select(fold("nickname").alias("nick"), fold("given_name").alias("given")).where("nick is not null and given is not null")
    before = durable(
        orgless.where(F.size("toks") >= 2)
        .select(F.get("toks", F.lit(0)).alias("g"), F.get("toks", F.size("toks") - 1).alias("s"))
        .where(F.length("g") >= 3).distinct(),
        "before",
    )
    firsts = before.groupBy("g").agg(F.approx_count_distinct("s").alias("n"))
    many = F.greatest(F.lit(6), F.lit(0.0008) * orgless.count())
    formal = nick.select(F.col("given").alias("g")).distinct()
    learned = durable(
        firsts.where((F.col("n") >= many) & (F.length("g") <= 12)).select("g").join(formal, "g", "left_anti"), "learned"
    )
    known = durable(learned.unionByName(formal), "given")
    if known.count() > BROADCAST_NAMES:
        raise ValueError(f"more than {BROADCAST_NAMES} given names")
    short = _short_forms(before, learned, known).unionByName(nick.select(F.col("nick").alias("g"))).distinct()
    own = formal.unionByName(learned.join(short, "g", "left_anti")).withColumn("own", F.lit(True))
    spelled = known.join(own, "g", "left").select(
        F.col("g").alias("t"), F.coalesce("own", F.lit(False)).alias("is_known"), F.col("g").alias("as_given")
    ).unionByName(
        nick.select(F.col("nick").alias("t"), F.lit(False).alias("is_known"), F.col("given").alias("as_given"))
    ).groupBy("t").agg(F.max("is_known").alias("is_known"), F.collect_set("as_given").alias("as_given"))
    spelled = durable(spelled, "spelled")
    toks = orgless.select("id", "listed", "kind", "gen", F.posexplode("toks").alias("i", "t"))
    # the given-name table follows the relative threshold above (at most 1/0.0008 names) and the list
    small = spelled.count() <= BROADCAST_NAMES
    toks = toks.join(F.broadcast(spelled), "t", "left") if small else hot_cold_join(toks, spelled, ["t"], None, "left")
    ordered = toks.groupBy("id", "listed", "kind", "gen").agg(
        F.sort_array(F.collect_list(F.struct("i", "t", F.coalesce("is_known", F.lit(False)).alias("known"), "as_given"))).alias("a")
    )
    is_given = lambda x: (F.length(x["t"]) <= 2) | x["as_given"].isNotNull()
    longest = F.array_max(
        F.transform(
            "a", lambda x: F.struct((~is_given(x)).alias("other"), F.length(x["t"]).alias("n"), x["i"].alias("i"))
        )
    )
    # a last token of two letters with a vowel may be initials or a surname: both readings are kept
    end = F.get("a", F.size("a") - 1)
    short_surname = (F.length(end["t"]) == 2) & end["t"].rlike("[aeiouy]") & end["as_given"].isNull() & (end["i"] != longest["i"])
    return (
        ordered.where(F.size("a") >= 2)
        .withColumn("every", F.array_compact(F.array(longest["i"], F.when(short_surname, end["i"]))))
        .withColumn("at", F.explode("every"))
        .withColumn("s", F.get(F.filter("a", lambda x: x["i"] == F.col("at")), F.lit(0))["t"])
        .withColumn("g", F.filter("a", lambda x: x["i"] != F.col("at")))
        .select(
            "id", "listed", "kind", "gen", F.size("every").alias("readings"), "s",
            F.get("g", F.lit(0)).alias("g"), F.get("g", F.lit(1)).alias("m"),
        )
        .where(F.length("s") >= 2)
    )


def _initials(g: Column) -> Column:
    """First letters a given name can be abbreviated to: its own and those of its formal names."""
    own = F.array(F.substring(g["t"], 1, 1))
    return F.array_distinct(F.concat(own, F.transform(F.coalesce(g["as_given"], F.array()), lambda x: F.substring(x, 1, 1))))


def _keys(parts: DataFrame) -> DataFrame:
    """(name, key, listed, s, g, m, gen, known_surname): each reading under the refined suffixes of all its name's readings.

    Names of different kinds have no key in common. A name that is given as itself only has no ``as_given`` here.
    """
    s, back = F.col("s"), F.reverse("s")
    formal = F.array_distinct(F.concat(F.array(F.col("g.t")), F.coalesce(F.col("g.as_given"), F.array())))
    long_given = F.filter(formal, lambda x: F.length(x) >= 4)
    tail = lambda x, n: F.substring(x, -n, n)
    kind = F.coalesce(F.concat(F.lit("|"), "kind"), F.lit(""))

    by_initial = F.transform(_initials(F.col("g")), lambda i: F.concat(F.lit("s"), tail(s, 5), i, kind))
    by_initial_back = F.transform(_initials(F.col("g")), lambda i: F.concat(F.lit("r"), tail(back, 5), i, kind))
    by_given = F.transform(long_given, lambda g: F.concat(F.lit("g"), tail(g, 4), F.substring(s, 1, 3), kind))
    by_given_back = F.transform(long_given, lambda g: F.concat(F.lit("h"), tail(g, 4), tail(s, 3), kind))
    as_given = lambda x: F.when(~x["known"] | (F.size(x["as_given"]) > 1), x["as_given"])
    short = lambda x: F.when(x.isNotNull(), F.struct(x["t"].alias("t"), x["known"].alias("known"), as_given(x).alias("as_given")))
    keyed = parts.select(
        F.col("id").alias("name"), "readings", "listed", "s", short(F.col("g")).alias("g"), short(F.col("m")).alias("m"), "gen", "known_surname",
        F.concat(by_initial, by_initial_back, by_given, by_given_back).alias("keys"),
    )
    twice = keyed.where("readings > 1")
    both = twice.groupBy("name").agg(F.flatten(F.collect_list("keys")).alias("keys"))
    keyed = keyed.where("readings = 1").unionByName(twice.drop("keys").join(both, "name"))
    return keyed.select("name", F.explode(F.array_distinct("keys")).alias("key"), "listed", "s", "g", "m", "gen", "known_surname")


def _candidates(keys: DataFrame, listed: str | DataFrame, block: int = NAMES_PER_BLOCK) -> DataFrame:
    """(a, b): every listed name with every other name, once for each key they share; further columns of ``keys`` as ``_a`` and ``_b``.

    ``listed`` is a column of ``keys`` or a table of names. A key is paired in blocks of ``block`` names a side, or of as many
    that a block has a ``1 / HOT_KEYS`` part of the pairs of all common keys: at most ``HOT_KEYS`` keys are cut (a proven bound
    on the broadcast), and the copies of their names for the blocks grow as the square root of the pairs.
    """
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    common = durable(sizes, "common")
    pairs = common.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0
    size = max(block, (pairs / HOT_KEYS) ** 0.5)
    cut = F.broadcast(common.where(F.col("n") > size).select("key", F.ceil(F.col("n") / size).cast("int").alias("blocks")))
    at, every = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    marked = keys.join(cut, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = marked.where(listed) if isinstance(listed, str) else marked.join(listed, "name", "left_semi")
    with_ = [c for c in keys.columns if c not in ("name", "key", listed if isinstance(listed, str) else None)]
    side = lambda n: [F.col("name").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in with_)]
    left = own.select("key", at.alias("i"), F.explode(every).alias("j"), *side("a"))
    right = marked.select("key", F.explode(every).alias("i"), at.alias("j"), *side("b"))
    return left.join(right, ["key", "i", "j"]).where("a <> b").drop("key", "i", "j")


def _agree(a: str, b: str, ratio: str) -> Column:
    """Whether two given names can be one: ``a``/``b`` struct columns, ``ratio`` their LCS ratio column."""
    x, y = F.col(a), F.col(b)
    tx, ty = x["t"], y["t"]
    short_ = F.when(F.length(tx) <= F.length(ty), tx).otherwise(ty)
    known_short = F.when(F.length(tx) <= F.length(ty), x["known"]).otherwise(y["known"])
    n_short, n_long = F.least(F.length(tx), F.length(ty)), F.greatest(F.length(tx), F.length(ty))
    same_first = F.substring(tx, 1, 1) == F.substring(ty, 1, 1)
    names_x = F.concat(F.array(tx), F.coalesce(x["as_given"], F.array()))
    names_y = F.concat(F.array(ty), F.coalesce(y["as_given"], F.array()))
    initial = (n_short == 1) & F.arrays_overlap(_initials(x), _initials(y))
    whole = F.round(F.col(ratio) * (n_short + n_long) / 2) == n_short  # the shorter is a subsequence of the longer
    contraction = (n_short <= 5) & (n_short >= 2) & (n_long > n_short) & whole & same_first & ~known_short
    pet = short_.rlike("(ie|y)$") & (F.substring(tx, 1, 3) == F.substring(ty, 1, 3)) & ~known_short
    typo = (n_short >= 3) & (F.col(ratio) >= GIVEN_RATIO) & (F.abs(F.length(tx) - F.length(ty)) <= 2)
    both_known = x["known"] & y["known"]
    return F.coalesce(
        F.arrays_overlap(names_x, names_y) | initial | (~both_known & (contraction | pet | typo)), F.lit(False)
    )


def _with_ratios(pairs: DataFrame, ratio: Callable[[str, str], Column]) -> DataFrame:
    named = {"s": "s_{0}", "g": "g_{0}.t", "m": "m_{0}.t"}
    return pairs.withColumns({f"{c}_ratio": ratio(x.format("a"), x.format("b")) for c, x in named.items()})


def _most_ratio(a: str, b: str) -> Column:
    """What ``lcs_ratio`` is at most: |a| + |b| - 2 LCS is at least the edit distance, and that the difference in length."""
    whole = F.length(a) + F.length(b)
    return 1 - F.levenshtein(a, b) / whole + 1e-9


def _means_same() -> Column:
    """Whether the readings of a pair mean the same, by its ratios; with bounds from above in their place it leaves out nothing."""
    ratio = F.col("s_ratio")
    two_known = F.col("known_surname_a") & F.col("known_surname_b")
    clear = (F.length("g_a.t") > 1) & (F.length("g_b.t") > 1) & (F.col("g_ratio") >= 0.99)
    surnames = (ratio >= LEAST_RATIO) & ((ratio >= ONE_TYPO) | ~two_known) & ((ratio >= SURNAME_RATIO) | clear)
    middle = F.col("m_a").isNull() | F.col("m_b").isNull() | _agree("m_a", "m_b", "m_ratio")
    generation = F.coalesce(F.col("gen_a") == F.col("gen_b"), F.lit(True))
    return generation & surnames & _agree("g_a", "g_b", "g_ratio") & middle


def _may_meet() -> Column:
    """Left out before any distance: two given names that are given as themselves only, and surnames of too different lengths."""
    itself = lambda x: F.col(f"{x}.known") & F.col(f"{x}.as_given").isNull() & (F.length(f"{x}.t") > 1)
    longer = F.abs(F.length("s_a") - F.length("s_b"))
    near = longer <= (1 - LEAST_RATIO) * (F.length("s_a") + F.length("s_b")) + 0.001
    return ((F.col("g_a.t") == F.col("g_b.t")) | ~(itself("g_a") & itself("g_b"))) & near


def same_names(names: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(a, b): ids of a distinct name that is listed and of another distinct name that mean the same.

    ``names`` has the distinct strings ``name``, their numbers ``id`` and whether they are ``listed``. Each stage
    deletes the tables of the one before, so that the disk holds one of them at a time.
    """
    spark = names.sparkSession
    with stages(spark) as scope:
        orgless = durable(_orgless(durable(read_names(names), "read")), "orgless")
        scope.keep(orgless)
    with stages(spark) as scope:
        parts = durable(_parts(orgless, nicknames), "parts")
        surnames = parts.groupBy("s").agg(F.count_distinct(F.substring("g.t", 1, 1)).alias("persons"), F.count(F.lit(1)).alias("n"))
        known = hot_cold_join(parts, durable(surnames, "surnames"), ["s"], "n", "inner")
        parts = durable(known.withColumn("known_surname", F.col("persons") >= KNOWN_SURNAME_INITIALS).drop("persons"), "parts2")
        scope.keep(parts)
    with stages(spark) as scope:
        met = _candidates(_keys(parts), "listed").where(_may_meet())
        for ratio in (_most_ratio, lcs_ratio):
            met = _with_ratios(met, ratio).where(_means_same()).drop("s_ratio", "g_ratio", "m_ratio")
        pairs = durable(met.select("a", "b").distinct(), "candidates")
        scope.keep(pairs)
    side = lambda n: parts.select(*[F.col(c).alias(n if c == "id" else f"{c}_{n}") for c in parts.columns])
    full = hot_cold_join(hot_cold_join(pairs, side("a"), ["a"], None, "inner"), side("b"), ["b"], pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "inner")
    linked = _with_ratios(full, lcs_ratio).where(_means_same())
    # an initial that fits two different listed given names of the surname tells neither
    formal = lambda c: F.when(F.col(f"{c}.known"), F.col(f"{c}.t"))
    linked = durable(linked.select("a", "b", "listed_b", "g_a", "g_b"), "linked")
    opening = F.when((F.length("g_a.t") > 1) & ~F.col("g_a.known"), F.substring("g_a.t", 1, 2))
    unclear = (
        linked.where(F.length("g_b.t") == 1).groupBy("b")
        .agg(
            F.min(formal("g_a")).alias("lo"), F.max(formal("g_a")).alias("hi"),
            F.min(opening).alias("lo2"), F.max(opening).alias("hi2"),
        )
        .where("lo <> hi or (lo is null and lo2 <> hi2)").select("b")
    )
    direct = durable(linked.join(unclear, "b", "left_anti").select("a", "b", "listed_b", (F.length("g_a.t") > 1).alias("hub")), "direct")
    # two spellings that both mean a listed name in full mean each other
    hub = durable(direct.where("hub").select(F.col("a").alias("h"), "b", "listed_b").distinct(), "hub")
    other = hub.where("listed_b").select("h", F.col("b").alias("a"))
    met = hot_cold_join(hub.drop("listed_b"), other, ["h"], None, "inner").select("a", "b").where("a <> b")
    return direct.select("a", "b").unionByName(met).distinct()


def link(books: DataFrame, authors: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(id, name) x (id, name) -> (pair_kind, key_a, key_b): rows whose different names mean one author."""
    books = books.select(F.col("id").alias("id"), "name").where("name is not null and id is not null")
    authors = authors.select(F.col("id").alias("id"), "name").where("name is not null and id is not null")
    rows = books.select("name", F.lit(1).alias("nb"), F.lit(0).alias("na")).unionByName(
        authors.select("name", F.lit(0).alias("nb"), F.lit(1).alias("na"))
    )
    with shuffles_removed(books.sparkSession):
        counts = rows.groupBy("name").agg(F.sum("nb").alias("nb"), F.sum("na").alias("na"))
        counts = durable(counts.withColumn("id", F.monotonically_increasing_id()), "names")
        with stages(counts.sparkSession) as scope:
            pairs = durable(same_names(counts.select("id", "name", (F.col("na") > 0).alias("listed")), nicknames), "pairs")
            scope.keep(pairs)
        # names on many author rows are cut into blocks of rows, so that no name gathers its ids in one place
        blocks = counts.where("na > 0").select("name", F.col("id").alias("a"), F.ceil(F.col("na") / ROWS_PER_BLOCK).cast("int").alias("blocks"))
        cut = pairs.join(blocks.drop("name"), "a").select("a", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        meant = durable(
            cut.groupBy("b").agg(F.collect_list(F.struct("a", "block")).alias("meant")).withColumnRenamed("b", "id")
            .join(counts.select("id", F.col("name").alias("b"), (F.col("nb") + F.col("na")).alias("rows")), "id").drop("id"),
            "meant",
        )
    author_rows = authors.select("name", F.col("id").alias("key_b")).join(blocks, "name").select(
        "a", "key_b", F.pmod(F.xxhash64("key_b"), F.col("blocks")).cast("int").alias("block")
    )

    def attach(rows: DataFrame) -> DataFrame:
        """Rows (b, key_a) with the author rows their name means."""
        met = hot_cold_join(rows, meant, ["b"], "rows", "inner").select("key_a", F.explode("meant").alias("m"))
        return met.select("key_a", "m.a", "m.block").join(author_rows, ["a", "block"]).select("key_a", "key_b")

    found = attach(books.select(F.col("name").alias("b"), F.col("id").alias("key_a"))).select(
        F.lit("book_author").alias("pair_kind"), "key_a", "key_b"
    )
    twice = (
        attach(authors.select(F.col("name").alias("b"), F.col("id").alias("key_a"))).where("key_a <> key_b")
        .select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()
        .select(F.lit("author_author").alias("pair_kind"), "key_a", "key_b")
    )
    return found.unionByName(twice)
