"""Fuzzy matching functions as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomql.functions import fuzzy as fz
from loomql.plans.registry import Registry, Tables

R = Registry()
c = F.col


@R.query("SELECT imdbid, levenshtein(director, writer) AS d, CASE WHEN levenshtein(director, writer) <= 12 THEN levenshtein(director, writer) ELSE 13 END AS bounded FROM imdb WHERE director IS NOT NULL AND writer IS NOT NULL AND regexp_matches(director || writer, '^[ -~]*$')")
def levenshtein_forms(t: Tables) -> DataFrame:
    m = t("imdb").where(c("director").isNotNull() & c("writer").isNotNull() & F.concat("director", "writer").rlike("^[ -~]*$"))
    return m.select("imdbid", F.levenshtein("director", "writer").cast("bigint").alias("d"), fz.levenshtein_less_equal(c("director"), c("writer"), 12).cast("bigint").alias("bounded"))


@R.query("SELECT p_partkey, levenshtein(p_name, p_type) AS d FROM part WHERE p_name <> p_type")
def levenshtein_weighted(t: Tables) -> DataFrame:
    d = fz.levenshtein_weighted(1, 1, 1)
    return t("part").where("p_name <> p_type").select("p_partkey", d("p_name", "p_type").cast("bigint").alias("d"))


@R.query("SELECT * FROM (VALUES ('Anne','A500',4),('Andrew','A536',2),('Margaret','M626',0),('123','',0),('Ashcraft','A226',1)) v(w, code, diff)")
def sound_codes(t: Tables) -> DataFrame:
    v = t.spark.sql("SELECT * FROM VALUES ('Anne'),('Andrew'),('Margaret'),('123'),('Ashcraft') v(w)")
    return v.select("w", fz.soundex(c("w")).alias("code"), fz.difference(c("w"), F.lit("Ann")).alias("diff"))


@R.query("SELECT * FROM (VALUES ('Thumb','0M'),('Phone','FN'),('Xylophone','SLFN'),('Which','HX'),('Edge','EJ'),('Laugh','LF'),('Christ','KRST'),('match','MTX'),('Schwarz','XWRS'),('signal','SKNL'),('GUMBO','KM'),('School','SKL'),('Bigger','BKR'),('Knight','NFT')) v(w, code)")
def metaphone_codes(t: Tables) -> DataFrame:
    v = t.spark.sql("SELECT * FROM VALUES ('Thumb'),('Phone'),('Xylophone'),('Which'),('Edge'),('Laugh'),('Christ'),('match'),('Schwarz'),('signal'),('GUMBO'),('School'),('Bigger'),('Knight') v(w)")
    return v.select("w", fz.metaphone(6)("w").alias("code"))


@R.query("""SELECT * FROM (VALUES ('word','two words',0.8,0.571429),('word','words',0.8,0.571429),('abc','xyz',0,0)) v(a, b, word, strict)""")
def word_similarities(t: Tables) -> DataFrame:
    v = t.spark.sql("SELECT * FROM VALUES ('word','two words'),('word','words'),('abc','xyz') v(a, b)")
    return v.select("a", "b", F.round(fz.word_similarity(c("a"), c("b")), 6).alias("word"), F.round(fz.strict_word_similarity(c("a"), c("b")), 6).alias("strict"))


# The sound code of a word in SQL: letters to digits, neighbours with one code once, vowels and other silent letters out.
_SOUNDEX = """
WITH w AS (SELECT p_partkey, upper(regexp_replace(p_name, '^[^A-Za-z]+', '')) AS s FROM part WHERE p_name IS NOT NULL),
ch AS (SELECT p_partkey, i, s[i:i] AS x, s[i-1:i-1] AS y, s FROM (SELECT p_partkey, s, unnest(range(1, len(s) + 1)) AS i FROM w)),
cd AS (SELECT p_partkey, s, i, x, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202') AS d, translate(y, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202') AS e, y FROM ch)
SELECT p_partkey, rpad((min(s)[1:1] || coalesce(string_agg(d, '' ORDER BY i) FILTER (WHERE i > 1 AND regexp_matches(x, '[A-Z]') AND d <> '0' AND (d <> e OR NOT regexp_matches(y, '[A-Z]'))), ''))[1:4], 4, '0') AS code
FROM cd GROUP BY p_partkey
"""


@R.query(_SOUNDEX)
def sound_codes_table(t: Tables) -> DataFrame:
    return t("part").where("p_name is not null").select("p_partkey", fz.soundex(c("p_name")).alias("code"))


@R.query("SELECT a.make AS a, b.make AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS sim FROM (SELECT make, list_distinct(flatten(list_transform(regexp_extract_all(lower(make), '[a-z0-9]+'), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: ('  ' || w || ' ')[i:i+2])))) AS g FROM (SELECT DISTINCT make FROM car_brands1 WHERE make IS NOT NULL)) a JOIN (SELECT make, list_distinct(flatten(list_transform(regexp_extract_all(lower(make), '[a-z0-9]+'), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: ('  ' || w || ' ')[i:i+2])))) AS g FROM (SELECT DISTINCT make FROM car_brands1 WHERE make IS NOT NULL)) b ON a.make < b.make AND len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) >= 0.3")
def trigram_similarity_join(t: Tables) -> DataFrame:
    m = t("car_brands1").where("make is not null").select("make").distinct().select("make", fz.trigrams(c("make")).alias("g"))
    # a pair of at least 0.3 shares one of the rarest trigrams of either name: only these are joined, common ones never meet
    grams = m.select("make", F.size("g").alias("n"), F.explode("g").alias("x"))
    rarity = grams.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    ranked = grams.join(rarity, "x").groupBy("make", "n").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("a"))
    least = F.ceil(0.3 * F.col("n")).cast("int")
    rare = ranked.select("make", F.explode(F.slice("a", F.lit(1), F.col("n") - least + 1)).alias("r")).select("make", F.col("r.x").alias("x"))
    pairs = rare.join(rare.withColumnRenamed("make", "b"), "x").where("make < b").select("make", "b").distinct()
    full = pairs.join(m, "make").join(m.select(c("make").alias("b"), c("g").alias("h")), "b")
    return full.select(c("make").alias("a"), "b", F.round(fz.set_similarity(c("g"), c("h")), 6).alias("sim"), fz.set_similarity(c("g"), c("h")).alias("s")).where("s >= 0.3").drop("s")


@R.query("SELECT id, strip_accents(full_name) AS plain FROM gr_authors WHERE full_name IS NOT NULL")
def unaccented_names(t: Tables) -> DataFrame:
    return t("gr_authors").where("full_name is not null").select("id", fz.unaccent(c("full_name")).alias("plain"))
