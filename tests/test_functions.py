"""Scalar functions on literals worked out by hand."""

from pyspark.sql import functions as F

from loomql.functions import dates, documents, fuzzy, numeric, strings


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_strings(spark):
    x = F.lit("abcde")
    assert one(spark, strings.left(x, -2), strings.right(x, -2), strings.left(x, -9), strings.right(x, 0)) == ("abc", "cde", "", "")
    assert one(spark, strings.concat(F.lit("a"), F.lit(None), F.lit("b")), strings.bpchar(F.lit("ab"), 4)) == ("ab", "ab  ")
    assert one(spark, strings.regexp_replace(F.lit("foobarbaz"), "b..", "X"), strings.regexp_replace(F.lit("foobarbaz"), "b(..)", "X$1Y", "g")) == ("fooXbaz", "fooXarYXazY")
    assert one(spark, strings.format_sql("INSERT INTO %I VALUES(%L, %s) %%", F.lit("My t"), F.lit("O'R"), F.lit(3))) == ("INSERT INTO \"My t\" VALUES('O''R', 3) %",)
    assert one(spark, strings.parse_ident(F.lit('"Some".Thing'))) == (["Some", "thing"],)
    assert one(spark, strings.encode(F.lit(bytes([0x31, 0x00, 0x5C, 0x32])), "escape")) == ("1\\000\\\\2",)
    assert one(spark, strings.bits_shift(F.lit("1011"), -2), strings.set_bit(F.lit("0000"), 1, 1)) == ("0010", "0100")
    assert one(spark, strings.similar_to(F.lit("abc"), "%(b|d)%"), strings.similar_to(F.lit("abc"), "(b|c)%")) == (True, False)


def test_numeric(spark):
    assert one(spark, numeric.to_int(F.lit(2.5)), numeric.to_int(F.lit(3.5)), numeric.to_int(F.lit(-2.5))) == (2, 4, -2)
    assert one(spark, numeric.int_div(F.lit(-7), F.lit(2)), numeric.power(F.lit(1.0), F.lit(float("nan")))) == (-3, 1.0)
    assert one(spark, numeric.sind(F.lit(30.0)), numeric.cosd(F.lit(240.0)), numeric.tand(F.lit(45.0))) == (0.5, -0.5, 1.0)


def test_dates(spark):
    ts = F.lit("2000-12-31 23:59:59.5").cast("timestamp_ntz")
    assert one(spark, *[dates.extract(f, ts) for f in ("century", "millennium", "decade", "dow", "isodow", "isoyear")]) == (20, 2, 200, 0, 7, 2000)
    assert str(one(spark, dates.date_trunc("century", ts))[0])[:10] == "1901-01-01"
    assert one(spark, dates.to_char(ts, "DD Mon YYYY HH12:MI AM")) == ("31 Dec 2000 11:59 PM",)


def test_fuzzy(spark):
    assert one(spark, F.levenshtein(F.lit("GUMBO"), F.lit("GAMBOL")), fuzzy.levenshtein_less_equal(F.lit("extensive"), F.lit("exhaustive"), 2)) == (2, 3)
    assert one(spark, fuzzy.similarity(F.lit("word"), F.lit("word")), fuzzy.similarity(F.lit("!"), F.lit("")))[0] == 1.0
    assert one(spark, fuzzy.trigrams(F.lit("cat"))) == (["  c", " ca", "at ", "cat"],)
    w = fuzzy.levenshtein_weighted(2, 1, 1)
    df = spark.createDataFrame([("GUMBO", "GAMBOL"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(w("a", "b")).collect()] == [3, None]


def test_documents(spark):
    v = documents.to_tsvector(F.lit("The quick brown foxes jumped"))
    assert one(spark, documents.ts_match(v, "fox & jump"), documents.ts_match(v, "quick <-> brown"), documents.ts_match(v, "brown <-> quick | !cat")) == (True, True, True)
    assert one(spark, documents.lquery(F.lit("Top.Science.Astronomy"), "Top.*{1}.Astro*"), documents.lquery(F.lit("Top.A"), "Top.!A")) == (True, False)
    assert one(spark, documents.ts_headline(F.lit("a Cat sat"), "cat")) == ("a <b>Cat</b> sat",)
    df = spark.createDataFrame([('{"a":{"b":[1,2]}}', '{"a":{"b":[2]}}'), ('{"a":1}', '{"a":2}'), (None, "{}")], "a string, b string")
    assert [r[0] for r in df.select(documents.json_contains("a", "b")).collect()] == [True, False, None]
