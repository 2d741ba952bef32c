"""Views, stored results, partitions, statistics, cursors, collations, intervals and further functions as queries."""

from __future__ import annotations

import os
import sqlite3
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomql.functions import numeric as nm
from loomql.operators import rewrites as rw
from loomql.operators.cursor import Cursor
from loomql.plans.explain import nodes, plan_text
from loomql.plans.registry import Registry, Tables
from loomql.session import durable, shared_dir
from loomql.sources import sinks, tables
from loomql.sources.foreign import foreign_table

R = Registry()
c = F.col


@R.query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def create_table_as(t: Tables) -> DataFrame:
    sinks.create_table_as(t("customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment"), "rich_customers")
    return t.spark.sql("SELECT c_mktsegment, count(*) AS n FROM rich_customers GROUP BY 1")


@R.query("SELECT 0::BIGINT AS n, 2::BIGINT AS columns")
def create_table_with_no_data(t: Tables) -> DataFrame:
    empty = sinks.create_table_as(t("customer").select("c_custkey", "c_mktsegment"), "no_customers", with_data=False)
    return t.spark.table("no_customers").agg(F.count(F.lit(1)).alias("n"), F.lit(len(empty.columns)).cast("bigint").alias("columns"))


@R.query("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n * 2 FROM r WHERE n < 500) SELECT n_nationkey, n FROM r JOIN nation ON n_nationkey = n")
def recursive_view(t: Tables) -> DataFrame:
    t("nation").createOrReplaceTempView("nation_of_view")
    t.spark.sql("CREATE OR REPLACE TEMPORARY VIEW doubling AS WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n * 2 FROM r WHERE n < 500) SELECT n FROM r")
    return t.spark.sql("SELECT n_nationkey, n FROM doubling JOIN nation_of_view ON n_nationkey = n")


@R.query("SELECT l_returnflag, true AS same FROM lineitem GROUP BY 1")
def cte_evaluated_once(t: Tables) -> DataFrame:
    """A common table with a volatile column is stored, so that both references see the same values."""
    once = durable(t("lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).withColumn("x", F.rand()), "cte")
    return once.alias("a").join(once.alias("b"), "l_returnflag").select("l_returnflag", (c("a.x") == c("b.x")).alias("same"))


@R.query("SELECT n_nationkey, s_suppkey, s_acctbal FROM nation LEFT JOIN LATERAL (SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000 ORDER BY s_acctbal DESC, s_suppkey LIMIT 1) ON true")
def left_lateral(t: Tables) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    best = t("supplier").where("s_acctbal > 5000").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return t("nation").join(best, c("n_nationkey") == c("s_nationkey"), "left").select("n_nationkey", "s_suppkey", "s_acctbal")


@R.query("SELECT r_regionkey, coalesce((SELECT array_to_string(list(n_name ORDER BY n_name), ',') FROM nation WHERE n_regionkey = r_regionkey), '') AS names FROM region")
def array_subquery(t: Tables) -> DataFrame:
    lists = t("nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("a"))
    return t("region").join(lists, c("r_regionkey") == c("n_regionkey"), "left").select("r_regionkey", F.coalesce(F.array_join("a", ","), F.lit("")).alias("names"))


@R.query("SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def bucketed_join(t: Tables) -> DataFrame:
    """Partition-wise join: both sides bucketed by the key, joined without a shuffle."""
    o = sinks.bucketed(t("orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"], 8, "o_buckets")
    li = sinks.bucketed(t("lineitem").select("l_orderkey", "l_quantity"), ["l_orderkey"], 8, "l_buckets")
    met = o.hint("merge").join(li, c("o_orderkey") == c("l_orderkey"))
    return met.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@R.query("SELECT CASE WHEN n_regionkey IN (0, 1) THEN 'west' WHEN n_regionkey = 2 THEN 'east' ELSE 'rest' END AS part, count(*) AS n FROM nation WHERE n_regionkey <> 1 GROUP BY 1")
def list_partitions(t: Tables) -> DataFrame:
    n = sinks.list_partitioned(t("nation"), "n_regionkey", {"west": [0, 1], "east": [2]}, "nations", "rest")
    return n.where("n_regionkey <> 1").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")
def hash_partition_scan(t: Tables) -> DataFrame:
    o = sinks.hash_partitioned(t("orders").select("o_orderkey", "o_custkey"), ["o_custkey"], 16, "hashed")
    part = F.pmod(F.xxhash64(F.lit(7).cast(dict(o.dtypes)["o_custkey"])), F.lit(16)).cast("int")
    return o.where((c("part") == part) & (c("o_custkey") == 7)).select("o_orderkey", "o_custkey")


@R.query("SELECT 10 + 5 * (row_number() OVER (ORDER BY p_partkey) - 1) AS id FROM part")
def identity_column(t: Tables) -> DataFrame:
    """Numbers without gaps; which row has which is not fixed by SQL either."""
    return sinks.with_identity(t("part").select("p_partkey"), "id", 10, 5).select("id")


@R.query("SELECT p_brand, p_type, max(p_brand || p_type) AS both FROM part GROUP BY p_brand, p_type")
def functional_dependency(t: Tables) -> DataFrame:
    """A column that the grouping key determines is taken from any row of the group."""
    return t("part").withColumn("both", F.concat("p_brand", "p_type")).groupBy("p_brand", "p_type").agg(F.any_value("both").alias("both"))


@R.query("SELECT count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types, count(DISTINCT p_brand || '|' || p_type) AS both FROM part")
def multi_column_distinct(t: Tables) -> DataFrame:
    """Statistics of columns together: distinct combinations beside those of each column."""
    return t("part").agg(F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_type").alias("types"), F.count_distinct("p_brand", "p_type").alias("both"))


@R.query("SELECT round(sum(CASE WHEN d = 1 THEN n ELSE 0 END) / sum(n), 6) AS degree FROM (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS d FROM orders GROUP BY 1)")
def dependency_degree(t: Tables) -> DataFrame:
    """Share of the rows whose first column determines the second."""
    g = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderstatus").alias("d"))
    return g.agg(F.round(F.sum(F.when(c("d") == 1, c("n")).otherwise(0)) / F.sum("n"), 6).alias("degree"))


@R.query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders QUALIFY pos BETWEEN 6 AND 10 OR pos BETWEEN 3 AND 4")
def cursor_fetch(t: Tables) -> DataFrame:
    o = t("orders").select("o_orderkey", "o_totalprice", (-c("o_totalprice")).alias("by"))
    cur = Cursor(o, ["by", "o_orderkey"])
    cur.move(5)
    forward = cur.fetch(5)
    cur.absolute(5)
    return forward.unionByName(cur.fetch(-2)).select("pos", "o_orderkey", "o_totalprice")


@R.query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def collated_comparison(t: Tables) -> DataFrame:
    return t("customer").where(F.collate("c_mktsegment", "UTF8_LCASE") == F.lit("bUILDING")).select("c_custkey")


@R.query("SELECT lower(p_type) AS kind, count(*) AS n FROM part GROUP BY 1")
def collated_grouping(t: Tables) -> DataFrame:
    mixed = t("part").select(F.when(c("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type")).alias("k"))
    g = mixed.groupBy(F.collate("k", "UTF8_LCASE").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.lower(c("k").cast("string")).alias("kind"), "n")


@R.query("SELECT o_orderkey, sum(o_totalprice) OVER w AS running, count(*) OVER w AS n, first_value(o_orderkey) OVER v AS first FROM orders WINDOW v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def named_windows(t: Tables) -> DataFrame:
    sql = """SELECT o_orderkey, sum(o_totalprice) OVER w AS running, count(*) OVER w AS n, first_value(o_orderkey) OVER v AS first FROM {o}
             WINDOW v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""
    return t.spark.sql(sql, o=t("orders"))


@F.pandas_udf(T.DoubleType())
def middle(v: pd.Series) -> float:
    return float(v.median())


@R.query("SELECT s_suppkey, median(s_acctbal) OVER (PARTITION BY s_nationkey) AS middle FROM supplier")
def user_window_function(t: Tables) -> DataFrame:
    return t("supplier").select("s_suppkey", middle("s_acctbal").over(Window.partitionBy("s_nationkey")).alias("middle"))


@R.query("SELECT l_returnflag, l_linenumber AS most FROM (SELECT l_returnflag, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_linenumber) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn = 1")
def mode_aggregate(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_returnflag").agg(F.mode("l_linenumber", deterministic=True).alias("most"))


_REGR = "regr_count regr_avgx regr_avgy regr_sxx regr_syy regr_sxy regr_slope regr_intercept regr_r2 covar_pop covar_samp corr".split()


@R.query("SELECT l_returnflag, " + ", ".join(f"round({f}(l_extendedprice, l_quantity), 4) AS {f}" for f in _REGR) + " FROM lineitem GROUP BY 1")
def regression_aggregates(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_returnflag").agg(*[F.round(getattr(F, f)("l_extendedprice", "l_quantity"), 4).alias(f) for f in _REGR])


@R.query("SELECT c_mktsegment, min(pos) AS lo, max(pos) AS hi FROM (SELECT c_mktsegment, CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 5000 THEN 1 ELSE 2 END AS pos FROM customer) GROUP BY 1")
def enum_min_max(t: Tables) -> DataFrame:
    """Least and greatest label in the declared order, given as its place."""
    labels = F.array(*map(F.lit, ("owing", "low", "high")))
    label = F.when(c("c_acctbal") < 0, "owing").when(c("c_acctbal") < 5000, "low").otherwise("high")
    place = F.array_position(labels, label) - 1
    g = t("customer").select("c_mktsegment", label.alias("label"), place.alias("pos")).groupBy("c_mktsegment")
    ends = g.agg(F.min_by("label", "pos").alias("lo"), F.max_by("label", "pos").alias("hi"))
    return ends.select("c_mktsegment", (F.array_position(labels, c("lo")) - 1).alias("lo"), (F.array_position(labels, c("hi")) - 1).alias("hi"))


@R.query("SELECT l_returnflag, true AS near FROM lineitem GROUP BY 1")
def approximate_distinct_error(t: Tables) -> DataFrame:
    """The sketch is within three of its standard errors of the exact count."""
    g = t("lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.count_distinct("l_partkey").alias("n"))
    return g.select("l_returnflag", (F.abs(c("a") / c("n") - 1) < 0.06).alias("near"))


@R.query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09)")
def not_in_without_null(t: Tables) -> DataFrame:
    sql = "SELECT s_suppkey FROM {s} WHERE s_suppkey NOT IN (SELECT l_suppkey FROM {l} WHERE l_quantity > 49 AND l_discount > 0.09)"
    return t.spark.sql(sql, s=t("supplier"), l=t("lineitem"))


@R.query("SELECT v, count(*) AS n FROM (SELECT CASE WHEN n_regionkey > 2 THEN n_regionkey END AS v FROM nation INTERSECT SELECT nullif(r_regionkey, 4) FROM region) GROUP BY v")
def nulls_equal_in_set_operations(t: Tables) -> DataFrame:
    a = t("nation").select(F.when(c("n_regionkey") > 2, c("n_regionkey")).alias("v"))
    return a.intersect(t("region").select(F.nullif("r_regionkey", F.lit(4)).alias("v"))).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT a, asind, acosd, atand, at2 FROM (VALUES (-1.0::DOUBLE, -90.0::DOUBLE, 180.0::DOUBLE, -45.0::DOUBLE, -135.0::DOUBLE), (-0.5, -30, 120, -26.565051177, -153.434948823), (0, 0, 90, 0, 180), (0.5, 30, 60, 26.565051177, 153.434948823), (1, 90, 0, 45, 135)) v(a, asind, acosd, atand, at2)")
def inverse_degree_functions(t: Tables) -> DataFrame:
    v = t.spark.sql("SELECT * FROM VALUES (-1D), (-0.5D), (0D), (0.5D), (1D) v(a)")
    return v.select("a", *[F.round(f, 9).alias(n) for n, f in (("asind", nm.asind(c("a"))), ("acosd", nm.acosd(c("a"))), ("atand", nm.atand(c("a"))), ("at2", nm.atan2d(c("a"), F.lit(-1.0))))])


@R.query("SELECT * FROM (VALUES (0.0::DOUBLE, 'Zero dollars and zero cents'), (1.01, 'One dollar and one cent'), (1000, 'One thousand dollars and zero cents'), (1234567.89, 'One million two hundred thirty four thousand five hundred sixty seven dollars and eighty nine cents'), (5000000000, 'Five billion dollars and zero cents')) v(m, words)")
def money_words_large(t: Tables) -> DataFrame:
    v = t.spark.sql("SELECT * FROM VALUES (0D), (1.01D), (1000D), (1234567.89D), (5000000000D) v(m)")
    return v.select("m", nm.cash_words(c("m")).alias("words"))


@R.query("SELECT true AS in_range, true AS centred, true AS repeated, true AS normal")
def random_numbers(t: Tables) -> DataFrame:
    r = t.spark.range(20000).select(F.rand(5).alias("u"), F.rand(5).alias("again"))
    n = nm.normal_rand(t.spark, 20000, 10.0, 2.0, 7).agg((F.abs(F.avg("value") - 10) < 0.1).alias("a"), (F.abs(F.stddev("value") - 2) < 0.1).alias("b"))
    one = r.agg(((F.min("u") >= 0) & (F.max("u") < 1)).alias("in_range"), (F.abs(F.avg("u") - 0.5) < 0.02).alias("centred"), F.bool_and(c("u") == c("again")).alias("repeated"))
    return one.crossJoin(n).select("in_range", "centred", "repeated", (c("a") & c("b")).alias("normal"))  # one row each


@R.query("SELECT true AS same_day, true AS same_instant, true AS has_user")
def current_values(t: Tables) -> DataFrame:
    return t.spark.range(1).select(
        (F.current_date() == F.to_date(F.current_timestamp())).alias("same_day"), (F.current_timestamp() == F.now()).alias("same_instant"), (F.length(F.current_user()) > 0).alias("has_user")
    )


@R.query("SELECT o_custkey, CAST(sum(epoch(TIMESTAMP '2000-01-01' - o_orderdate)) AS DOUBLE) AS total, round(CAST(avg(epoch(TIMESTAMP '2000-01-01' - o_orderdate)) AS DOUBLE), 3) AS mean, CAST(max(epoch(TIMESTAMP '2000-01-01' - o_orderdate)) * 2 AS DOUBLE) AS twice FROM orders GROUP BY 1")
def interval_arithmetic(t: Tables) -> DataFrame:
    """Intervals are summed, averaged and multiplied as intervals, then given in seconds."""
    age = F.lit("2000-01-01").cast("timestamp_ntz") - c("o_orderdate").cast("timestamp_ntz")
    seconds = lambda i: i.cast("interval second").cast("decimal(20,6)").cast("double")
    g = t("orders").select("o_custkey", age.alias("age")).groupBy("o_custkey").agg(F.sum("age").alias("s"), F.avg("age").alias("a"), F.max("age").alias("m"))
    return g.select("o_custkey", seconds(c("s")).alias("total"), F.round(seconds(c("a")), 3).alias("mean"), seconds(c("m") * 2).alias("twice"))


@R.query("SELECT o_orderkey, make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), 1, 2, 3.5) AS ts, o_orderdate + INTERVAL '1 month' + INTERVAL '2 days' + INTERVAL '3 hours' AS later FROM orders")
def make_timestamps(t: Tables) -> DataFrame:
    d = c("o_orderdate")
    ts = F.make_timestamp_ntz(F.year(d), F.month(d), F.day(d), F.lit(1), F.lit(2), F.lit(3.5))
    later = d.cast("timestamp_ntz") + F.expr("INTERVAL '1' MONTH") + F.expr("make_interval(0, 0, 0, 2, 3)")
    return t("orders").select("o_orderkey", ts.alias("ts"), later.alias("later"))


@R.query("SELECT * FROM (VALUES ('1,234.50', 1234.5::DOUBLE, '1,234.50'), ('-7.00', -7.0, '-7.00'), ('0.25', 0.25, '0.25')) v(s, n, back)")
def number_formats(t: Tables) -> DataFrame:
    v = t.spark.sql("SELECT * FROM VALUES ('1,234.50'), ('-7.00'), ('0.25') v(s)")
    n = F.to_number("s", F.lit("S9,999.99"))
    return v.select("s", n.cast("double").alias("n"), F.trim(F.to_char(n, F.lit("MI9,990.99"))).alias("back"))


@R.query("SELECT o_orderkey, (string_split(o_orderpriority, '-'))[1:1] AS head, left(o_orderpriority, 2) || 'XY' || substr(o_orderpriority, 4) AS laid FROM orders")
def slices_and_overlay(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", F.slice(F.split("o_orderpriority", "-"), 1, 1).alias("head"), F.overlay("o_orderpriority", F.lit("XY"), 3, 1).alias("laid"))


@R.query("SELECT imdbid, unnest(regexp_split_to_array(director, '\\s+')) AS word FROM imdb WHERE director IS NOT NULL")
def regexp_split_to_table(t: Tables) -> DataFrame:
    return t("imdb").where("director is not null").select("imdbid", F.explode(F.split("director", "[ \\t\\n\\r\\f\\x0B]+")).alias("word"))


@R.query("SELECT n_nationkey, to_json({n_nationkey: n_nationkey, n_name: n_name}) AS j FROM nation")
def row_to_json(t: Tables) -> DataFrame:
    return t("nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("j"))


@R.query("SELECT '<row><r_regionkey>' || r_regionkey || '</r_regionkey><r_name>' || r_name || '</r_name></row>' AS xml FROM region")
def table_rows_to_xml(t: Tables) -> DataFrame:
    return sinks.rows_to_xml(t("region").select("r_regionkey", "r_name"))


@R.query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey >= 2 AND n_name <> 'CHINA'")
def foreign_scan(t: Tables) -> DataFrame:
    """A table of another server: one comparison is sent to it, the other stays here."""
    path = f"{shared_dir(t.spark).removeprefix('file://').removeprefix('file:')}/loomql-{uuid.uuid4().hex}.db"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER)")
        con.executemany("INSERT INTO nation VALUES (?, ?, ?)", [tuple(r) for r in t("nation").select("n_nationkey", "n_name", "n_regionkey").toLocalIterator()])
    far = foreign_table(t.spark, path, "SELECT * FROM nation ORDER BY n_nationkey", "n_nationkey int, n_name string, n_regionkey int")
    return far.where("n_regionkey >= 2 AND n_name <> 'CHINA'").select("n_nationkey", "n_name")


@R.query("SELECT r_regionkey, r_name FROM region")
def separated_lines_load(t: Tables) -> DataFrame:
    """Lines with a separator after each value, the last one too, loaded with a schema."""
    path = f"{shared_dir(t.spark)}/loomql-tbl-{uuid.uuid4().hex}"
    t("region").select(F.concat_ws("|", "r_regionkey", "r_name", F.lit(""))).write.text(path)
    return tables.tbl(t.spark, path, "r_regionkey int, r_name string, _end string").drop("_end")


@R.query("SELECT n_nationkey, n_name FROM nation")
def json_lines_load(t: Tables) -> DataFrame:
    path = f"{shared_dir(t.spark)}/loomql-json-{uuid.uuid4().hex}"
    t("nation").select("n_nationkey", "n_name").write.json(path)
    return tables.json_lines(t.spark, path, "n_nationkey int, n_name string")


@R.query("SELECT true AS filter_pushed, true AS columns_pruned, true AS broadcast, true AS top_n")
def explain_plans(t: Tables) -> DataFrame:
    """What the plans say: the filter and the columns reach the scan, a small side is broadcast, a limit sorts only its rows."""
    scan = t("lineitem").where("l_quantity > 49").select("l_orderkey")
    text = plan_text(scan)
    small = nodes(t("lineitem").join(t("nation"), c("l_suppkey") == c("n_nationkey")))
    top = nodes(t("orders").orderBy("o_totalprice").limit(5))
    facts = ("GreaterThan(l_quantity,49" in text, "struct<l_orderkey:bigint,l_quantity:double>" in text.replace(" ", ""), "BroadcastHashJoin" in small, "TakeOrderedAndProject" in top)
    return t.spark.createDataFrame([facts], "filter_pushed boolean, columns_pruned boolean, broadcast boolean, top_n boolean")


@R.query("SELECT k, CAST(sum(v) AS BIGINT) AS s FROM (SELECT l_suppkey AS k, l_linenumber AS v FROM lineitem) GROUP BY k ORDER BY k")
def merge_append(t: Tables) -> DataFrame:
    """Sorted parts merged in order: a range exchange of their union keeps one global order."""
    li = t("lineitem").select(c("l_suppkey").alias("k"), c("l_linenumber").alias("v"))
    a, b = li.where("k % 2 = 0").groupBy("k").agg(F.sum("v").alias("s")), li.where("k % 2 = 1").groupBy("k").agg(F.sum("v").alias("s"))
    return a.unionByName(b).orderBy("k")


@R.query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, coalesce(back, -1) AS back FROM (SELECT a.*, b.l_extendedprice AS back FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn FROM lineitem) a LEFT JOIN (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn FROM lineitem) b ON a.l_suppkey = b.l_suppkey AND b.rn = a.rn - 2)")
def lag_with_default(t: Tables) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    df = t("lineitem").select("l_suppkey", *order).withColumn("two", F.lit(2))
    return rw.lag_by(df, ["l_suppkey"], order, "l_extendedprice", "two", "back", -1.0).select("l_suppkey", *order, "back")
