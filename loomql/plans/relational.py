"""Scans, projections, predicates, sort, limit, distinct and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomql.functions.nulls import asc, desc, num_nonnulls, num_nulls
from loomql.operators import rewrites as rw
from loomql.plans.registry import Registry, Tables

R = Registry()


@R.query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount BETWEEN 0.05 AND 0.07 AND l_returnflag IN ('A','R')")
def scan_filter_project(t: Tables) -> DataFrame:
    df = t("lineitem").where((F.col("l_quantity") > 45) & F.col("l_discount").between(0.05, 0.07) & F.col("l_returnflag").isin("A", "R"))
    return df.select("l_orderkey", "l_linenumber", "l_quantity")


@R.query("SELECT o_orderkey FROM orders WHERE (o_totalprice > 300000 AND o_orderstatus = 'F') OR (o_totalprice < 2000)")
def bitmap_and_or(t: Tables) -> DataFrame:
    c = F.col
    return t("orders").where(((c("o_totalprice") > 300000) & (c("o_orderstatus") == "F")) | (c("o_totalprice") < 2000)).select("o_orderkey")


@R.query("SELECT * FROM (VALUES (1,'a'),(2,'b'),(3,NULL)) v(n, s)")
def values_scan(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT * FROM VALUES (1,'a'),(2,'b'),(3,NULL) v(n, s)")


@R.query("SELECT CAST(1 + 1 AS INTEGER) AS two, 'x' || 'y' AS xy")
def result_scan(t: Tables) -> DataFrame:
    return t.spark.range(1).select((F.lit(1) + F.lit(1)).alias("two"), F.concat(F.lit("x"), F.lit("y")).alias("xy"))


@R.query("WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000) SELECT a.o_custkey, count(*) AS n FROM big a JOIN big b ON a.o_custkey = b.o_custkey GROUP BY 1")
def cte_scan_shared(t: Tables) -> DataFrame:
    big = t("orders").where("o_totalprice > 200000").select("o_custkey", "o_totalprice")
    return big.alias("a").join(big.alias("b"), "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT c_custkey, CAST(num_nulls AS INTEGER) AS num_nulls, CAST(2 - num_nulls AS INTEGER) AS num_nonnulls FROM (SELECT c_custkey, (CASE WHEN NULLIF(c_mktsegment,'BUILDING') IS NULL THEN 1 ELSE 0 END) + (CASE WHEN c_name IS NULL THEN 1 ELSE 0 END) AS num_nulls FROM customer)")
def null_counting(t: Tables) -> DataFrame:
    seg = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return t("customer").select("c_custkey", num_nulls(seg, "c_name").alias("num_nulls"), num_nonnulls(seg, "c_name").alias("num_nonnulls"))


@R.query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus,'P'),'?') AS status, greatest(o_orderkey, o_custkey) AS g, least(o_orderkey, o_custkey) AS l FROM orders")
def conditional_expressions(t: Tables) -> DataFrame:
    p = F.col("o_totalprice")
    band = F.when(p > 200000, "high").when(p > 100000, "mid").otherwise("low")
    status = F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("?"))
    return t("orders").select("o_orderkey", band.alias("band"), status.alias("status"), F.greatest("o_orderkey", "o_custkey").alias("g"), F.least("o_orderkey", "o_custkey").alias("l"))


@R.query("SELECT n, n IS TRUE AS t, n IS NOT TRUE AS nt, n IS NULL AS u, n IS DISTINCT FROM TRUE AS d FROM (VALUES (TRUE),(FALSE),(NULL)) v(n)")
def three_valued_logic(t: Tables) -> DataFrame:
    n = F.col("n")
    true = F.lit(True)
    return t.spark.sql("SELECT * FROM VALUES (TRUE),(FALSE),(NULL) v(n)").select(
        "n", n.eqNullSafe(true).alias("t"), (~n.eqNullSafe(true)).alias("nt"), n.isNull().alias("u"), (~n.eqNullSafe(true)).alias("d"))


@R.query("SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey > 1000 OR (o_custkey = 1000 AND o_orderkey > 5000)) AND (o_orderstatus, o_orderpriority) IN (('F','1-URGENT'),('O','5-LOW'))")
def row_comparison(t: Tables) -> DataFrame:
    o = t("orders")
    after = F.struct("o_custkey", "o_orderkey") > F.struct(F.lit(1000).cast("bigint"), F.lit(5000).cast("bigint"))
    pairs = F.struct("o_orderstatus", "o_orderpriority").isin(F.struct(F.lit("F"), F.lit("1-URGENT")), F.struct(F.lit("O"), F.lit("5-LOW")))
    return o.where(after & pairs).select("o_orderkey", "o_custkey")


@R.query("SELECT p_partkey FROM part WHERE p_size = ANY([1,5,9]) AND p_retailprice > ALL([900, 950.0])")
def any_all_array(t: Tables) -> DataFrame:
    sizes, prices = F.array(*map(F.lit, (1, 5, 9))), F.array(F.lit(900.0), F.lit(950.0))
    return t("part").where(F.array_contains(sizes, F.col("p_size")) & F.forall(prices, lambda x: F.col("p_retailprice") > x)).select("p_partkey")


@R.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 25 OFFSET 10")
def top_n_offset(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(desc("o_totalprice"), asc("o_orderkey")).offset(10).limit(25)


@R.query("SELECT f1, row_number() OVER (ORDER BY f1 ASC NULLS LAST, k) AS pos_asc, row_number() OVER (ORDER BY f1 DESC NULLS FIRST, k) AS pos_desc FROM (VALUES (42,1),(3,2),(10,3),(7,4),(NULL,5),(NULL,6),(1,7)) v(f1,k)")
def null_ordering(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    v = t.spark.sql("SELECT * FROM VALUES (42,1),(3,2),(10,3),(7,4),(NULL,5),(NULL,6),(1,7) v(f1,k)")
    pos = lambda o: F.row_number().over(Window.orderBy(o, "k")).cast("bigint")
    return v.select("f1", pos(asc("f1")).alias("pos_asc"), pos(desc("f1")).alias("pos_desc"))


@R.query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT (SELECT count(*) FROM nation)")
def limit_by_subquery(t: Tables) -> DataFrame:
    return rw.limit_by_query(t("orders").select("o_orderkey"), [asc("o_orderkey")], t("nation").agg(F.count(F.lit(1))))


@R.query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC NULLS FIRST, o_orderkey")
def distinct_on_latest(t: Tables) -> DataFrame:
    return rw.distinct_on(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [desc("o_totalprice"), asc("o_orderkey")])


@R.query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def select_distinct(t: Tables) -> DataFrame:
    return t("lineitem").select("l_returnflag", "l_linestatus").distinct()


@R.query("SELECT o_custkey AS k FROM orders WHERE o_totalprice > 250000 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def union_distinct(t: Tables) -> DataFrame:
    return t("orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("k")).union(t("customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@R.query("SELECT k, count(*) AS n FROM (SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT s_suppkey FROM supplier) GROUP BY k")
def append_union_all(t: Tables) -> DataFrame:
    u = t("lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("k")).unionAll(t("supplier").select("s_suppkey"))
    return u.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT s, x, q, count(*) AS n FROM (SELECT l_suppkey AS s, l_linenumber AS x, l_quantity AS q FROM lineitem WHERE l_linestatus = 'F' INTERSECT ALL SELECT l_suppkey, l_linenumber, l_quantity FROM lineitem WHERE l_linestatus <> 'F') GROUP BY s, x, q")
def intersect_all(t: Tables) -> DataFrame:
    """Both sides by content, so that they hold the whole table."""
    li = t("lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("x"), F.col("l_quantity").alias("q"), "l_linestatus")
    a, b = li.where("l_linestatus = 'F'").drop("l_linestatus"), li.where("l_linestatus <> 'F'").drop("l_linestatus")
    return a.intersectAll(b).groupBy("s", "x", "q").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT s, x, q, count(*) AS n FROM (SELECT l_suppkey AS s, l_linenumber AS x, l_quantity AS q FROM lineitem WHERE l_linestatus = 'F' EXCEPT ALL SELECT l_suppkey, l_linenumber, l_quantity FROM lineitem WHERE l_linestatus <> 'F') GROUP BY s, x, q")
def except_all(t: Tables) -> DataFrame:
    """Both sides by content, so that they hold the whole table."""
    li = t("lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("x"), F.col("l_quantity").alias("q"), "l_linestatus")
    a, b = li.where("l_linestatus = 'F'").drop("l_linestatus"), li.where("l_linestatus <> 'F'").drop("l_linestatus")
    return a.exceptAll(b).groupBy("s", "x", "q").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def intersect_distinct(t: Tables) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("k")).intersect(t("orders").where("o_orderstatus = 'F'").select("o_custkey"))


@R.query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def except_distinct(t: Tables) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("k")).subtract(t("orders").where("o_orderstatus = 'F'").select("o_custkey"))


@R.query("SELECT id, a, b FROM (VALUES (1,1,10),(1,2,20),(1,3,NULL),(2,5,50),(2,NULL,60)) v(id,a,b)")
def lockstep_functions(t: Tables) -> DataFrame:
    src = t.spark.sql("SELECT * FROM VALUES (1, array(1,2,3), array(10,20)), (2, array(5), array(50,60)), (3, array(), array()) v(id, x, y)")
    return rw.lockstep(src, {"a": F.col("x").cast("array<int>"), "b": F.col("y").cast("array<int>")}, ["id"])


@R.query("SELECT o_orderkey, u AS word, CAST(i AS BIGINT) AS ordinality FROM (SELECT o_orderkey, unnest(string_split(o_orderpriority,'-')) AS u, generate_subscripts(string_split(o_orderpriority,'-'),1) AS i FROM orders)")
def function_scan_ordinality(t: Tables) -> DataFrame:
    return rw.with_ordinality(t("orders"), F.split("o_orderpriority", "-"), "word", ["o_orderkey"])


@R.query("SELECT n, m FROM (SELECT unnest(generate_series(1,4)) AS n) CROSS JOIN (SELECT unnest(generate_series(1,3)) AS m) WHERE n % 2 = m % 2")
def generate_series_cross(t: Tables) -> DataFrame:
    n = t.spark.range(1, 5).select(F.col("id").alias("n"))
    m = t.spark.range(1, 4).select(F.col("id").alias("m"))
    return n.join(m, n.n % 2 == m.m % 2)


@R.query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 2")
def prepared_statement(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT r_regionkey, r_name FROM {r} WHERE r_regionkey = :k", args={"k": 2}, r=t("region"))


@R.query("SELECT n_name, n_regionkey FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
def inheritance_scan(t: Tables) -> DataFrame:
    parent = t("nation").select("n_name", "n_regionkey")
    return parent.unionByName(t("region").select(F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey")))


@R.query("SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1")
def partition_pruned_scan(t: Tables) -> DataFrame:
    from loomql.sources.sinks import range_partitioned

    o = range_partitioned(t("orders"), F.year("o_orderdate"), "y", "pruned")
    return o.where("y = 1997").groupBy(F.col("y").cast("bigint").alias("y")).agg(F.count(F.lit(1)).alias("n"))
