"""Joins, subqueries, recursion, table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomql.functions.nulls import asc, desc
from loomql.operators import progressive as pg
from loomql.operators import reshaping as rs
from loomql.operators import rewrites as rw
from loomql.operators import special_joins as sj
from loomql.plans.registry import Registry, Tables

R = Registry()


@R.query("SELECT o_orderkey, l_partkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 250000")
def equi_join_orders_lines(t: Tables) -> DataFrame:
    return t("orders").where("o_totalprice > 250000").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_partkey", "l_linenumber")


@R.query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey ORDER BY c_custkey, o_orderkey LIMIT 1000")
def equi_join_customer_orders_k(t: Tables) -> DataFrame:
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey").orderBy("c_custkey", "o_orderkey").limit(1000)


@R.query("SELECT p_partkey, s_suppkey, n_name, count(*) AS n FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE p_size = 15 GROUP BY 1,2,3")
def equi_join_part_supplier(t: Tables) -> DataFrame:
    c = F.col
    j = t("part").where("p_size = 15").join(t("lineitem"), c("p_partkey") == c("l_partkey")).join(t("supplier"), c("s_suppkey") == c("l_suppkey")).join(t("nation"), c("n_nationkey") == c("s_nationkey"))
    return j.groupBy("p_partkey", "s_suppkey", "n_name").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 280000")
def left_outer_join(t: Tables) -> DataFrame:
    c = F.col
    return t("customer").join(t("orders"), (c("c_custkey") == c("o_custkey")) & (c("o_totalprice") > 280000), "left").select("c_custkey", "o_orderkey")


@R.query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 280000 OR o_orderkey IS NULL")
def join_qual_vs_filter(t: Tables) -> DataFrame:
    j = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.where("o_totalprice > 280000 OR o_orderkey IS NULL").select("c_custkey", "o_orderkey")


@R.query("SELECT p_partkey, l_orderkey FROM (SELECT * FROM lineitem WHERE l_quantity = 50) RIGHT JOIN part ON l_partkey = p_partkey")
def right_outer_join(t: Tables) -> DataFrame:
    return t("lineitem").where("l_quantity = 50").join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "right").select("p_partkey", "l_orderkey")


@R.query("SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) FULL JOIN (SELECT * FROM customer WHERE c_acctbal < 1000) ON s_suppkey = c_custkey")
def full_outer_join(t: Tables) -> DataFrame:
    s, c = t("supplier").where("s_acctbal > 5000"), t("customer").where("c_acctbal < 1000")
    return s.join(c, s.s_suppkey == c.c_custkey, "full").select("s_suppkey", "c_custkey")


@R.query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join_exists(t: Tables) -> DataFrame:
    return t("customer").join(t("orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@R.query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def anti_join_not_exists(t: Tables) -> DataFrame:
    return t("customer").join(t("orders").where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@R.query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT nullif(l_suppkey, 7) FROM lineitem WHERE l_quantity > 49)")
def not_in_with_null(t: Tables) -> DataFrame:
    sql = "SELECT s_suppkey FROM {s} WHERE s_suppkey NOT IN (SELECT nullif(l_suppkey, 7) FROM {l} WHERE l_quantity > 49)"
    return t.spark.sql(sql, s=t("supplier"), l=t("lineitem"))


@R.query("SELECT n_nationkey, s_suppkey FROM nation CROSS JOIN supplier WHERE n_nationkey < s_nationkey AND s_acctbal > 9000")
def theta_join(t: Tables) -> DataFrame:
    s = t("supplier").where("s_acctbal > 9000")
    return F.broadcast(t("nation")).join(s, F.col("n_nationkey") < F.col("s_nationkey")).select("n_nationkey", "s_suppkey")


@R.query("SELECT n_nationkey AS k, n_name, s_name FROM nation JOIN (SELECT s_nationkey AS n_nationkey, s_name FROM supplier) USING (n_nationkey)")
def using_join(t: Tables) -> DataFrame:
    s = t("supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_name")
    return t("nation").join(s, "n_nationkey").select(F.col("n_nationkey").alias("k"), "n_name", "s_name")


@R.query("SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.8 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def correlated_scalar_subquery(t: Tables) -> DataFrame:
    avg = t("orders").groupBy("o_custkey").agg((1.8 * F.avg("o_totalprice")).alias("bar"))
    return t("orders").join(avg, "o_custkey").where("o_totalprice > bar").select("o_orderkey", "o_totalprice")


@R.query("SELECT p_partkey FROM part WHERE p_retailprice > ALL (SELECT 10 * s_suppkey FROM supplier) AND p_size = ANY (SELECT n_nationkey FROM nation)")
def quantified_subqueries(t: Tables) -> DataFrame:
    top = t("supplier").agg(F.max(10 * F.col("s_suppkey")).alias("m"))
    p = t("part").join(F.broadcast(top), F.col("p_retailprice") > F.col("m"))
    return p.join(t("nation"), F.col("p_size") == F.col("n_nationkey"), "left_semi").select("p_partkey")


@R.query("SELECT c_custkey, x.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 2) x")
def lateral_top_two(t: Tables) -> DataFrame:
    top = rw.top_per_key(t("orders"), ["o_custkey"], [desc("o_totalprice"), asc("o_orderkey")], 2)
    return t("customer").join(top, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@R.query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT p_partkey, p_partkey % 100 FROM part)")
def row_in_subquery(t: Tables) -> DataFrame:
    p = t("part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") % 100).alias("b"))
    return t("lineitem").join(p, (F.col("l_partkey") == F.col("a")) & (F.col("l_suppkey") == F.col("b")), "left_semi").select("l_orderkey", "l_linenumber")


@R.query("WITH RECURSIVE r(n, s) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, s + (n + 1) * (n + 1) FROM r WHERE n < 20) SELECT n, s FROM r")
def recursive_union_all(t: Tables) -> DataFrame:
    return t.spark.sql("WITH RECURSIVE r(n, s) AS (SELECT 1L, 1L UNION ALL SELECT n + 1, s + (n + 1) * (n + 1) FROM r WHERE n < 20) SELECT n, s FROM r")


@R.query("WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + n_regionkey) % 25 AS b FROM nation), r(x) AS (SELECT 1 UNION SELECT b FROM r JOIN e ON a = x) SELECT x FROM r")
def recursive_union(t: Tables) -> DataFrame:
    e = t("nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + F.col("n_regionkey")) % 25).alias("b"))
    seed = t.spark.range(1).select(F.lit(1).alias("x"))
    return rw.fixed_point(seed, lambda r: r.join(e, r.x == e.a).select(F.col("b").alias("x")))


@R.query("WITH RECURSIVE t(k, p) AS (SELECT k, CASE WHEN k > 0 THEN k // 3 END FROM (SELECT n_nationkey AS k FROM nation)), r AS (SELECT k, p, 0 AS level, CAST(k AS VARCHAR) AS branch FROM t WHERE k = 0 UNION ALL SELECT t.k, t.p, level + 1, branch || '~' || t.k FROM r JOIN t ON t.p = r.k AND t.k <> 0) SELECT k, p, level, branch FROM r")
def connect_by(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    tree = t("nation").select(k.alias("k"), F.when(k > 0, F.floor(k / 3).cast("int")).alias("p"))
    return rs.connect_by(tree, "k", "p", 0, "~")


@R.query("SELECT o_orderstatus AS row_name, max(CASE WHEN o_orderpriority='1-URGENT' THEN n END) AS urgent, max(CASE WHEN o_orderpriority='5-LOW' THEN n END) AS low FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1,2) GROUP BY 1")
def crosstab_categories(t: Tables) -> DataFrame:
    src = t("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return rs.crosstab(src, "o_orderstatus", "o_orderpriority", "n", ["1-URGENT", "5-LOW"], ["urgent", "low"])


@R.query("SELECT g AS row_name, max(CASE WHEN rn=1 THEN v END) AS c1, max(CASE WHEN rn=2 THEN v END) AS c2, max(CASE WHEN rn=3 THEN v END) AS c3 FROM (SELECT n_regionkey AS g, n_name AS v, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation) GROUP BY 1")
def crosstab_positional(t: Tables) -> DataFrame:
    return rs.crosstab_fill(t("nation"), "n_regionkey", "n_nationkey", "n_name", 3)


@R.query("SELECT o_orderkey, o_orderdate, l_shipdate AS shipped FROM (SELECT o_orderkey, o_orderdate, max(l_shipdate) AS l_shipdate FROM orders LEFT JOIN lineitem ON l_suppkey = o_custkey % 100 AND l_shipdate <= o_orderdate GROUP BY 1,2)")
def as_of_join(t: Tables) -> DataFrame:
    o = t("orders").select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 100).alias("k"))
    li = t("lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("ts"), F.col("l_shipdate").alias("v"))
    return sj.as_of(o, li, ["k"], "o_orderdate", "ts", "v", "shipped").drop("k")


@R.query("SELECT a.p_partkey AS pa, b.s_suppkey AS sb FROM (SELECT p_partkey, p_retailprice AS lo, p_retailprice + 5 AS hi FROM part) a JOIN (SELECT s_suppkey, s_acctbal / 5 AS lo2, s_acctbal / 5 + 10 AS hi2 FROM supplier) b ON lo <= hi2 AND lo2 <= hi")
def range_overlap_join(t: Tables) -> DataFrame:
    p = t("part").select("p_partkey", F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + 5).alias("hi"))
    s = t("supplier").select("s_suppkey", (F.col("s_acctbal") / 5).alias("lo2"), (F.col("s_acctbal") / 5 + 10).alias("hi2"))
    return sj.range_join(p, s, "lo", "hi", "lo2", "hi2", 20.0).select(F.col("p_partkey").alias("pa"), F.col("s_suppkey").alias("sb"))


@R.query("SELECT c_custkey AS l_key, s.s_suppkey AS r_key, s.d AS distance FROM customer, LATERAL (SELECT s_suppkey, abs(c_acctbal - s_acctbal) AS d FROM supplier ORDER BY abs(c_acctbal - s_acctbal), s_suppkey LIMIT 3) s")
def nearest_neighbours(t: Tables) -> DataFrame:
    return sj.nearest(t("customer"), t("supplier"), "c_custkey", "c_acctbal", "s_suppkey", "s_acctbal", 3)


@R.query("SELECT a.imdbid, b.id FROM imdb a JOIN omdbmovies b ON levenshtein(trim(a.title[1:10]), trim(b.title[1:10])) <= 2")
def edit_distance_join(t: Tables) -> DataFrame:
    return sj.edit_join(t("imdb").select("imdbid", "title"), t("omdbmovies").select("id", F.col("title").alias("title2")), "title", "title2", 2, 10).select("imdbid", "id")


@R.query("SELECT a.imdbid, b.id, c.nconst FROM imdb a JOIN omdbmovies b ON levenshtein(trim(a.title[1:10]), trim(b.title[1:10])) <= 1 JOIN actors c ON levenshtein(trim(b.title[1:10]), trim(translate(c.knownfortitles[1:10], '“” ', '{}~'))) <= 1")
def edit_distance_join_three_way(t: Tables) -> DataFrame:
    a, b = t("imdb").select("imdbid", "title"), t("omdbmovies").select("id", F.col("title").alias("title2"))
    c = t("actors").select("nconst", "knownfortitles")
    return sj.edit_join_chain(a, b, c, "title", "title2", "knownfortitles", 1, 10).select("imdbid", "id", "nconst")


# the similarity condition of the edit-distance join, block by block
_PROGRESSIVE = "SELECT a.imdbid, b.id FROM imdb a JOIN omdbmovies b ON levenshtein(trim(a.title[1:10]), trim(b.title[1:10])) <= 2"


def _progressive(t: Tables, policy: str, **options) -> DataFrame:
    a = t("imdb").select("imdbid", sj.short_key(F.col("title"), 10).alias("a")).where("a is not null")
    b = t("omdbmovies").select("id", sj.short_key(F.col("title"), 10).alias("b")).where("b is not null")
    return pg.collect_progressive(pg.progressive_edit_join(a, b, "a", "b", 2, 4, 3, policy, **options)).select("imdbid", "id")


@R.query(_PROGRESSIVE)
def progressive_block(t: Tables) -> DataFrame:
    return _progressive(t, "block", flip=True)


@R.query(_PROGRESSIVE)
def progressive_ripple(t: Tables) -> DataFrame:
    return _progressive(t, "ripple")


@R.query(_PROGRESSIVE)
def progressive_online_ripple(t: Tables) -> DataFrame:
    return _progressive(t, "online_ripple", least=2, most=2)


@R.query(_PROGRESSIVE)
def progressive_one_sided(t: Tables) -> DataFrame:
    return _progressive(t, "one_sided", must_explore=2, left_cache=2)


@R.query(_PROGRESSIVE)
def progressive_two_sided(t: Tables) -> DataFrame:
    return _progressive(t, "two_sided", left_cache=2, right_cache=2)


@R.query("SELECT o_orderkey, o_orderpriority, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45")
def progressive_sorted(t: Tables) -> DataFrame:
    li = t("lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return pg.collect_progressive(pg.sorted_progressive_join(t("orders").select("o_orderkey", "o_orderpriority"), li, ["o_orderkey"], 4))


@R.query("SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def sort_merge_join(t: Tables) -> DataFrame:
    return t("orders").hint("merge").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT o_orderstatus, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def shuffled_hash_join(t: Tables) -> DataFrame:
    return t("orders").hint("shuffle_hash").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
