"""Aggregates, grouping sets, ordered-set and hypothetical aggregates, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomql.functions.nulls import asc, desc
from loomql.operators import aggregates as ag
from loomql.operators import rewrites as rw
from loomql.plans.registry import Registry, Tables

R = Registry()


@R.query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice*(1-l_discount)),2) AS revenue, avg(l_quantity) AS avg_qty, count(*) AS n, min(l_shipdate) AS first_ship, max(l_discount) AS max_disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1,2")
def pricing_summary(t: Tables) -> DataFrame:
    li = t("lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.avg("l_quantity").alias("avg_qty"), F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("first_ship"), F.max("l_discount").alias("max_disc"))


@R.query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
def plain_aggregate(t: Tables) -> DataFrame:
    return t("orders").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@R.query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND min(o_totalprice) < 50000")
def having(t: Tables) -> DataFrame:
    g = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("lo"))
    return g.where("n > 15 AND lo < 50000").select("o_custkey", "n")


@R.query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, GROUPING(l_returnflag, l_linestatus, l_linenumber) AS grouping_id FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def grouping_sets(t: Tables) -> DataFrame:
    sets = [["l_returnflag", "l_linestatus"], ["l_linenumber"], []]
    return rw.grouping_sets(t("lineitem"), sets, [F.count(F.lit(1)).alias("n")])


@R.query("SELECT a, CAST(NULL AS BIGINT) AS b, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT o_custkey AS a, o_orderkey AS b, o_custkey AS v FROM orders WHERE o_orderkey < 0) GROUP BY GROUPING SETS ((a), (), ())")
def grouping_sets_empty_input(t: Tables) -> DataFrame:
    none = t("orders").where("o_orderkey < 0").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"), F.col("o_custkey").alias("v"))
    out = rw.grouping_sets(none, [["a"], [], []], [F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")])
    return out.select("a", F.lit(None).cast("bigint").alias("b"), "s", "n")


@R.query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, GROUPING(l_returnflag) AS g1 FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(t: Tables) -> DataFrame:
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"), F.grouping("l_returnflag").cast("bigint").alias("g1"))


@R.query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(t: Tables) -> DataFrame:
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_returnflag, ROLLUP (l_linestatus), CUBE (l_linenumber)")
def combined_grouping_clauses(t: Tables) -> DataFrame:
    sql = "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM {li} GROUP BY l_returnflag, ROLLUP (l_linestatus), CUBE (l_linenumber)"
    return t.spark.sql(sql, li=t("lineitem"))


@R.query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, sum(DISTINCT l_quantity) AS q, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY l_suppkey")
def distinct_and_filter(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.sum_distinct("l_quantity").alias("q"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))


@R.query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names, array_agg(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY n_regionkey")
def ordered_aggregates(t: Tables) -> DataFrame:
    return t("nation").groupBy("n_regionkey").agg(
        F.expr("listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC)").alias("names"), ag.array_agg("n_nationkey", "n_nationkey").alias("keys"))


@R.query("SELECT g, array_agg(x ORDER BY k) AS xs FROM (VALUES (1,1,'a'),(1,2,NULL),(1,3,'b'),(2,1,NULL)) v(g,k,x) GROUP BY g")
def array_agg_keeps_nulls(t: Tables) -> DataFrame:
    v = t.spark.sql("SELECT * FROM VALUES (1,1,'a'),(1,2,NULL),(1,3,'b'),(2,1,NULL) v(g,k,x)")
    return v.groupBy("g").agg(ag.array_agg("x", "k").alias("xs"))


@R.query("SELECT l_returnflag, quantile_disc(l_quantity, 0.25) AS q1, quantile_disc(l_quantity, 0.5) AS q2, quantile_cont(l_extendedprice, 0.5) AS med FROM lineitem GROUP BY 1")
def ordered_set_percentiles(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_returnflag").agg(
        F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity)").alias("q1"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity)").alias("q2"),
        F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice)").alias("med"))


@R.query("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity < 30) + 1 AS rank, count(DISTINCT l_quantity) FILTER (WHERE l_quantity < 30) + 1 AS dense_rank, count(*) FILTER (WHERE l_quantity < 30) / count(*) AS percent_rank, (count(*) FILTER (WHERE l_quantity <= 30) + 1) / (count(*) + 1) AS cume_dist FROM lineitem GROUP BY 1")
def hypothetical_set(t: Tables) -> DataFrame:
    return rw.hypothetical(t("lineitem"), 30.0, "l_quantity", ["l_returnflag"])


@R.query("SELECT l_suppkey, bool_and(l_discount < 0.1) AS all_low, bool_or(l_quantity = 50) AS any_50, bit_and(l_linenumber) AS ba, bit_or(l_linenumber) AS bo FROM lineitem GROUP BY 1")
def boolean_and_bit_aggregates(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_suppkey").agg(F.bool_and(F.col("l_discount") < 0.1).alias("all_low"), F.bool_or(F.col("l_quantity") == 50).alias("any_50"), F.bit_and("l_linenumber").alias("ba"), F.bit_or("l_linenumber").alias("bo"))


@R.query("SELECT l_returnflag, round(stddev_samp(l_quantity),8) AS sd, round(var_pop(l_quantity),8) AS vp, round(covar_pop(l_quantity,l_extendedprice),4) AS cp, round(corr(l_quantity,l_extendedprice),8) AS r, round(regr_slope(l_extendedprice,l_quantity),6) AS slope, round(regr_intercept(l_extendedprice,l_quantity),4) AS icpt, round(regr_r2(l_extendedprice,l_quantity),8) AS r2, CAST(regr_count(l_extendedprice,l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def statistics_aggregates(t: Tables) -> DataFrame:
    x, y = "l_quantity", "l_extendedprice"
    return t("lineitem").groupBy("l_returnflag").agg(
        F.round(F.stddev_samp(x), 8).alias("sd"), F.round(F.var_pop(x), 8).alias("vp"), F.round(F.covar_pop(x, y), 4).alias("cp"), F.round(F.corr(x, y), 8).alias("r"),
        F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("icpt"), F.round(F.regr_r2(y, x), 8).alias("r2"), F.regr_count(y, x).alias("n"))


@R.query()
def approximate_distinct(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@R.query("SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr, round(percent_rank() OVER p, 9) AS pr, round(cume_dist() OVER p, 9) AS cd, ntile(4) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority NULLS LAST)")
def window_rankings(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(desc("o_totalprice"), asc("o_orderkey"))
    p = Window.partitionBy("o_custkey").orderBy(asc("o_orderpriority"))
    long = lambda c: c.cast("bigint")
    return t("orders").select("o_custkey", "o_orderkey", long(F.row_number().over(w)).alias("rn"), long(F.rank().over(p)).alias("rk"), long(F.dense_rank().over(p)).alias("dr"),
        F.round(F.percent_rank().over(p), 9).alias("pr"), F.round(F.cume_dist().over(p), 9).alias("cd"), long(F.ntile(4).over(w)).alias("nt"))


@R.query("SELECT o_orderkey, lag(o_totalprice, 2, -1) OVER w AS lag2, lead(o_orderkey) OVER w AS nxt, first_value(o_orderkey) OVER w AS first_key, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_key, nth_value(o_orderkey, 3) OVER w AS third FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_values(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t("orders").select("o_orderkey", F.lag("o_totalprice", 2, -1.0).over(w).alias("lag2"), F.lead("o_orderkey").over(w).alias("nxt"), F.first("o_orderkey").over(w).alias("first_key"),
        F.last("o_orderkey").over(whole).alias("last_key"), F.nth_value("o_orderkey", 3).over(w).alias("third"))


@R.query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),2) AS s3, count(*) OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM orders")
def window_frames(t: Tables) -> DataFrame:
    rows = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    near = Window.partitionBy("o_custkey").orderBy(F.year("o_orderdate")).rangeBetween(-1, 1)
    return t("orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(rows), 2).alias("s3"), F.count(F.lit(1)).over(near).alias("near"))


@R.query("SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW)::BIGINT AS s FROM orders")
def window_groups_frame(t: Tables) -> DataFrame:
    return rw.groups_frame_sum(t("orders"), ["o_orderstatus", "o_custkey"], "o_orderpriority", "o_orderkey", 1, 0, "s").select("o_orderkey", "s")


@R.query("SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES)::BIGINT AS ties, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP)::BIGINT AS grp, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)::BIGINT AS cur FROM orders")
def window_exclude(t: Tables) -> DataFrame:
    df = t("orders")
    for kind, out in (("ties", "ties"), ("group", "grp"), ("current row", "cur")):
        df = rw.exclude_frame_sum(df, ["o_custkey"], "o_orderpriority", "o_orderkey", kind, out)
    return df.select("o_orderkey", "ties", "grp", "cur")


@R.query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn FROM lineitem) SELECT a.l_suppkey, a.rn, b.l_extendedprice AS back FROM r a LEFT JOIN r b ON a.l_suppkey = b.l_suppkey AND a.rn - a.l_linenumber = b.rn")
def window_lag_by_column(t: Tables) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    w = Window.partitionBy("l_suppkey").orderBy(*[F.asc_nulls_last(o) for o in order])
    df = t("lineitem").select("l_suppkey", *order).withColumn("rn", F.row_number().over(w).cast("bigint"))
    return rw.lag_by(df, ["l_suppkey"], order, "l_extendedprice", "l_linenumber", "back").select("l_suppkey", "rn", "back")


@R.query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY o_orderstatus, o_orderpriority) AS BIGINT) AS running FROM orders GROUP BY 1,2")
def window_over_aggregate(t: Tables) -> DataFrame:
    g = t("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("running", F.sum("n").over(Window.orderBy("o_orderstatus", "o_orderpriority")))


@R.query("SELECT l_returnflag, round(sqrt(sum(l_quantity*l_quantity)/count(l_quantity)),8) AS rms FROM lineitem GROUP BY 1")
def user_defined_aggregate(t: Tables) -> DataFrame:
    rms = ag.Aggregate(zero=lambda: [0.0, 0.0], step=lambda s, x: [s[0] + float((x * x).sum()), s[1] + float(x.count())], combine=lambda a, b: [a[0] + b[0], a[1] + b[1]], final=lambda s: (s[0] / s[1]) ** 0.5 if s[1] else None)
    return rms.group(t("lineitem"), ["l_returnflag"], "l_quantity", "rms").withColumn("rms", F.round("rms", 8))


@R.query("SELECT l_suppkey, l_returnflag, max(l_quantity) AS top FROM lineitem GROUP BY 1,2")
def partition_wise_aggregate(t: Tables) -> DataFrame:
    return t("lineitem").repartition("l_suppkey").groupBy("l_suppkey", "l_returnflag").agg(F.max("l_quantity").alias("top"))
