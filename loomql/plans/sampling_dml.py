"""Sampling, data modification, sinks and sources as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomql.operators import dml
from loomql.operators.sampling import tablesample
from loomql.plans.registry import Registry, Tables
from loomql.session import shared_dir
from loomql.sources import sinks, tables

R = Registry()
c = F.col


class CountUp:
    """Set-returning function: 1 .. n, no row for a null."""

    def eval(self, n: int):
        for i in range(1, (n or 0) + 1):
            yield (i,)


@R.query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST('0x' || md5('7|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey)[1:8] AS UBIGINT) < 0.1 * 4294967296")
def sample_bernoulli(t: Tables) -> DataFrame:
    return tablesample(t("lineitem"), "bernoulli", 10.0, key=["l_orderkey", "l_linenumber", "l_partkey"], seed=7).select("l_orderkey", "l_linenumber")


@R.query()
def sample_system(t: Tables) -> DataFrame:
    return tablesample(t("orders"), "system", 60.0, seed=3).select("o_orderkey")


@R.query("SELECT 100::BIGINT AS n, 100::BIGINT AS different, 100::BIGINT AS rows_of_the_table")
def sample_system_rows(t: Tables) -> DataFrame:
    rows = tablesample(t("orders"), "system_rows", 100, seed=1).select("o_orderkey", "o_totalprice")
    known = t("orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("known"))
    met = rows.join(known, ["o_orderkey", "o_totalprice"], "left")
    return met.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("different"), F.count("known").alias("rows_of_the_table"))


@R.query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_rewrite(t: Tables) -> DataFrame:
    return dml.update(t("supplier"), c("s_acctbal") < 0, {"s_acctbal": F.lit(0.0)})[0].select("s_suppkey", "s_acctbal")


@R.query("SELECT s_suppkey, 0.0::DOUBLE AS s_acctbal FROM supplier WHERE s_acctbal < 0")
def update_returning(t: Tables) -> DataFrame:
    return dml.update(t("supplier"), c("s_acctbal") < 0, {"s_acctbal": F.lit(0.0)})[1].select("s_suppkey", "s_acctbal")


@R.query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 AND c_mktsegment = 'BUILDING')")
def delete_rewrite(t: Tables) -> DataFrame:
    return dml.delete(t("customer"), (c("c_acctbal") < 0) & (c("c_mktsegment") == "BUILDING"))[0].select("c_custkey")


@R.query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING'")
def delete_returning(t: Tables) -> DataFrame:
    return dml.delete(t("customer"), (c("c_acctbal") < 0) & (c("c_mktsegment") == "BUILDING"))[1].select("c_custkey")


@R.query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100, 'NEW'")
def insert_on_conflict_nothing(t: Tables) -> DataFrame:
    rows = t.spark.sql("SELECT * FROM VALUES (3, 'OTHER', 0), (100, 'NEW', 1) v(n_nationkey, n_name, n_regionkey)")
    return dml.insert_ignore(t("nation"), rows, ["n_nationkey"])[0].select("n_nationkey", "n_name")


@R.query("SELECT CASE WHEN n_nationkey = 3 THEN 'OTHER' ELSE n_name END AS n_name, n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'NEW', 100, 1")
def upsert_rewrite(t: Tables) -> DataFrame:
    rows = t.spark.sql("SELECT * FROM VALUES (3, 'OTHER', 0), (100, 'NEW', 1) v(n_nationkey, n_name, n_regionkey)")
    return dml.upsert(t("nation"), rows, ["n_nationkey"], ["n_name"])


@R.query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def copy_round_trip(t: Tables) -> DataFrame:
    """The whole table exported and loaded again."""
    path = f"{shared_dir(t.spark)}/loomql-copy-{uuid.uuid4().hex}"
    sinks.copy_to(t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path, delimiter="|", header=True)
    return tables.delimited(t.spark, path, "o_orderkey bigint, o_orderpriority string, o_totalprice double", delimiter="|", header=True)


@R.query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def materialized_view(t: Tables) -> DataFrame:
    return sinks.MaterializedView(t.spark, "brands", lambda: t("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))).refresh().read()


@R.query("SELECT p_partkey, p_name, p_size FROM part")
def shuffled_copy(t: Tables) -> DataFrame:
    return sinks.shuffled_copy(t("part"), 3).select("p_partkey", "p_name", "p_size")


@R.query("SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1")
def value_distribution(t: Tables) -> DataFrame:
    return sinks.distribution(t("lineitem").select("l_quantity"), "l_quantity")


@R.query("SELECT n_nationkey, n_nationkey * n_nationkey + 1 AS sq FROM nation")
def sql_function(t: Tables) -> DataFrame:
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION square_plus(x INT, y INT DEFAULT 1) RETURNS INT RETURN x * x + y")
    return t("nation").select("n_nationkey", F.expr("square_plus(n_nationkey)").alias("sq"))


@R.query("SELECT n_nationkey AS k, CAST(unnest(generate_series(1, n_nationkey)) AS INTEGER) AS i FROM nation")
def table_function(t: Tables) -> DataFrame:
    t.spark.udtf.register("count_up", F.udtf(CountUp, returnType="i int"))
    return t.spark.sql("SELECT n_nationkey AS k, i FROM {n}, LATERAL count_up(n_nationkey)", n=t("nation"))
