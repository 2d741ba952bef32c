"""Further rows of the inventory: documents as tables, maps, ciphers, counted joins, set-operation types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomql.functions import collections as cl
from loomql.functions import documents as dc
from loomql.operators.special_joins import counted_join
from loomql.plans.registry import Registry, Tables

R = Registry()
c = F.col


@R.query("SELECT * FROM (VALUES (1, 'Bolt', 3.5::DOUBLE),(1, 'Nut', 1.0),(2, 'Gear', 1.0)) v(id, name, price)")
def xml_table(t: Tables) -> DataFrame:
    docs = t.spark.createDataFrame(
        [(1, "<parts><part><name>Bolt</name><price>3.5</price></part><part><name>Nut</name></part></parts>"), (2, "<parts><part><name>Gear</name></part></parts>"), (3, None)], "id int, x string"
    )
    return dc.xml_table(docs, "x", "part", {"name": ("string", None), "price": ("double", 1.0)}, ["id"])


@R.query("SELECT * FROM (VALUES ('<a><b>x</b><b>y</b></a>', 'x', 2::BIGINT, TRUE)) v(x, first_, n, has)")
def xpath_functions(t: Tables) -> DataFrame:
    v = t.spark.sql("SELECT * FROM VALUES ('<a><b>x</b><b>y</b></a>') v(x)")
    return v.select("x", F.xpath_string("x", F.lit("/a/b[1]")).alias("first_"), F.size(F.xpath("x", F.lit("/a/b/text()"))).cast("bigint").alias("n"), F.xpath_boolean("x", F.lit("/a/b='y'")).alias("has"))


@R.query("SELECT * FROM (VALUES (1, TRUE, TRUE, FALSE, 'a', 'a,b,c', '9'),(2, FALSE, TRUE, TRUE, 'a,c', 'a,b,c', '9')) v(k, cont, anyk, allk, slice, merged, b_now)")
def map_operators(t: Tables) -> DataFrame:
    v = t.spark.sql("SELECT * FROM VALUES (1, map('a','1','b','2')), (2, map('a','7','c','3')) v(k, m)")
    m, other = c("m"), F.create_map(F.lit("b"), F.lit("9"), F.lit("c"), F.lit("8"))
    arr = lambda *x: F.array(*map(F.lit, x))
    keys = lambda x: F.array_join(F.sort_array(F.map_keys(x)), ",")
    return v.select("k", cl.map_contains(m, F.create_map(F.lit("a"), F.lit("1"))).alias("cont"), cl.map_has_any(m, arr("a", "z")).alias("anyk"), cl.map_has_all(m, arr("a", "c")).alias("allk"),
        keys(cl.map_slice(cl.map_delete(m, "b"), "a", "b", "c")).alias("slice"), keys(cl.map_merge(m, other)).alias("merged"), F.element_at(cl.map_merge(m, other), F.lit("b")).alias("b_now"))


@R.query("SELECT n_nationkey, n_name FROM nation")
def cipher_round_trip(t: Tables) -> DataFrame:
    key = F.lit("0123456789abcdef")
    sealed = t("nation").select("n_nationkey", F.aes_encrypt(c("n_name"), key, F.lit("GCM")).alias("x"))
    return sealed.select("n_nationkey", F.aes_decrypt("x", key, F.lit("GCM")).cast("string").alias("n_name"))


@R.query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey > n_nationkey + 20")
def counting_nested_loop(t: Tables) -> DataFrame:
    return counted_join(t("supplier"), t("nation"), lambda a, b: a.s_nationkey > b.n_nationkey + 20)[0].select("s_suppkey", "n_nationkey")


@R.query("SELECT CAST(x AS DOUBLE) AS x FROM (SELECT n_nationkey AS x FROM nation UNION SELECT 1.5 UNION SELECT s_acctbal FROM supplier WHERE s_acctbal < 0)")
def set_operation_types(t: Tables) -> DataFrame:
    d = lambda x: x.cast("double").alias("x")
    return t("nation").select(d(c("n_nationkey"))).union(t.spark.range(1).select(d(F.lit(1.5)))).union(t("supplier").where("s_acctbal < 0").select(d(c("s_acctbal")))).distinct()


@R.query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey LIMIT 0) OR c_custkey < 5")
def exists_with_limit_zero(t: Tables) -> DataFrame:
    none = t("orders").select("o_custkey").limit(0)
    some = t("customer").join(none, c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")
    return some.union(t("customer").where("c_custkey < 5").select("c_custkey")).distinct()


@R.query("SELECT 'a' || 'b' AS x WHERE FALSE UNION ALL SELECT CASE WHEN 1 = 1 THEN 'safe' ELSE CAST(1 // 0 AS VARCHAR) END")
def lazy_case(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT CASE WHEN id >= 0 THEN 'safe' ELSE CAST(1 / (id - id) AS STRING) END AS x FROM range(1)")


@R.query("SELECT o_orderstatus, o_orderpriority, n FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) INTERSECT (SELECT o_orderstatus, o_orderpriority, count(*) FROM orders GROUP BY ALL EXCEPT SELECT 'F', '5-LOW', 0)")
def set_operation_precedence(t: Tables) -> DataFrame:
    g = t("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return g.intersect(g.subtract(t.spark.sql("SELECT 'F', '5-LOW', 0L")))


@R.query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS cos FROM embeddings WHERE label = 2")
def vector_similarity_to_query(t: Tables) -> DataFrame:
    e = t("embeddings").select("vec_id", "label", c("embedding").cast("array<double>").alias("e"))
    q = F.broadcast(e.where("vec_id = 0").select(c("e").alias("q")))  # one row
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    cos = dot(c("e"), c("q")) / F.sqrt(dot(c("e"), c("e")) * dot(c("q"), c("q")))
    return e.where("label = 2").join(q, F.size("e") == F.size("q")).select("vec_id", F.round(cos, 6).alias("cos"))


@R.query("SELECT n_regionkey, n_name, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region)")
def natural_join(t: Tables) -> DataFrame:
    sql = "SELECT n_regionkey, n_name, r_name FROM {n} NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM {r})"
    return t.spark.sql(sql, n=t("nation"), r=t("region"))
