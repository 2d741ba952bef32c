"""Scalar function families: strings, math, dates, arrays, maps, ranges, geometry, network, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomql.functions import collections as cl
from loomql.functions import dates as dt
from loomql.functions import documents as dc
from loomql.functions import network as nw
from loomql.functions import numeric as nm
from loomql.functions import shapes as sh
from loomql.functions import strings as st
from loomql.plans.registry import Registry, Tables

R = Registry()
c = F.col


@R.query("SELECT p_partkey, p_name[1:4] AS cut, rpad(p_name[1:8], 8, ' ') AS padded, concat(p_name, NULL, '-', p_brand) AS joined, CAST(p_name || NULL AS VARCHAR) AS strict, left(p_name, -2) AS l2, right(p_name, -3) AS r3, reverse(p_name) AS rev, length(p_name) AS len FROM part")
def string_basics(t: Tables) -> DataFrame:
    n = c("p_name")
    return t("part").select("p_partkey", st.varchar(n, 4).alias("cut"), st.bpchar(n, 8).alias("padded"), st.concat(n, F.lit(None), F.lit("-"), c("p_brand")).alias("joined"),
        F.concat(n, F.lit(None).cast("string")).alias("strict"), st.left(n, -2).alias("l2"), st.right(n, -3).alias("r3"), F.reverse(n).alias("rev"), F.length(n).cast("bigint").alias("len"))


@R.query("SELECT p_partkey, upper(p_name) AS up, trim(both 'r' FROM p_name) AS tr, substr(p_name, 2, 3) AS sub, instr(p_name, 'e') AS pos, replace(p_name, 'e', '3') AS rep, translate(p_name, 'aeiou', 'AEIOU') AS tra, split_part(p_name, ' ', 2) AS second, repeat(p_type[1:2], 2) AS twice, ascii(p_name) AS asc_, chr(65 + p_size % 26) AS ch, lpad(p_brand, 10, '*') AS lp FROM part")
def string_edits(t: Tables) -> DataFrame:
    n = c("p_name")
    return t("part").select("p_partkey", F.upper(n).alias("up"), F.trim(n, F.lit("r")).alias("tr"), F.substring(n, 2, 3).alias("sub"), F.locate("e", n).cast("bigint").alias("pos"), F.replace(n, F.lit("e"), F.lit("3")).alias("rep"),
        F.translate(n, "aeiou", "AEIOU").alias("tra"), F.split_part(n, F.lit(" "), F.lit(2)).alias("second"), F.repeat(F.substring("p_type", 1, 2), 2).alias("twice"), F.ascii(n).alias("asc_"), F.char(65 + c("p_size") % 26).alias("ch"), F.lpad("p_brand", 10, "*").alias("lp"))


@R.query("SELECT p_partkey, p_name LIKE 'r%' AS lk, p_name ILIKE '%RING%' AS il, regexp_matches(p_name, '^(red|blue) ') AS rx, regexp_matches(p_brand, '^Brand#[0-9]$') AS sim, regexp_extract(p_name, '^([a-z]+) ([a-z]+)$', 2) AS g2, regexp_replace(p_name, '[aeiou]', '.') AS first_, regexp_replace(p_name, '[aeiou]', '.', 'g') AS all_, regexp_extract_all(p_name, '([a-z])[aeiou]', 1) AS ms FROM part")
def regular_expressions(t: Tables) -> DataFrame:
    n = c("p_name")
    return t("part").select("p_partkey", n.like("r%").alias("lk"), n.ilike("%RING%").alias("il"), n.rlike("^(red|blue) ").alias("rx"), st.similar_to(c("p_brand"), "Brand#[0-9]").alias("sim"),
        F.get(st.regexp_match(n, "^([a-z]+) ([a-z]+)$", 2), F.lit(1)).alias("g2"), st.regexp_replace(n, "[aeiou]", ".").alias("first_"), st.regexp_replace(n, "[aeiou]", ".", "g").alias("all_"), st.regexp_matches(n, "([a-z])[aeiou]").alias("ms"))


@R.query("SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s, lower(hex(p_name)) AS hx, base64(encode(p_name)) AS b64, printf('%x', p_partkey) AS th FROM part")
def hashing_and_encoding(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", F.md5("p_name").alias("m"), F.sha2("p_name", 256).alias("s"), st.encode(c("p_name"), "hex").alias("hx"), st.encode(F.encode("p_name", "UTF-8"), "base64").alias("b64"), st.to_hex(c("p_partkey")).alias("th"))


@R.query("SELECT * FROM (VALUES ('simple','simple','''simple'''),('Mixed Case','\"Mixed Case\"','''Mixed Case'''),('it''s','\"it''s\"','''it''''s''')) v(s, ident, literal)")
def quoting(t: Tables) -> DataFrame:
    v = t.spark.createDataFrame([("simple",), ("Mixed Case",), ("it's",)], "s string")
    return v.select("s", st.quote_ident(c("s")).alias("ident"), st.quote_literal(c("s")).alias("literal"))


@R.query("SELECT b, b[2:2]::INTEGER AS bit1, bitand, bitor, bitxor, bitnot, shl FROM (VALUES ('1100','1000','1110','0110','0011','1000'),('0101','0000','1111','1111','1010','1010')) v(b, bitand, bitor, bitxor, bitnot, shl)")
def bit_strings(t: Tables) -> DataFrame:
    v = t.spark.sql("SELECT * FROM VALUES ('1100'),('0101') v(b)")
    k = F.lit("1010")
    return v.select("b", st.get_bit(c("b"), 1).alias("bit1"), st.bits_op(c("b"), k, "and").alias("bitand"), st.bits_op(c("b"), k, "or").alias("bitor"), st.bits_op(c("b"), k, "xor").alias("bitxor"), st.bits_not(c("b")).alias("bitnot"), st.bits_shift(c("b"), 1).alias("shl"))


def _math(lines: DataFrame) -> DataFrame:
    q, p = c("l_quantity"), c("l_partkey")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", nm.int_div(p, c("l_linenumber")).alias("q"), (p % 7).alias("m"), nm.to_int(q / 4).alias("ri"), F.round(F.cbrt("l_extendedprice"), 6).alias("cb"),
        F.round(F.sqrt(q), 8).alias("sq"), F.round(nm.power(q, F.lit(2.5)), 4).alias("pw"), nm.trunc(c("l_extendedprice")).alias("tr"), F.ceil(c("l_discount") * 10).cast("double").alias("ce"), F.floor(c("l_tax") * 10).cast("double").alias("fl"),
        F.signum(c("l_discount") - 0.05).cast("tinyint").alias("sg"), F.round(nm.ln_strict(q), 8).alias("lg"))


@R.query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey // l_linenumber AS BIGINT) AS q, l_partkey % 7 AS m, CAST(round_even(l_quantity / 4, 0) AS BIGINT) AS ri, round(cbrt(l_extendedprice), 6) AS cb, round(sqrt(l_quantity), 8) AS sq, round(power(l_quantity, 2.5), 4) AS pw, trunc(l_extendedprice) AS tr, ceil(l_discount * 10) AS ce, floor(l_tax * 10) AS fl, sign(l_discount - 0.05) AS sg, round(ln(l_quantity), 8) AS lg FROM lineitem")
def math_functions(t: Tables) -> DataFrame:
    return _math(t("lineitem"))


@R.query("SELECT d, CASE d WHEN 0 THEN 0.0 WHEN 30 THEN 0.5 WHEN 90 THEN 1.0 WHEN 210 THEN -0.5 ELSE round(sin(radians(d)), 12) END AS s, CASE d WHEN 0 THEN 1.0 WHEN 60 THEN 0.5 WHEN 90 THEN 0.0 ELSE round(cos(radians(d)),12) END AS k FROM (VALUES (0.0::DOUBLE),(30.0),(45.0),(60.0),(90.0),(210.0)) v(d)")
def degree_functions(t: Tables) -> DataFrame:
    v = t.spark.sql("SELECT * FROM VALUES (0D),(30D),(45D),(60D),(90D),(210D) v(d)")
    return v.select("d", F.round(nm.sind(c("d")), 12).alias("s"), F.round(nm.cosd(c("d")), 12).alias("k"))


@R.query("SELECT a, b, gcd(a, b) AS g, a & b AS an, a | b AS o, xor(a, b) AS x, a << 2 AS sl, a >> 1 AS sr FROM (VALUES (12::BIGINT, 18::BIGINT),(7, 5),(100, 75),(0, 9)) v(a, b)")
def integer_bit_math(t: Tables) -> DataFrame:
    v = t.spark.sql("SELECT * FROM VALUES (12L,18L),(7L,5L),(100L,75L),(0L,9L) v(a,b)")
    return v.select("a", "b", nm.gcd(c("a"), c("b")).alias("g"), c("a").bitwiseAND(c("b")).alias("an"), c("a").bitwiseOR(c("b")).alias("o"), c("a").bitwiseXOR(c("b")).alias("x"), F.shiftleft("a", 2).alias("sl"), F.shiftright("a", 1).alias("sr"))


@R.query("SELECT * FROM (VALUES (0.0::DOUBLE,'Zero dollars and zero cents'),(1.01,'One dollar and one cent'),(123456.78,'One hundred twenty three thousand four hundred fifty six dollars and seventy eight cents'),(-20.5,'Minus twenty dollars and fifty cents')) v(m, words)")
def money_words(t: Tables) -> DataFrame:
    v = t.spark.sql("SELECT * FROM VALUES (0D),(1.01D),(123456.78D),(-20.5D) v(m)")
    return v.select("m", nm.cash_words(c("m")).alias("words"))


_FIELDS = ("century", "decade", "year", "quarter", "month", "week", "day", "dow", "isodow", "doy", "isoyear")


@R.query("SELECT o_orderkey, " + ", ".join(f"extract({f} FROM o_orderdate) AS {f}_" for f in _FIELDS) + ", epoch(o_orderdate) AS epoch_ FROM orders")
def date_fields(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", *[dt.extract(f, c("o_orderdate")).cast("bigint").alias(f + "_") for f in _FIELDS], dt.extract("epoch", c("o_orderdate")).cast("double").alias("epoch_"))


@R.query("SELECT event_id, date_trunc('hour', ts) AS h, date_trunc('week', ts)::TIMESTAMP AS w, date_trunc('month', ts)::TIMESTAMP AS m, date_trunc('decade', ts)::TIMESTAMP AS d, make_timestamp(2001,1,1,0,0,0) AS century FROM events")
def date_truncation(t: Tables) -> DataFrame:
    ts = c("ts")
    return t("events").select("event_id", *[dt.date_trunc(u, ts).alias(a) for u, a in (("hour", "h"), ("week", "w"), ("month", "m"), ("decade", "d"), ("century", "century"))])


@R.query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS txt, strftime(ts, '%d/%m/%y') AS short_, CAST(ts AS DATE) + 30 AS later, date_diff('day', CAST(ts AS DATE), DATE '2024-12-31') AS left_, ts + INTERVAL '1 month' + INTERVAL '3 days' + INTERVAL '90 minutes' AS moved, make_date(2024, 2, 29) AS leap FROM events")
def date_arithmetic(t: Tables) -> DataFrame:
    ts = c("ts")
    i = dt.interval(1, 3, 90 * 60_000_000)
    return t("events").select("event_id", dt.to_char(ts, "YYYY-MM-DD HH24:MI:SS").alias("txt"), dt.to_char(ts, "DD/MM/YY").alias("short_"), F.date_add(ts.cast("date"), 30).alias("later"),
        F.datediff(F.lit("2024-12-31").cast("date"), ts.cast("date")).cast("bigint").alias("left_"), dt.add_interval(ts, i).alias("moved"), F.make_date(F.lit(2024), F.lit(2), F.lit(29)).alias("leap"))


@R.query("SELECT * FROM (VALUES (1, 2::BIGINT, 3, 1800000000::BIGINT),(2, -1, -6, 0)) v(k, mo, da, mi)")
def justified_intervals(t: Tables) -> DataFrame:
    v = t.spark.sql("SELECT * FROM VALUES (1, 1, 30, 261000000000L), (2, 0, -36, 0L) v(k, a, b, m)")
    j = dt.justify_interval(dt.interval(c("a"), c("b"), c("m")))
    return v.select("k", j["months"].cast("bigint").alias("mo"), j["days"].alias("da"), j["micros"].alias("mi"))


@R.query("SELECT g, list_sort(xs) AS sorted, list_distinct_sorted, has, pos, n, cont, inter FROM (SELECT n_regionkey AS g, list(n_nationkey % 7) AS xs, list_sort(list_distinct(list(n_nationkey % 7))) AS list_distinct_sorted, list_contains(list(n_nationkey % 7), 3) AS has, CAST(coalesce(list_position(list_sort(list(n_nationkey % 7)), 3), 0) AS INTEGER) AS pos, CAST(count(*) AS INTEGER) AS n, list_has_all(list(n_nationkey % 7), [1,2]) AS cont, list_sort(list_intersect(list_distinct(list(n_nationkey % 7)), [1,2,3])) AS inter FROM nation GROUP BY 1)")
def array_functions(t: Tables) -> DataFrame:
    g = t("nation").groupBy(c("n_regionkey").alias("g")).agg(F.sort_array(F.collect_list(c("n_nationkey") % 7)).alias("sorted"))
    s = c("sorted")
    arr = lambda *x: F.array(*map(F.lit, x))
    return g.select("g", "sorted", cl.uniq(s).alias("list_distinct_sorted"), F.array_contains(s, 3).alias("has"), cl.idx(s, 3).alias("pos"), F.size(s).alias("n"), cl.array_contains_all(s, arr(1, 2)).alias("cont"), F.sort_array(F.array_intersect(s, arr(1, 2, 3))).alias("inter"))


@R.query("SELECT g FROM (SELECT n_regionkey AS g, list(n_nationkey) AS xs FROM nation GROUP BY 1) WHERE list_contains(xs, 1) OR (list_contains(xs, 2) AND NOT list_contains(xs, 9))")
def integer_array_query(t: Tables) -> DataFrame:
    g = t("nation").groupBy(c("n_regionkey").alias("g")).agg(F.collect_list("n_nationkey").alias("xs"))
    return g.where(cl.int_query(c("xs"), "1 | (2 & !9)")).select("g")


@R.query("SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 5 END AS INTEGER) AS pos FROM orders WHERE o_orderpriority >= '4'")
def enum_order(t: Tables) -> DataFrame:
    e = cl.Enum("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return t("orders").where(e.ordinal(c("o_orderpriority")) >= 4).select("o_orderkey", e.ordinal(c("o_orderpriority")).alias("pos"))


@R.query("SELECT k, map_extract_value(m, 'a') AS a, map_contains(m, 'c') AS hc, list_sort(map_keys(m)) AS keys FROM (VALUES (1, MAP {'a':'1','b':'2'}),(2, MAP {'a':'9','c':NULL})) v(k, m)")
def map_functions(t: Tables) -> DataFrame:
    v = t.spark.sql("SELECT * FROM VALUES (1, map('a','1','b','2')), (2, map('a','9','c',CAST(NULL AS STRING))) v(k, m)")
    return v.select("k", F.element_at("m", F.lit("a")).alias("a"), F.map_contains_key("m", "c").alias("hc"), F.sort_array(F.map_keys("m")).alias("keys"))


@R.query("SELECT p_partkey, p_size < s2 + 5 AND s2 < p_size + 5 AS over, p_size <= s2 AND p_size + 5 >= s2 + 5 AS cont, p_size + 5 <= s2 AS lft, (p_size + 5 = s2 OR s2 + 5 = p_size) AS adj, CASE WHEN p_size < s2 + 5 AND s2 < p_size + 5 THEN greatest(p_size, s2) END AS ilo, least(p_size, s2) AS mlo, greatest(p_size, s2) + 5 AS mhi, 7 >= p_size AND 7 < p_size + 5 AS has7 FROM (SELECT p_partkey, p_size, CAST(p_partkey % 50 AS INTEGER) AS s2 FROM part)")
def range_functions(t: Tables) -> DataFrame:
    p = t("part").select("p_partkey", "p_size", (c("p_partkey") % 50).cast("int").alias("s2"))
    a, b = cl.make_range(c("p_size"), c("p_size") + 5), cl.make_range(c("s2"), c("s2") + 5)
    return p.select("p_partkey", cl.overlaps(a, b).alias("over"), cl.contains(a, b).alias("cont"), cl.left_of(a, b).alias("lft"), cl.adjacent(a, b).alias("adj"), cl.intersection(a, b)["lo"].alias("ilo"),
        cl.merge(a, b)["lo"].alias("mlo"), cl.merge(a, b)["hi"].alias("mhi"), cl.contains_value(a, F.lit(7)).alias("has7"))


@R.query("SELECT s_suppkey, round(sqrt((s_acctbal-100)*(s_acctbal-100) + s_suppkey*s_suppkey), 6) AS d, round(pi()*s_suppkey*s_suppkey, 6) AS area, abs(s_acctbal*s_suppkey) AS box_area, s_acctbal >= 0 AND s_acctbal <= 500 AND s_suppkey <= 50 AS inside FROM supplier")
def geometry_functions(t: Tables) -> DataFrame:
    s = t("supplier")
    p, o = sh.point(c("s_acctbal"), c("s_suppkey")), sh.point(F.lit(0.0), F.lit(0.0))
    return s.select("s_suppkey", F.round(sh.distance(p, sh.point(F.lit(100.0), F.lit(0.0))), 6).alias("d"), F.round(sh.circle_area(sh.circle(p, c("s_suppkey"))), 6).alias("area"),
        sh.box_area(sh.box(p, o)).alias("box_area"), sh.box_contains(sh.box(o, sh.point(F.lit(500.0), F.lit(50.0))), p).alias("inside"))


@R.query("SELECT a.vec_id AS va, b.vec_id AS vb, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS l2, round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: abs(p[1] - p[2]))), 6) AS l1 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_distances(t: Tables) -> DataFrame:
    e = t("embeddings").select("vec_id", c("embedding").cast("array<double>").alias("e"))
    b = e.select((c("vec_id") - 1).alias("vec_id"), c("vec_id").alias("vb"), c("e").alias("f"))
    return e.join(b, "vec_id").select(c("vec_id").alias("va"), "vb", F.round(sh.euclid(c("e"), c("f")), 6).alias("l2"), F.round(sh.taxicab(c("e"), c("f")), 6).alias("l1"))


@R.query("SELECT n_nationkey, round(2 * 6378168.0 * asin(sqrt(power(sin(radians(n_nationkey - 10) / 2), 2) + cos(radians(10)) * cos(radians(n_nationkey)) * power(sin(radians(n_regionkey * 20) / 2), 2))), 3) AS m FROM nation")
def earth_distance(t: Tables) -> DataFrame:
    return t("nation").select("n_nationkey", F.round(sh.earth_distance(F.lit(10.0), F.lit(0.0), c("n_nationkey"), c("n_regionkey") * 20), 3).alias("m"))


@R.query("SELECT * FROM (VALUES ('192.168.1.77/24','192.168.1.77',24,'192.168.1.0/24','192.168.1.255','255.255.255.0',TRUE),('10.1.2.3','10.1.2.3',32,'10.1.2.3/32','10.1.2.3','255.255.255.255',FALSE)) v(a, host, bits, net, bcast, mask, inside)")
def network_functions(t: Tables) -> DataFrame:
    v = t.spark.sql("SELECT * FROM VALUES ('192.168.1.77/24'),('10.1.2.3') v(a)")
    i = nw.inet(c("a"))
    return v.select("a", nw.host(i).alias("host"), nw.masklen(i).alias("bits"), nw.network(i).alias("net"), nw.broadcast(i).alias("bcast"), nw.netmask(i).alias("mask"), nw.contained(i, nw.inet(F.lit("192.168.0.0/16"))).alias("inside"))


@R.query("SELECT * FROM (VALUES ('08-00-2B-01-02-03','08:00:2b:01:02:03','08:00:2b:00:00:00','0a:00:2b:ff:fe:01:02:03')) v(a, mac, vendor, mac8)")
def hardware_addresses(t: Tables) -> DataFrame:
    v = t.spark.sql("SELECT * FROM VALUES ('08-00-2B-01-02-03') v(a)")
    return v.select("a", nw.macaddr(c("a")).alias("mac"), nw.macaddr_trunc(c("a")).alias("vendor"), nw.macaddr8_set7bit(c("a")).alias("mac8"))


@R.query("SELECT * FROM (VALUES ('978030640615', 7, '030640615', '2')) v(ean, ean_digit, isbn, isbn_digit)")
def check_digits(t: Tables) -> DataFrame:
    v = t.spark.sql("SELECT * FROM VALUES ('978030640615','030640615') v(ean, isbn)")
    return v.select("ean", nw.ean13_check(c("ean")).alias("ean_digit"), "isbn", nw.isbn10_check(c("isbn")).alias("isbn_digit"))


@R.query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_exists(props, '$.k') AS hk, json_extract_string(props, '$.k') = '69' AS c69 FROM events")
def json_functions(t: Tables) -> DataFrame:
    return t("events").select("event_id", dc.json_get(c("props"), "k").alias("k"), dc.json_has_key(c("props"), "k").alias("hk"), dc.json_contains("props", F.lit('{"k": 69}')).alias("c69"))


@R.query("SELECT * FROM (VALUES ('Top.Science.Astronomy.Stars',4,'Science.Astronomy',TRUE,'Top.Science',TRUE),('Top.Science.Physics',3,'Science.Physics',TRUE,'Top.Science',FALSE),('Top.Hobbies',2,'Hobbies',FALSE,'Top',FALSE)) v(p, lvl, sub, under, anc, q)")
def label_trees(t: Tables) -> DataFrame:
    v = t.spark.sql("SELECT * FROM VALUES ('Top.Science.Astronomy.Stars'),('Top.Science.Physics'),('Top.Hobbies') v(p)")
    return v.select("p", dc.label_level(c("p")).alias("lvl"), dc.subpath(c("p"), 1, 2).alias("sub"), dc.is_ancestor(F.lit("Top.Science"), c("p")).alias("under"), dc.lca(c("p"), F.lit("Top.Science.Astronomy")).alias("anc"), dc.lquery(c("p"), "*.Astro*|Chem.*").alias("q"))


@R.query()
def text_search(t: Tables) -> DataFrame:
    v = t("documents").where("lang = 'en'").select("doc_id", dc.to_tsvector(c("text")).alias("v"))
    return v.where(dc.ts_match(c("v"), "lantern & !harbor | rusted <-> railway")).select("doc_id", F.round(dc.ts_rank(c("v"), "lantern", "railway"), 6).alias("rank"))


@R.query()
def named_uuid_and_hmac(t: Tables) -> DataFrame:
    u, h = nw.uuid_by_name(5, "6ba7b810-9dad-11d1-80b4-00c04fd430c8"), nw.hmac("key", "sha256")
    return t("nation").select("n_nationkey", u("n_name").alias("uid"), h("n_name").alias("mac"))
