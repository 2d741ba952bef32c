"""Operators against brute force on literal tables."""

import os
import random
import sqlite3

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from loomql.operators import dml, progressive, reshaping, rewrites, special_joins
from loomql.operators.cursor import Cursor
from loomql.operators.sampling import tablesample
from loomql.operators.skew import hot_cold_join
from loomql.plans import explain, joins
from loomql.session import durable, stages
from loomql.sources import foreign, sinks


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


WORDS = hs.lists(hs.text("abc", max_size=7), min_size=1, max_size=12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=WORDS, right=WORDS, k=hs.integers(1, 3))
def test_edit_join_equals_theta_join(spark, left, right, k):
    lt = spark.createDataFrame(list(enumerate(left)), "i int, a string")
    rt = spark.createDataFrame(list(enumerate(right)), "j int, b string")
    got = sorted((r.i, r.j) for r in special_joins.edit_join(lt, rt, "a", "b", k, 5).collect())
    cut = lambda s: s[:5].strip(" ")
    want = sorted((i, j) for i, a in enumerate(left) for j, b in enumerate(right) if lev(cut(a), cut(b)) <= k)
    assert got == want


@pytest.mark.parametrize("policy", ["block", "ripple", "one_sided", "two_sided"])
@pytest.mark.parametrize("blocks", [(1, 1), (3, 2), (2, 5)])
def test_progressive_join_gives_the_plain_join(spark, policy, blocks):
    a = spark.range(23).select(F.col("id").alias("x"))
    b = spark.range(17).select(F.col("id").alias("y"))
    on = lambda p, q: (p.x * 7) % 5 < q.y % 4
    got = progressive.collect_progressive(progressive.progressive_join(a, b, on, *blocks, policy, flip=policy == "ripple"))
    want = a.join(b, on(a, b))
    assert sorted(map(tuple, got.select("x", "y").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_edit_join_chain_equals_theta_joins(spark, rows):
    left, middle = ["", "ab", "ab", "ab", "abc", None, "abcdefg", "x y"], ["ab", "ab", "abd", "", None, "abcdeX", "xy"]
    right = ["ab", "abc", "abc", "a", "zz", None, "abcd", "xyz"]
    tables = [spark.createDataFrame(list(enumerate(w)), f"{n} int, {n}k string") for n, w in zip("abc", (left, middle, right), strict=True)]
    got = special_joins.edit_join_chain(*tables, "ak", "bk", "ck", 1, 5, rows)
    cut = lambda s: s[:5].strip(" ")
    near = lambda x, y: x is not None and y is not None and lev(cut(x), cut(y)) <= 1
    want = sorted((i, j, h) for i, x in enumerate(left) for j, y in enumerate(middle) if near(x, y) for h, z in enumerate(right) if near(y, z))
    assert got.columns == ["a", "ak", "b", "bk", "c", "ck"]
    assert sorted((r.a, r.b, r.c) for r in got.collect()) == want


def test_edit_join_chain_cuts_a_hot_key(spark):
    side = lambda n, name: spark.range(n).select(F.col("id").alias(name), F.lit("hot").alias(f"{name}k"))
    got = special_joins.edit_join_chain(side(40, "a"), side(10, "b"), side(50, "c"), "ak", "bk", "ck", 1, 5, 1000)
    sizes = [r.n for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 20_000 and got.distinct().count() == 20_000 and len(sizes) > 5 and max(sizes) < 10_000


@pytest.mark.parametrize("policy", progressive.POLICIES)
@pytest.mark.parametrize("flip", [False, True])
def test_progressive_edit_join_gives_every_row_once(spark, policy, flip):
    left = ["", "a", "ab", "abc", "abc", None, "xyz", "b c", "abcde", "abdde", "é", "x"]
    right = ["abd", "abd", "", "zz", None, "abcdef", "bc", "e", "xyz"]
    a, b = spark.createDataFrame(list(enumerate(left)), "i int, a string"), spark.createDataFrame(list(enumerate(right)), "j int, b string")
    parts = list(progressive.progressive_edit_join(a, b, "a", "b", 2, 3, 2, policy, flip=flip))
    got = [(p, n, [(r.i, r.a, r.j, r.b) for r in rows.collect()]) for p, n, rows in parts]
    assert sorted(p for p, _, _ in got) == [(i, j) for i in range(3) for j in range(2)] and all(n == len(rows) for _, n, rows in got)
    want = sorted((i, x, j, y) for i, x in enumerate(left) for j, y in enumerate(right) if x is not None and y is not None and lev(x, y) <= 2)
    assert sorted(r for _, _, rows in got for r in rows) == want


@pytest.mark.parametrize("name", ["progressive_block", "progressive_ripple", "progressive_one_sided", "progressive_two_sided", "progressive_online_ripple"])
def test_progressive_queries_compare_no_pair_of_all_rows(spark, sf_dir, monkeypatch, name):
    plans = []
    monkeypatch.setattr(progressive, "durable", lambda df, *more: (plans.append(df._jdf.queryExecution().executedPlan().toString()), durable(df, *more))[1])
    joins.R.queries[name](spark, sf_dir)
    assert len(plans) == 12 and not any("NestedLoop" in p or "Cartesian" in p for p in plans)


def test_time_to_k(spark):
    a, b = spark.range(10).toDF("x"), spark.range(10).toDF("y")
    r = progressive.time_to_k(progressive.progressive_join(a, b, lambda p, q: p.x == q.y, 2, 2), [1, 5, 99])
    assert r["rows"] == 10 and set(r["time_to_k"]) == {1, 5} and r["discounted"] > 0


def test_hot_cold_join_left_and_inner(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [("c", 1), ("none", 2), (None, 3)], "k string, i int")
    dim = spark.createDataFrame([("hot", 500, "H"), ("c", 1, "C")], "k string, n long, v string")
    got = hot_cold_join(rows, dim, ["k"], "n", "left", hot_keys=2)
    assert got.count() == 503 and got.where("v is null").count() == 2
    assert hot_cold_join(rows, dim, ["k"], "n", "inner", hot_keys=2).count() == 501
    assert hot_cold_join(rows, dim.limit(0), ["k"], "n", "left").count() == 503


def test_nearest_with_ties(spark):
    left = spark.createDataFrame([(1, 5.0), (2, -9.0)], "a long, v double")
    right = spark.createDataFrame([(i, float(x)) for i, x in enumerate([4, 6, 6, 4, 50, 5])], "b long, w double")
    got = sorted(map(tuple, special_joins.nearest(left, right, "a", "v", "b", "w", 3).collect()))
    assert got == sorted([(1, 5, 0.0), (1, 0, 1.0), (1, 1, 1.0), (2, 0, 13.0), (2, 3, 13.0), (2, 5, 14.0)])


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_nearest_against_brute_force(spark, rows):
    rng = random.Random(rows)
    left = [(i, rng.choice([None, 3.0, float(rng.randint(-20, 20))])) for i in range(60)]
    right = [(i, rng.choice([None, 5.0, 5.0, float(rng.randint(-30, 30))])) for i in range(80)]
    lt, rt = spark.createDataFrame(left, "a long, v double"), spark.createDataFrame(right, "b long, w double")
    got = sorted(map(tuple, special_joins.nearest(lt, rt, "a", "v", "b", "w", 3, rows=rows).collect()))
    want = [(a, b, d) for a, v in left if v is not None for d, b in sorted((abs(v - w), b) for b, w in right if w is not None)[:3]]
    assert got == sorted(want)
    assert special_joins.nearest(lt, rt.limit(0), "a", "v", "b", "w", 3).count() == 0


@pytest.mark.parametrize("rows", [1, 5, 1000])
def test_as_of_and_numbered_in_ranges(spark, rows):
    rng = random.Random(rows)
    left = [(i, rng.choice(["hot", "hot", "x", None]), rng.choice([None, rng.randint(0, 30)])) for i in range(60)]
    right = [(rng.choice(["hot", "x"]), rng.randint(0, 30), rng.choice([None, rng.randint(0, 9)])) for _ in range(50)]
    lt, rt = spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, s int, v int")
    got = {r.i: r.v_at for r in special_joins.as_of(lt, rt, ["k"], "t", "s", "v", "v_at", rows=rows).collect()}
    for i, k, t in left:
        met = [(s, v) for kk, s, v in right if kk == k and t is not None and s <= t and v is not None]
        assert got[i] == (max(met)[1] if met else None)
    numbers = {r.i: r.n for r in rewrites.numbered(lt, ["k"], ["t", "i"], "n", rows=rows).collect()}
    for k in ("hot", "x", None):
        own = sorted((x for x in left if x[1] == k), key=lambda x: (x[2] is None, x[2] or 0, x[0]))
        assert [numbers[i] for i, _, _ in own] == list(range(1, len(own) + 1))


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "decimal(9,2)"])
def test_ranges_of_any_ordered_kind(spark, kind):
    df = spark.range(100).select((F.col("id") if kind.startswith("dec") else F.expr("date'2020-01-01' + cast(id as int)")).cast(kind).alias("x"), "id")
    got = df.select("id", special_joins.ranges_of(df, "x", 10).alias("p")).orderBy("id").collect()
    assert [r.p for r in got] == sorted(r.p for r in got) and 5 <= len({r.p for r in got}) <= 15


def test_lag_by_default(spark):
    df = spark.createDataFrame([(1, 10, 1), (2, 20, 1), (3, None, 1), (4, 40, 1), (5, 50, None)], "k int, v int, o int").withColumn("g", F.lit(1))
    got = {r.k: r.b for r in rewrites.lag_by(df, ["g"], ["k"], "v", "o", "b", default=-1).collect()}
    assert got == {1: -1, 2: 10, 3: 20, 4: None, 5: None}


@pytest.mark.parametrize("width", [1.0, 3.0, 100.0])
def test_range_join(spark, width):
    left = [(i, i * 1.5 - 4, i * 1.5 - 4 + i % 4) for i in range(20)]
    right = [(i, i * 2.0 - 9, i * 2.0 - 7) for i in range(15)]
    lt, rt = spark.createDataFrame(left, "i int, a double, b double"), spark.createDataFrame(right, "j int, c double, d double")
    got = sorted((r.i, r.j) for r in special_joins.range_join(lt, rt, "a", "b", "c", "d", width).collect())
    assert got == sorted((i, j) for i, a, b in left for j, c, d in right if a <= d and c <= b)


def test_as_of_takes_the_latest_before(spark):
    left = spark.createDataFrame([("u", 5), ("u", 1), ("w", 9)], "k string, t int")
    right = spark.createDataFrame([("u", 2, "a"), ("u", 5, "b"), ("u", 7, "c")], "k string, s int, v string")
    got = sorted(map(tuple, special_joins.as_of(left, right, ["k"], "t", "s", "v", "v_at").collect()))
    assert got == [("u", 1, None), ("u", 5, "b"), ("w", 9, None)]


def test_fixed_point_stops_on_a_cycle(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (5, 6)], "a int, b int")
    seed = spark.createDataFrame([(0,)], "x int")
    got = rewrites.fixed_point(seed, lambda r: r.join(e, r.x == e.a).select(F.col("b").alias("x")))
    assert sorted(r.x for r in got.collect()) == [0, 1, 2]


def test_grouping_sets_of_an_empty_table(spark):
    none = spark.createDataFrame([], "a int, b int, v int")
    aggs = [F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")]
    assert rewrites.grouping_sets(none, [["a"], ["b"]], aggs).count() == 0
    assert rewrites.grouping_sets(none, [["a"], []], aggs).count() == 1
    assert rewrites.grouping_sets(none, [["a"], [], [], []], aggs).count() == 3


def test_lockstep_pads_and_drops(spark):
    df = spark.createDataFrame([(1, [1, 2], [5]), (2, None, None), (3, [], [7])], "k int, x array<int>, y array<int>")
    got = sorted(map(tuple, rewrites.lockstep(df, {"a": F.col("x"), "b": F.col("y")}, ["k"]).collect()), key=repr)
    assert got == sorted([(1, 1, 5), (1, 2, None), (3, None, 7)], key=repr)


def test_sampling_rules(spark):
    df = spark.range(1000)
    with pytest.raises(ValueError):
        tablesample(df, "bernoulli", 101.0, key=["id"])
    with pytest.raises(ValueError):
        tablesample(df, "bernoulli", None, key=["id"])
    with pytest.raises(ValueError):
        tablesample(df, "system_rows", -1)
    with pytest.raises(ValueError):
        tablesample(df, "unknown", 1)
    a = tablesample(df, "bernoulli", 30.0, key=["id"], seed=4)
    b = tablesample(df.repartition(7), "bernoulli", 30.0, key=["id"], seed=4)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and 200 < a.count() < 400
    assert tablesample(df, "system_rows", 5000).count() == 1000
    assert tablesample(df, "system_time", 50).count() <= 1000


def test_dml_nulls(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "k int, v string")
    kept, gone = dml.delete(t, F.col("v") == "a")
    assert kept.count() == 2 and gone.count() == 1
    new, changed = dml.update(t, F.col("k") > 1, {"v": F.lit("z")})
    assert new.count() == 3 and [r.v for r in changed.collect()] == ["z"]
    ins, _ = dml.insert_ignore(t, spark.createDataFrame([(1, "x"), (9, "y"), (9, "w"), (None, "q")], "k int, v string"), ["k"])
    assert sorted(map(tuple, ins.collect()), key=repr) == sorted([(1, "a"), (2, None), (None, "c"), (9, "w"), (None, "q")], key=repr)


def test_user_aggregate_on_nulls(spark):
    from loomql.operators.aggregates import Aggregate

    total = Aggregate(lambda: [0.0], lambda s, x: [s[0] + float(x.sum())], lambda a, b: [a[0] + b[0]], lambda s: s[0])
    df = spark.createDataFrame(pd.DataFrame({"g": [1, 1, 2], "v": [1.0, 2.0, None]}))
    assert sorted(map(tuple, total.group(df, ["g"], "v", "s").collect())) == [(1, 3.0), (2, 0.0)]


def test_counted_join_counts_both_sides(spark):
    a, b = spark.range(4).toDF("x"), spark.range(6).toDF("y")
    out, seen = special_joins.counted_join(a, b, lambda p, q: p.x > q.y)
    assert len(out.collect()) == 6
    assert [seen[n].get["rows"] for n in ("left", "right", "found")] == [4, 6, 6]


def test_progressive_policies_give_every_pair_once(spark):
    a, b = spark.range(40).toDF("x"), spark.range(30).toDF("y")
    want = {(i, j) for i in range(4) for j in range(3)}
    for policy in progressive.POLICIES:
        parts = list(progressive.progressive_join(a, b, lambda p, q: p.x == q.y, 4, 3, policy, must_explore=2, left_cache=1, right_cache=1, least=2, most=1))
        assert {p for p, _, _ in parts} == want and len(parts) == len(want), policy
        assert sum(n for _, n, _ in parts) == 30 and progressive.collect_progressive(iter(parts)).count() == 30
    with pytest.raises(ValueError):
        next(progressive.progressive_join(a, b, lambda p, q: p.x == q.y, 2, 2, "unknown"))


def test_sorted_progressive_join_comes_in_key_order(spark):
    a = spark.range(100).selectExpr("id AS k", "id AS v")
    b = spark.range(50, 150).selectExpr("id AS k", "id AS w")
    got = [sorted(r.k for r in rows.collect()) for _, _, rows in progressive.sorted_progressive_join(a, b, ["k"], 4)]
    assert sum(got, []) == list(range(50, 100))


def test_cursor(spark):
    cur = Cursor(spark.range(10).toDF("k"), ["k"])
    keys = lambda df: sorted(r.k for r in df.collect())
    assert keys(cur.fetch(3)) == [0, 1, 2] and keys(cur.fetch(0)) == [2] and keys(cur.fetch(-2)) == [0, 1]
    assert cur.at == 1 and cur.move(4) == 4 and keys(cur.fetch(1)) == [5]
    assert keys(cur.fetch(None)) == [6, 7, 8, 9] and cur.at == 11 and keys(cur.fetch(1)) == []
    assert cur.move(-3) == 3 and keys(cur.fetch(0)) == [7] and keys(cur.absolute(-1)) == [9] and keys(cur.fetch(-99)) == list(range(9))
    cur.close()
    with pytest.raises(ValueError):
        cur.fetch(1)


def test_stored_copies(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (9, "d")], "k int, v string")
    parts = sinks.list_partitioned(df, "k", {"low": [1, 2], "none": [None]}, "t", "rest")
    assert {r.v: r.part for r in parts.collect()} == {"a": "low", "b": "low", "c": "none", "d": "rest"}
    with pytest.raises(Exception, match="no partition"):
        sinks.list_partitioned(df, "k", {"low": [1]}, "t").count()
    assert sorted(r.id for r in sinks.with_identity(df.repartition(3), "id", 5, -2).collect()) == [-1, 1, 3, 5]
    assert sinks.create_table_as(df, "copy_of_df", False).count() == 0 and spark.table("copy_of_df").columns == ["k", "v"]
    odd = spark.createDataFrame([("<a&b>", None)], "x string, y string")
    assert sinks.rows_to_xml(odd, nulls=True).first()[0] == '<row><x>&lt;a&amp;b&gt;</x><y xsi:nil="true"/></row>'


def test_upsert_rejects_a_key_given_twice(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError):
        dml.upsert(t, spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), ["k"], ["v"])
    twice_null = spark.createDataFrame([(None, "x"), (None, "y")], "k int, v string")
    assert dml.upsert(t, twice_null, ["k"], ["v"]).count() == 3


def test_hierarchy_of_any_depth(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(12)] + [(50, 51), (51, 50)], "k int, p int")
    rows = {r.k: r.level for r in reshaping.connect_by(chain, "k", "p", 0, "~").collect()}
    assert rows == {i: i for i in range(12)}
    assert reshaping.connect_by(chain, "k", "p", 0, "~", max_depth=2).count() == 3
    assert {r.branch for r in reshaping.connect_by(chain, "k", "p", 50, "~").collect()} == {"50", "50~51"}


def test_plans(spark):
    buckets = [sinks.bucketed(spark.range(100).toDF("k"), ["k"], 4, n) for n in ("left_side", "right_side")]
    joined = buckets[0].hint("merge").join(buckets[1], "k")
    assert "SortMergeJoin" in explain.nodes(joined) and "Exchange" not in explain.nodes(joined)
    for form in ("text", "json", "yaml", "xml"):
        assert "SortMergeJoin" in explain.explain(joined, form, analyze=form == "text")
    with pytest.raises(ValueError):
        explain.explain(joined, "html")


def test_foreign_filters_are_sent(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE t (a INTEGER, b TEXT)")
        con.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"v{i % 3}") for i in range(50)] + [(None, None)])
    df = foreign.foreign_table(spark, path, "SELECT * FROM t ORDER BY rowid", "a int, b string", parts=7)
    assert df.count() == 51 and df.where("a > 40 AND b = 'v1'").count() == 3 and df.where("b IS NULL").count() == 1
    reader = foreign.ForeignReader({"path": path, "query": "SELECT * FROM t"}, ["a", "b"])
    kept = list(reader.pushFilters([foreign.EqualTo(("b",), "v1"), foreign.GreaterThan(("a",), None)]))
    assert reader.sent == [("b", "=", "v1")] and len(kept) == 1


def test_stages_are_deleted(spark):
    with stages(spark) as outer:
        with stages(spark) as inner:
            a, b = durable(spark.range(3), "a"), durable(spark.range(4), "b")
            inner.keep(b)
        assert b.count() == 4 and len(outer.paths) == 1
        with pytest.raises(Exception):
            a.select(F.col("id") + 1).collect()
    assert not os.path.exists(outer.paths[0].removeprefix("file://"))


def test_integers_that_do_not_fit_raise(spark):
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        spark.sql("SELECT CAST(40000 AS SMALLINT)").collect()
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        spark.sql("SELECT 2147483647 + a FROM VALUES (1) v(a)").collect()


def test_a_generator_inside_an_expression_raises(spark):
    with pytest.raises(Exception, match="GENERATOR"):
        spark.sql("SELECT CASE WHEN true THEN explode(array(1, 2)) END").collect()
