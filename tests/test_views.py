import pytest
from pyspark.sql import functions as F

from factgate.operators import facts, footprint, stats
from factgate.plans.plan import Aggregate, Filter, Order, Plan, PlanError, Rule, output_type
from factgate.sources import products, views
from factgate.sources.views import View

O = {"orders": "orders"}  # noqa: E741


def test_stacks_that_are_refused(spark, sf):
    deep = {f"v{k}": View(f"v{k}", f"v{k - 1}" if k else "orders", ("o_orderkey",)) for k in range(20)}
    with pytest.raises(PlanError):
        views.stack(deep, "v19")
    assert len(views.stack(deep, "v15")) == 16
    loop = {"a": View("a", "b", ("o_orderkey",)), "b": View("b", "a", ("o_orderkey",))}
    with pytest.raises(PlanError):
        views.stack(loop, "a")
    two = {"g": View("g", "orders", group_by=("o_custkey",), aggregates=(("count", "*", "n"),)), "h": View("h", "g", group_by=("n",), aggregates=(("count", "*", "m"),))}
    with pytest.raises(PlanError):
        views.stack(two, "h")
    with pytest.raises(PlanError):
        views.query_view(spark, sf, two, "g", View("q", "", ("n",), (Filter("n", ">", 3),)))
    with pytest.raises(PlanError):
        views.compiled(spark, sf, {"a": View("a", "orders", ("o_orderkey",)), "b": View("b", "a", ("o_custkey",))}, "b")
    assert views.lineage(two, "g", "n") == [] and views.lineage({"a": View("a", "orders", ("o_orderkey",), (Filter("o_custkey", ">", 1),))}, "a", "o_orderkey") == ["o_custkey", "o_orderkey"]


def test_free_sql_is_held_in(spark, sf):
    views.scoped_view(spark, sf, "customer", ("c_custkey", "c_name"), {"segment": Rule("not_in", ("BUILDING",))}, "fg_held")
    assert views.functions_of(spark, "SELECT upper(c_name), sum(c_custkey) FROM fg_held GROUP BY 1") == ["sum", "upper"]
    assert views.run_scoped(spark, "SELECT c_custkey FROM fg_held", 7).count() == 7
    for bad in ("SELECT reflect('java.lang.System', 'exit', 0) FROM fg_held", "SELECT java_method('x', 'y') FROM fg_held", "SELECT c_custkey FROM fg_held WHERE length(hex(c_name)) > 1"):
        with pytest.raises(PermissionError):
            views.run_scoped(spark, bad, 7)
    assert views.run_scoped(spark, "SELECT hex(c_name) AS h FROM fg_held", 7, ("hex",)).count() == 7
    with pytest.raises(Exception, match="c_acctbal"):
        views.run_scoped(spark, "SELECT c_acctbal FROM fg_held", 7)
    with pytest.raises(PlanError):
        views.scoped_view(spark, sf, "customer", ("c_secret",), {}, "fg_none")


@pytest.mark.parametrize("limit, offset", [(2, 0), (2, 1), (0, 4)])
def test_pages_of_groups_expose_what_they_deliver(spark, sf, limit, offset):
    keys = ("orders.o_orderpriority",)
    plan = Plan(O, keys, group_by=keys, aggregates=(Aggregate("count", "*", "n"),), order_by=(Order("orders.o_orderpriority"),), limit=limit, offset=offset)
    held = [r[0] for r in products.load(spark, sf, "orders").groupBy("o_orderpriority").count().orderBy(F.col("o_orderpriority").asc_nulls_last()).collect()][offset : offset + limit if limit else None]
    members = products.load(spark, sf, "orders").where(F.col("o_orderpriority").isin(held)).count()
    assert facts.influence(spark, sf, plan).count() == 2 * members
    assert facts.release(spark, sf, plan).count() == 2 * len(held)
    total = Plan(O, aggregates=(Aggregate("count", "*", "n"),), limit=1, offset=1)
    assert facts.influence(spark, sf, total).isEmpty() and facts.release(spark, sf, total).isEmpty()


def test_different_questions_have_different_keys():
    eq = lambda c, v, op="=": Filter(f"orders.{c}", op, v)
    plans = [
        Plan(O, ("orders.o_orderkey",), filters=(eq("o_orderstatus", "F"), eq("o_orderpriority", "x"))),
        Plan(O, ("orders.o_orderkey",), filters=(eq("o_orderpriority", "x;orders.o_orderstatus = F"),)),
        Plan(O, ("orders.o_orderkey",), filters=(eq("o_orderstatus", ("a", "b"), "in"),)),
        Plan(O, ("orders.o_orderkey",), filters=(eq("o_orderstatus", "a"), eq("o_orderstatus", "b"))),
        Plan(O, ("orders.o_orderkey",), filters=(eq("o_orderstatus", ("a,b",), "in"),)),
        Plan(O, ("orders.o_orderkey",), filters=(eq("o_orderstatus", "null"),)),
        Plan(O, ("orders.o_orderkey",), filters=(eq("o_orderstatus", None),)),
        Plan(O, ("orders.o_orderkey",), limit=1, offset=12),
        Plan(O, ("orders.o_orderkey",), limit=11, offset=2),
    ]
    assert len({footprint.plan_text(p) for p in plans}) == len(plans)
    scopes = [{"status": "F"}, {"status": "F\nordered=x"}, {"status": "F", "ordered": "x"}, {"status": ["F"]}, {}]
    assert len({footprint.context(plans[0], s) for s in scopes}) == len(scopes)


def test_logged_questions_have_different_keys(spark):
    schema = "query_id long, product string, columns array<string>, aggregates array<string>, filters array<struct<col: string, op: string, values: array<string>>>, group_by array<string>, limit int, offset int"
    log = lambda k, columns, filters: (k, "p", columns, [], filters, [], 0, 0)
    rows = [log(1, ["a", "b"], []), log(2, ["a,b"], []), log(3, [], [("c", "=", ["x"])]), log(4, [], [("c", "=", [None])]), log(5, [], [("c", "=", ["null"])]), log(6, [], [("c", "in", ["x", "y"])]), log(7, [], [("c", "in", ["x,y"])]), log(8, [], [("c =", "=", ["x"])])]
    keys = footprint.log_plan_keys(spark.createDataFrame(rows, schema)).collect()
    assert len({r.plan_key for r in keys}) == len(rows)


def test_null_is_no_text(spark):
    a, b = spark.createDataFrame([(1, None)], "k long, v string"), spark.createDataFrame([(1, "null")], "k long, v string")
    assert tuple(stats.equal_unordered(a, b).first()) == (1, 1)
    assert stats.content_digest(a).first().digest != stats.content_digest(b).first().digest


def test_sums_keep_their_scale():
    products.PRODUCTS["scaled"] = products.Product("scaled", "scaled", ("k",), {"k": "bigint", "x": "decimal(12,4)"}, "test.scaled")
    try:
        assert output_type(Plan({"s": "scaled"}, aggregates=(Aggregate("sum", "s.x", "t"),)), Aggregate("sum", "s.x", "t")) == "decimal(38,4)"
    finally:
        del products.PRODUCTS["scaled"]


def test_jdbc_snapshot(spark, sf, tmp_path):
    """A table over JDBC, read by several tasks; the embedded database comes with Spark."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    c = products.load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    c.write.jdbc(url, "customers", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    got = products.read_jdbc(spark, url, "customers", "C_CUSTKEY", 1, c.count(), 3, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert got.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, c.collect()))


def test_bootstrap_against_a_loop(spark):
    import struct

    import numpy as np
    import xxhash

    values = [float(x) for x in (3, 1, 4, 1, 5, 9, 2, 6)]
    got = stats.bootstrap_median(spark.createDataFrame([(v,) for v in values], "x double"), "x", 40)
    ordered, medians = sorted(values), []
    fold = lambda seed, raw: xxhash.xxh64_intdigest(raw, seed)
    for resample in range(1, 41):
        at = [fold(fold(fold(42, struct.pack("<i", resample)), struct.pack("<q", k)), struct.pack("<i", 1)) for k in range(len(values))]
        at = [(x - (1 << 64) if x >> 63 else x) % len(values) for x in at]
        medians.append(np.median([ordered[k] for k in at]))
    assert np.allclose(tuple(got.first()), (np.quantile(medians, 0.025), np.quantile(medians, 0.975)))


def test_literals_are_compared_as_values():
    ask = lambda c, v, op="=": Plan(O, ("orders.o_orderkey",), filters=(Filter(f"orders.{c}", op, v),))
    same = [("o_totalprice", (50000, "50000.00", "5E4", "050000.0")), ("o_orderdate", ("1995-01-01", "1995-01-01T00:00:00")), ("o_orderkey", (7, "7", "007"))]
    for column, values in same:
        assert len({footprint.plan_text(ask(column, v)) for v in values}) == len({tuple(footprint.atoms_of(ask(column, v))) for v in values}) == 1
    assert len({footprint.plan_text(ask("o_orderstatus", v)) for v in ("7", "7.0", "null", None)}) == 4
    assert footprint.plan_text(ask("o_totalprice", (1, "1.0", 2), "in")) == footprint.plan_text(ask("o_totalprice", ("2.00", 1), "in"))


def test_null_literals_in_a_log(spark):
    schema = "query_id long, filters array<struct<col: string, op: string, values: array<string>>>"
    log = spark.createDataFrame([(1, [("c", "=", [None])]), (2, [("c", "=", ["null"])]), (3, [("c", "=", ["1.0"])]), (4, [("c", "=", ["1"])])], schema)
    sets = {r.query_id: r.digest for r in footprint.log_predicate_sets(log).collect()}
    assert len(set(sets.values())) == 4 and all(sets.values())
    sets = {r.query_id: r.digest for r in footprint.log_predicate_sets(footprint.typed(log, {"c": "decimal(9,2)"})).collect()}
    assert sets[3] == sets[4] and len(set(sets.values())) == 3


def test_questions_over_views_that_are_refused():
    v = {"a": View("a", "orders", ("o_orderkey", "o_custkey")), "g": View("g", "a", group_by=("o_custkey",), aggregates=(("count", "*", "n"),))}
    assert views.composed(v, "a", View("q", "", ("o_orderkey",))).columns == ("orders.o_orderkey",)
    for top, q in (("a", View("q", "", ("o_totalprice",))), ("g", View("q", "", ("n",), (Filter("n", ">", 2),))), ("g", View("q", "", ("o_custkey",))), ("g", View("q", "", ("o_orderkey",)))):
        with pytest.raises(PlanError):
            views.composed(v, top, q)

def test_bootstrap_median_meets_no_values_with_draws(spark):
    """Nulls are drawn but are no values; only the middle positions are looked up, so no group holds all that a resample drew."""
    import random

    from pyspark.sql import functions as F

    from factgate.operators import snapshots

    draw = random.Random(3)
    for n, nulls in ((1, 0), (2, 1), (501, 40), (1200, 0)):
        values = [None] * nulls + [float(draw.randrange(90)) for _ in range(n - nulls)]
        df = spark.createDataFrame([(v,) for v in values], "x double")
        got = stats.bootstrap_median(df, "x", 30)
        assert "percentile(x#" not in got._jdf.queryExecution().executedPlan().toString()
        rows = snapshots.numbered(df, ["x"], "at")
        picks = rows.select(F.col("at").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("resample")).select("resample", F.pmod(F.xxhash64("resample", "k", F.lit(1)), F.lit(n)).alias("at"))
        medians = picks.join(rows, "at").groupBy("resample").agg(F.percentile("x", 0.5).alias("m"))
        assert got.first() == medians.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi")).first()
