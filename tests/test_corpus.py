"""A small relation pair with nulls, repeats and a hidden key: expected sizes of every exposure were derived by hand."""

from decimal import Decimal

import pytest

from factgate.operators import facts, footprint, ledger
from factgate.plans.build import provenance, visible
from factgate.plans.plan import Aggregate, Filter, Join, Order, Plan, PlanError, validate
from factgate.sources import products
from factgate.sources.products import Product

ROWS = [("r01", "sales", 10), ("r02", "sales", 20), ("r03", "rnd", 30), ("r04", "sales", 10), ("r05", "ops", 5), ("r06", "ops", 35), ("r07", "rnd", 15), ("r08", "legal", 25), ("r09", "legal", 0), ("r10", None, 40), ("r11", "sales", None), ("r12", "sales", 40)]
HEADS = [("d01", "sales", "Ana"), ("d02", "rnd", "Rui"), ("d03", "ops", "Omar"), ("d04", "legal", "Lea")]
E_ = {"e": "expenses"}


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(k, d, None if a is None else Decimal(a)) for k, d, a in ROWS], "id string, department string, amount decimal(12,2)").write.parquet(f"{path}/expenses.parquet")
    spark.createDataFrame(HEADS, "id string, department string, manager string").write.parquet(f"{path}/departments.parquet")
    own = {
        "expenses": Product("expenses", "expenses", ("id",), {"id": "string", "department": "string", "amount": "decimal(12,2)"}, "travel.expense"),
        "departments": Product("departments", "departments", ("id",), {"id": "string", "department": "string", "manager": "string"}, "travel.department"),
    }
    products.PRODUCTS.update(own)
    yield path
    for name in own:
        del products.PRODUCTS[name]


def eq(column, value):
    return Filter(column, "=", value)


SUM, ITEMS = Aggregate("sum", "e.amount", "total"), Aggregate("count", "*", "items")
JOIN = Plan({"d": "departments", "e": "expenses"}, ("d.manager", "e.amount"), (Join((("d.department", "e.department"),)),))
CASES = {
    "projection_amount": (Plan(E_, ("e.amount",)), 12, 24),
    "projection_department": (Plan(E_, ("e.department",)), 12, 24),
    "projection_pair": (Plan(E_, ("e.department", "e.amount")), 24, 36),
    "selection_sales": (Plan(E_, ("e.amount",), filters=(eq("e.department", "sales"),)), 5, 15),
    "selection_missing": (Plan(E_, ("e.amount",), filters=(eq("e.department", "missing"),)), 0, 0),
    "group_sum_count": (Plan(E_, ("e.department",), group_by=("e.department",), aggregates=(SUM, ITEMS)), 15, 36),
    "group_hidden_key": (Plan(E_, group_by=("e.department",), aggregates=(SUM,)), 5, 36),
    "global_count": (Plan(E_, aggregates=(ITEMS,)), 1, 12),
    "global_count_column": (Plan(E_, aggregates=(Aggregate("count", "e.amount", "items"),)), 1, 24),
    "global_sum": (Plan(E_, aggregates=(SUM,)), 1, 24),
    "global_min": (Plan(E_, aggregates=(Aggregate("min", "e.amount", "lo"),)), 1, 24),
    "global_empty": (Plan(E_, filters=(eq("e.department", "missing"),), aggregates=(SUM, ITEMS)), 2, 0),
    "department_join": (JOIN, 15, 45),
    "page_first_four": (Plan(E_, ("e.department", "e.amount"), limit=4), 8, 12),
    "page_middle_five": (Plan(E_, ("e.department", "e.amount"), limit=5, offset=3), 10, 15),
    "page_order_boundary": (Plan(E_, ("e.amount", "e.department"), order_by=(Order("e.department"),), limit=1), 2, 3),
    "union_hidden_distinct": (Plan(E_, ("e.amount",), union=((eq("e.id", "r10"),), (eq("e.id", "r12"),)), distinct_on=("e.department", "e.amount")), 2, 8),
    "union_same_tuple": (Plan(E_, ("e.department", "e.amount"), union=((eq("e.id", "r01"),), (eq("e.id", "r04"),))), 2, 8),
}


@pytest.mark.parametrize("name", CASES)
def test_sizes(spark, base, name):
    plan, release, influence = CASES[name]
    assert facts.release(spark, base, plan).count() == release
    assert facts.influence(spark, base, plan).count() == influence


def test_visible_values(spark, base):
    got = {r.department: (r.total, r["items"]) for r in visible(spark, base, CASES["group_sum_count"][0]).collect()}
    assert got == {"sales": (Decimal(80), 5), "rnd": (Decimal(45), 2), "ops": (Decimal(40), 2), "legal": (Decimal(25), 2), None: (Decimal(40), 1)}
    assert [tuple(r) for r in visible(spark, base, CASES["global_empty"][0]).collect()] == [(None, 0)]
    assert sorted(r.amount for r in visible(spark, base, CASES["union_hidden_distinct"][0]).collect()) == [40, 40]
    first = visible(spark, base, CASES["page_order_boundary"][0]).first()
    assert (first.department, first.amount) == ("legal", 25)  # nulls come last


def test_overlapping_pages_make_the_whole(spark, base):
    pages = [facts.influence(spark, base, Plan(E_, ("e.department", "e.amount"), limit=n, offset=k)) for k, n in ((0, 5), (3, 5), (8, 4))]
    assert facts.merged(*pages).exceptAll(facts.influence(spark, base, Plan(E_, ("e.department", "e.amount")))).isEmpty()
    assert facts.merged(*pages).count() == 36


def test_split_selections_make_the_whole(spark, base):
    parts = [facts.release(spark, base, Plan(E_, ("e.amount",), filters=(Filter("e.amount", op, 20),))) for op in ("<", ">=")]
    assert facts.merged(*parts).count() == 11  # the null amount passes neither


def test_join_multiplicity(spark, base):
    w = {(r.output, r.n) for r in facts.witnesses(provenance(spark, base, multi()), multi()).collect()}
    assert ("items", 5) in w and ("items", 1) in w  # a department's row testifies once for each of its expenses


def multi():
    return Plan({"d": "departments", "e": "expenses"}, ("d.manager",), (Join((("d.department", "e.department"),)),), group_by=("d.manager",), aggregates=(ITEMS,))


def test_long_lists_are_joined(spark, base):
    known = tuple(f"r{k:02d}" for k in range(1, 6)) + tuple(f"x{k}" for k in range(300))
    ids = lambda op, v: sorted(r.id for r in visible(spark, base, Plan(E_, ("e.id",), filters=(Filter("e.id", op, v),))).collect())
    assert ids("in", known) == [f"r{k:02d}" for k in range(1, 6)]
    assert ids("not_in", known) == [f"r{k:02d}" for k in range(6, 13)]
    assert ids("not_in", (*known, None)) == []


def test_equal_questions_share_a_key(spark, base):
    f = (eq("e.department", "sales"), Filter("e.amount", ">", 5), Filter("e.id", "in", ("r02", "r01", "r01")))
    a, b = Plan(E_, ("e.amount", "e.id"), filters=f), Plan(E_, ("e.id", "e.amount"), filters=(Filter("e.id", "in", ("r01", "r02")), *f[1::-1]), aliases={"e.id": "x"})
    assert footprint.plan_text(a) == footprint.plan_text(b)
    assert len(footprint.atoms_of(a)) == 4
    assert facts.observation(spark, base, a).exceptAll(facts.observation(spark, base, b)).isEmpty()


def test_questions_without_answers_are_charged_apart(spark, base):
    ask = lambda v: footprint.outcome(spark, Plan(E_, ("e.amount",), filters=(eq("e.department", v),)))
    assert ask("nowhere").exceptAll(ask("elsewhere")).count() == 2


@pytest.mark.parametrize(
    "plan",
    [
        Plan(E_, ("e.nothing",)),
        Plan({"e": "unknown"}, ("e.id",)),
        Plan(E_, ("e.id", "e.id")),
        Plan(E_, ()),
        Plan(E_, ("e.id",), filters=(Filter("e.amount", "like", "1%"),)),
        Plan(E_, ("e.id",), filters=(Filter("e.amount", "=", 1.5),)),
        Plan(E_, ("e.id",), filters=(Filter("e.amount", "=", "ten"),)),
        Plan(E_, ("e.id",), filters=(Filter("e.id", "in", ()),)),
        Plan(E_, ("e.id",), filters=(Filter("e.id", "~", "x"),)),
        Plan(E_, ("e.id",), aggregates=(ITEMS,)),
        Plan(E_, ("e.department",), group_by=("e.department",)),
        Plan(E_, aggregates=(Aggregate("sum", "e.department", "x"),)),
        Plan(E_, aggregates=(Aggregate("avg", "e.amount", "x"),)),
        Plan(E_, ("e.id",), order_by=(Order("e.amount"),)),
        Plan(E_, ("e.id",), limit=-1),
        Plan({"a": "expenses", "b": "expenses"}, ("a.id",)),
        Plan({"d": "departments", "e": "expenses"}, ("e.id",)),
        Plan({"d": "departments", "e": "expenses"}, ("e.id",), (Join((("d.department", "e.amount"),)),)),
    ],
)
def test_bad_plans_are_refused(spark, base, plan):
    with pytest.raises(PlanError):
        validate(plan)


def test_observation_settles_once(spark, base):
    from pyspark.sql import functions as F

    one = facts.observation(spark, base, JOIN)
    stream = one.select(F.lit("r").alias("root"), F.lit(1).alias("seq"), "dim", "fact_hash").unionByName(one.select(F.lit("r").alias("root"), F.lit(2).alias("seq"), "dim", "fact_hash"))
    caps = spark.createDataFrame([("r", 15, 45, 1)], "root string, max_release long, max_influence long, max_outcome long")
    got = sorted(tuple(r) for r in ledger.settle(stream, caps).collect())
    assert got == [("r", 1, True, 15, 45, 1), ("r", 2, True, 0, 0, 0)]
