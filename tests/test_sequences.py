import pytest

from factgate.operators.sequences import Step, replayed
from factgate.plans.plan import Filter, Plan, PlanError

O = {"orders": "orders"}  # noqa: E741


def ask(op, value):
    return Plan(O, ("orders.o_orderkey",), filters=(Filter("orders.o_totalprice", op, value),))


def test_a_refused_step_teaches_nothing(spark, sf):
    n = spark.read.parquet(f"{sf}/orders.parquet").where("o_totalprice >= 150000").count()
    total = spark.read.parquet(f"{sf}/orders.parquet").count()
    steps = [Step("s", "all", ask(">=", 0)), Step("s", "high", ask(">=", 150000)), Step("s", "high, in decimals", ask(">=", "150000.00")), Step("t", "all", ask(">=", 0))]
    caps = spark.createDataFrame([("s", n, 3 * n, 9), ("t", total, 3 * total, 9)], "root string, max_release long, max_influence long, max_outcome long")
    got = [tuple(r) for r in replayed(spark, sf, steps, caps).orderBy("root", "seq").collect()]
    assert got == [("s", 0, "all", False, 0, 0, 0), ("s", 1, "high", True, n, 3 * n, 2), ("s", 2, "high, in decimals", True, 0, 0, 0), ("t", 0, "all", True, total, 3 * total, 2)]


def test_all_plans_are_judged_first(spark, sf):
    with pytest.raises(PlanError):
        replayed(spark, sf, [Step("s", "good", ask(">=", 0)), Step("s", "bad", ask("between", 0))])


def test_charges_by_sets_of_questions(spark, sf):
    """Joins, pages, distinct rows and groups: the same as facts charged one by one, with base facts shuffled as rows, not as hashes of each step."""
    from factgate.operators.ledger import charges
    from factgate.operators.sequences import first_charges, observed
    from factgate.plans.plan import Aggregate, Join, Order

    both = Plan({"orders": "orders", "customer": "customer"}, ("customer.c_name", "orders.o_totalprice"), (Join((("orders.o_custkey", "customer.c_custkey"),)),), (Filter("orders.o_orderstatus", "=", "P"),))
    page = Plan(O, ("orders.o_orderkey", "orders.o_totalprice"), order_by=(Order("orders.o_orderkey"),), limit=7, offset=3)
    groups = Plan(O, ("orders.o_orderstatus",), filters=(Filter("orders.o_totalprice", ">=", 100000),), group_by=("orders.o_orderstatus",), aggregates=(Aggregate("count", "*", "n"),))
    plain = [Step("s", "page", page), Step("s", "join", both), Step("s", "groups", groups), Step("s", "low", ask("<", 150000)), Step("t", "low", ask("<", 150000)), Step("t", "join", both), Step("t", "again", both)]
    distinct = Plan(O, ("orders.o_orderstatus", "orders.o_orderdate"), union=((Filter("orders.o_totalprice", "<", 50000),), (Filter("orders.o_totalprice", ">", 300000),)))
    for steps in (plain, [*plain, Step("s", "distinct", distinct), Step("t", "distinct", distinct)]):
        want = charges(observed(spark, sf, steps)).where("charged > 0").select("root", "seq", "dim", "charged")
        assert sorted(map(tuple, first_charges(spark, sf, steps).collect())) == sorted(map(tuple, want.collect()))
    assert replayed(spark, sf, []).isEmpty()
