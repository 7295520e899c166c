"""Ways around a meter: pages, spellings, splits and thresholds, each settled step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.sequences import Step, replayed
from ..plans.plan import Aggregate, Filter, Order, Plan
from . import query
from .tables import ORDERS

O = {"orders": "orders"}  # noqa: E741
SHOWN = ("orders.o_orderkey", "orders.o_totalprice")


def page(limit: int, offset: int = 0) -> Plan:
    return Plan(O, SHOWN, order_by=(Order("orders.o_orderkey"),), limit=limit, offset=offset)


def where(op: str, value: object, **more) -> Plan:
    return Plan(O, SHOWN, filters=(Filter("orders.o_totalprice", op, value),), **more)


def count(value: object) -> Plan:
    return Plan(O, filters=(Filter("orders.o_totalprice", ">=", value),), aggregates=(Aggregate("count", "*", "n"),))


PAGES = [("page 1", page(2)), ("page 2", page(2, 2)), ("page 3", page(2, 4)), ("overlap", page(2, 1)), ("page 1 again", page(2))]
WHOLE, LOW, HIGH = ("complete", where(">=", 0)), ("low", where("<", 150000)), ("high", where(">=", 150000))
SEQUENCES = {
    "complete to pages": [("complete", page(100)), *PAGES],
    "pages to complete": [*PAGES, ("complete", page(100))],
    "spellings": [("plain", where(">=", 100000)), ("decimals", where(">=", "100000.00")), ("alias", where(">=", "1E5", aliases={"orders.o_totalprice": "price"}))],
    "complete to split": [WHOLE, LOW, HIGH],
    "split to complete": [LOW, HIGH, WHOLE],
    "thresholds": [("count 100000", count(100000)), ("count 200000", count(200000)), ("detail 200000", where(">=", 200000)), ("detail again", where(">=", 200000)), ("count 400000", count(400000))],
}
STEPS = [Step(s, name, plan) for s, steps in SEQUENCES.items() for name, plan in steps]

#: By hand: (release, influence, outcome) of each step. A page shows two cells and depends on the row, too; a test adds its literal.
COSTS = {
    "complete to pages": [("2 * top", "3 * top", 1), *[("0", "0", 1)] * 4, ("0", "0", 0)],
    "pages to complete": [*[("4", "6", 1)] * 3, ("0", "0", 1), ("0", "0", 0), ("2 * (top - 6)", "3 * (top - 6)", 1)],
    "spellings": [("2 * a", "3 * a", 2), ("0", "0", 0), ("0", "0", 0)],
    "complete to split": [("2 * n", "3 * n", 2), ("0", "0", 2), ("0", "0", 2)],
    "split to complete": [("2 * low", "3 * low", 2), ("2 * (n - low)", "3 * (n - low)", 2), ("0", "0", 2)],
    "thresholds": [("1", "2 * a", 2), ("CAST(b <> a AS BIGINT)", "0", 2), ("2 * b", "b", 1), ("0", "0", 0), ("CAST(c <> b AND c <> a AS BIGINT)", "0", 2)],
}
NUMBERS = f"(SELECT count(*) AS n, least(100, count(*)) AS top, count(*) FILTER (o_totalprice >= 100000) AS a, count(*) FILTER (o_totalprice >= 200000) AS b, count(*) FILTER (o_totalprice >= 400000) AS c, count(*) FILTER (o_totalprice < 150000) AS low FROM {ORDERS})"


@query(" UNION ALL ".join(f"SELECT '{s}' AS root, CAST({k} AS BIGINT) AS seq, '{SEQUENCES[s][k][0]}' AS step, CAST({r} AS BIGINT) AS charged_release, CAST({i} AS BIGINT) AS charged_influence, CAST({o} AS BIGINT) AS charged_outcome FROM {NUMBERS}" for s, costs in COSTS.items() for k, (r, i, o) in enumerate(costs)))
def attack_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """What every step of six sequences is charged: however the same facts are asked for, they are charged once, and every new question once."""
    return replayed(spark, sf, STEPS).drop("accepted")
