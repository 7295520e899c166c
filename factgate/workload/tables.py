"""SQL of the products' typed columns, for the comparison queries."""

from __future__ import annotations

from ..functions.canonical import sql_canonical, sql_composite, sql_digest
from ..sources.products import PRODUCTS

MONEY = "CAST(round({0}, 2) AS DECIMAL(18,2)) AS {0}"
ORDERS = f"(SELECT o_orderkey, o_custkey, o_orderstatus, {MONEY.format('o_totalprice')}, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders)"
CUSTOMER = f"(SELECT c_custkey, c_name, c_nationkey, {MONEY.format('c_acctbal')}, c_mktsegment FROM customer)"
LINES = f"""(SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INTEGER) AS l_copy,
  l_partkey, l_suppkey, {MONEY.format('l_quantity')}, {MONEY.format('l_extendedprice')}, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem)"""
EVENTS = f"(SELECT event_id, ts, user_id, event_type, {MONEY.format('value')}, props FROM events)"


def key(product: str) -> str:
    p = PRODUCTS[product]
    return "(" + sql_composite(*[f"({sql_canonical(c, p.columns[c])})" for c in p.key]) + ")"


def row(product: str, key_: str | None = None) -> str:
    p = PRODUCTS[product]
    return sql_digest("'row'", f"'{p.namespace}'", f"'{p.snapshot}'", key_ or key(product))


def cell(product: str, column: str, key_: str | None = None) -> str:
    p = PRODUCTS[product]
    kind = p.columns[column].split("(")[0]
    return sql_digest("'cell'", f"'{p.namespace}'", f"'{p.snapshot}'", key_ or key(product), f"'{column}'", f"'{kind}'", f"({sql_canonical(column, p.columns[column])})")
