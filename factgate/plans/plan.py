"""Declarative query plans: what to read, join, filter, group, order and page; validated before anything runs."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal, InvalidOperation

from ..sources.products import PRODUCTS, Product

OPERATORS = ("=", "<>", "!=", "<", "<=", ">", ">=", "like", "in", "not_in", "is_null", "is_not_null")
MOST_LITERALS, MOST_SOURCES = 20_000, 16
EXACT = ("smallint", "int", "bigint", "decimal")
ORDERED = EXACT + ("string", "date", "timestamp", "timestamp_ntz")


class PlanError(ValueError):
    """A plan that must not run."""


@dataclass(frozen=True)
class Filter:
    """``role.column op value``; a leaf filter belongs to its scan, an outer one to the joined rows."""

    column: str
    op: str
    value: object = None
    leaf: bool = True


@dataclass(frozen=True)
class Rule:
    """A mandatory scope: one of OPERATORS and its value, for a list of values, or nothing."""

    op: str
    value: object = None


@dataclass(frozen=True)
class Join:
    """Equalities between two roles: pairs of (left role.column, right role.column)."""

    on: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: str
    name: str


@dataclass(frozen=True)
class Order:
    column: str
    descending: bool = False


@dataclass(frozen=True)
class Plan:
    """``sources`` maps roles to products. ``limit`` 0 means none. ``union`` holds the filters of each branch of a distinct union,

    ``distinct_on`` the columns by which its rows are told apart (the shown ones if none are given; hidden ones may be more).
    """

    sources: dict[str, str]
    columns: tuple[str, ...] = ()
    joins: tuple[Join, ...] = ()
    filters: tuple[Filter, ...] = ()
    group_by: tuple[str, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    order_by: tuple[Order, ...] = ()
    limit: int = 0
    offset: int = 0
    union: tuple[tuple[Filter, ...], ...] = ()
    distinct_on: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)

    @property
    def branches(self) -> tuple[tuple[Filter, ...], ...]:
        """The branches of a union; two with the same conjunction, in whatever order, are one."""
        return tuple({frozenset((f.column, f.op, repr(f.value)) for f in b): b for b in reversed(self.union)}.values())[::-1]

    @property
    def tuple_columns(self) -> tuple[str, ...]:
        return self.distinct_on or self.columns

    def product(self, column: str) -> tuple[Product, str]:
        role, _, name = column.partition(".")
        if role not in self.sources:
            raise PlanError(f"{column}: unknown source")
        p = PRODUCTS[self.sources[role]]
        if name not in p.columns:
            raise PlanError(f"{column}: not a column of {p.name}")
        return p, name

    def type_of(self, column: str) -> str:
        p, name = self.product(column)
        return p.columns[name]


def base(sql_type: str) -> str:
    return sql_type.split("(")[0]


def fits(value: object, sql_type: str) -> bool:
    """Whether a literal is of a column's type."""
    kind = base(sql_type)
    if isinstance(value, bool):
        return kind == "boolean"
    if kind in ("smallint", "int", "bigint"):
        bits = {"smallint": 15, "int": 31, "bigint": 63}[kind]
        return isinstance(value, int) and -(1 << bits) <= value < 1 << bits
    if kind == "decimal":
        try:
            return not isinstance(value, float) and Decimal(str(value)).is_finite()
        except InvalidOperation:
            return False
    if kind in ("date", "timestamp", "timestamp_ntz"):
        try:
            return isinstance(value, (date, datetime)) or bool(datetime.fromisoformat(str(value)))
        except ValueError:
            return False
    return isinstance(value, str)


def output_type(plan: Plan, a: Aggregate) -> str:
    """Type of an aggregate: counts are bigint, sums of whole numbers widen, minima and maxima keep the input's."""
    if a.function == "count":
        return "bigint"
    kind = plan.type_of(a.column)
    if a.function == "sum":
        whole = {"smallint": "bigint", "int": "bigint", "bigint": "decimal(38,0)"}
        return whole.get(base(kind)) or f"decimal(38,{kind.partition(',')[2].strip(' )') or 0})"
    return kind


def validate(plan: Plan) -> Plan:
    """The plan itself if it may run; raises PlanError otherwise."""
    if not 1 <= len(plan.sources) <= MOST_SOURCES:
        raise PlanError(f"between 1 and {MOST_SOURCES} sources are needed")
    for role, name in plan.sources.items():
        if name not in PRODUCTS:
            raise PlanError(f"unknown product {name}")
        if not role.isidentifier() or "__" in role:
            raise PlanError(f"bad role {role}")
    if len(set(plan.sources.values())) != len(plan.sources):
        raise PlanError("a product may be joined once only")
    if plan.limit < 0 or plan.offset < 0:
        raise PlanError("limit and offset must not be negative")
    if not plan.columns and not plan.aggregates:
        raise PlanError("nothing is selected")
    if plan.distinct_on and (not plan.union or not set(plan.columns) <= set(plan.distinct_on)):
        raise PlanError("what a union shows must be part of what tells its rows apart")
    for c in (*plan.columns, *plan.group_by, *plan.distinct_on):
        plan.product(c)
    for what, names in (("column", plan.columns), ("group key", plan.group_by), ("order", [o.column for o in plan.order_by]), ("name", [a.name for a in plan.aggregates])):
        if len(set(names)) != len(names):
            raise PlanError(f"repeated {what}")
    for f in (*plan.filters, *[f for b in plan.union for f in b]):
        kind = plan.type_of(f.column)
        if f.op not in OPERATORS:
            raise PlanError(f"operator {f.op} is not supported")
        if f.op in ("is_null", "is_not_null"):
            continue
        if f.op == "like" and base(kind) != "string":
            raise PlanError("like is for texts")
        values = f.value if f.op in ("in", "not_in") else [f.value]
        if not isinstance(values, (list, tuple)) or not 1 <= len(values) <= MOST_LITERALS:
            raise PlanError(f"between 1 and {MOST_LITERALS} literals are needed")
        bad = [v for v in values if v is not None and not fits(v, kind)]
        if bad:
            raise PlanError(f"{f.column}: {bad[0]!r} is not a {kind}")
    for a in plan.aggregates:
        if a.function not in ("count", "sum", "min", "max"):
            raise PlanError(f"aggregate {a.function} is not supported")
        if a.column == "*":
            if a.function != "count":
                raise PlanError(f"{a.function}(*) is not supported")
            continue
        p, _ = plan.product(a.column)
        if a.function not in p.aggregates:
            raise PlanError(f"{a.function} is not allowed over {p.name}")
        if base(plan.type_of(a.column)) not in {"sum": EXACT, "min": ORDERED, "max": ORDERED, "count": ORDERED + ("boolean", "binary")}[a.function]:
            raise PlanError(f"{a.function} over {plan.type_of(a.column)} is not exact")
    if plan.aggregates and not set(plan.columns) <= set(plan.group_by):
        raise PlanError("a selected column must be grouped")
    if plan.group_by and not plan.aggregates:
        raise PlanError("groups without an aggregate")
    shown = {*plan.columns, *(a.name for a in plan.aggregates)}
    for o in plan.order_by:
        if o.column not in shown:
            raise PlanError(f"order by {o.column}, which isn't selected")
    if plan.union:
        if len(plan.union) != 2 or len(plan.sources) != 1 or plan.aggregates:
            raise PlanError("a distinct union has two branches of one product and no aggregate")
    join_order(plan)
    return plan


def join_order(plan: Plan) -> list[tuple[str, list[tuple[str, str]]]]:
    """Roles in an order in which each is joined to those before it, with its equalities; the graph must be connected."""
    edges = []
    for j in plan.joins:
        if not j.on:
            raise PlanError("a join without a condition")
        sides = set()
        for a, b in j.on:
            if plan.type_of(a) != plan.type_of(b):
                raise PlanError(f"{a} and {b} have different types")
            sides.add(frozenset((a.partition(".")[0], b.partition(".")[0])))
        if len(sides) != 1 or len(next(iter(sides))) != 2:
            raise PlanError("a join connects two sources")
        edges.append((next(iter(sides)), j.on))
    left = sorted(plan.sources)
    out: list[tuple[str, list[tuple[str, str]]]] = [(left.pop(0), [])]
    while left:
        placed = {r for r, _ in out}
        for role in left:
            conds = [(a, b) if b.startswith(role + ".") else (b, a) for pair, on in edges if role in pair and pair - {role} <= placed for a, b in on]
            if conds:
                out.append((role, conds))
                left.remove(role)
                break
        else:
            raise PlanError("the joins don't connect all sources")
    return out
