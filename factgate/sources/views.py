"""Views over products: column-restricted scoped ones for free SQL, and stacks of declared ones."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wide import check_allowed
from ..plans.build import apply_filter, scope_filters
from ..plans.plan import Aggregate, Filter, Plan, PlanError
from .products import PRODUCTS, scan
from .statements import FUNCTIONS as FUNCTIONS_ALLOWED
from .statements import check_shape, parsed

#: Views that may stand on one another.
DEEPEST = 16


def scoped_view(spark: SparkSession, sf_dir: str, product: str, columns: tuple[str, ...], scope: dict[str, object], view: str) -> DataFrame:
    """A temporary view with the approved columns of the rows within the mandatory scope, and nothing else."""
    unknown = set(columns) - set(PRODUCTS[product].columns)
    if unknown or not columns:
        raise PlanError(f"not columns of {product}: {', '.join(sorted(unknown)) or 'none given'}")
    plan = Plan({product: product}, tuple(f"{product}.{c}" for c in columns))
    held = reduce(lambda d, f: apply_filter(d, plan, f), scope_filters(plan, scope), scan(spark, sf_dir, product))
    out = held.select([F.col(f"{product}__{c}").alias(c) for c in columns])
    out.createOrReplaceTempView(view)
    _held.add(view.lower())
    return out


#: Names of the views that ``scoped_view`` has made.
_held: set[str] = set()


def functions_of(spark: SparkSession, sql: str) -> list[str]:
    """The functions that a statement names, as Spark's own parser reads it; the statement isn't analysed or run."""
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString()
    return sorted(set(re.findall(r"'([A-Za-z_][A-Za-z_0-9.]*)\(", parsed)))


def run_scoped(spark: SparkSession, sql: str, most: int, granted: tuple[str, ...] = ()) -> DataFrame:
    """A statement over scoped views: a query of known nodes over these views and nothing else, of allowed functions; at most ``most`` rows come.

    ``statements.authorize`` also follows which product each value comes from, in a session of its own.
    """
    check_shape(parsed(spark, sql), frozenset(_held), FUNCTIONS_ALLOWED | {f.lower() for f in granted})
    check_allowed([f.lower() for f in functions_of(spark, sql)], granted)
    return spark.sql(sql).limit(most)


@dataclass(frozen=True)
class View:
    """A declared view over a product or another view: filters, and either columns or groups with aggregates ((function, column, name), ...)."""

    name: str
    source: str
    columns: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    group_by: tuple[str, ...] = ()
    aggregates: tuple[tuple[str, str, str], ...] = ()


FUNCTIONS = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def stack(views: dict[str, View], top: str) -> list[View]:
    """A view and those below it, the lowest first. Stacks that are too deep, circular, or aggregate twice are refused."""
    out: list[View] = []
    at = top
    while at in views:
        if len(out) == DEEPEST or any(v.name == at for v in out):
            raise PlanError(f"{top}: the views form a cycle or are stacked too deep")
        out.append(views[at])
        at = views[at].source
    if at not in PRODUCTS:
        raise PlanError(f"{top}: {at} is neither a view nor a product")
    if sum(bool(v.aggregates) for v in out) > 1:
        raise PlanError(f"{top}: only one view of a stack may aggregate")
    return out[::-1]


def compiled(spark: SparkSession, sf_dir: str, views: dict[str, View], top: str) -> DataFrame:
    """The rows of a view, expanded down to its product; Catalyst flattens the stack."""
    levels = stack(views, top)
    product = levels[0].source if levels else top
    df = scan(spark, sf_dir, product, product)
    df = df.select([F.col(f"{product}__{c}").alias(c) for c in PRODUCTS[product].columns])
    for v in levels:
        df = applied(df, v)
    return df


def applied(df: DataFrame, v: View) -> DataFrame:
    kinds = dict(df.dtypes)
    lost = [c for c in (*v.columns, *v.group_by, *(f.column for f in v.filters), *(c for _, c, _ in v.aggregates if c != "*")) if c not in kinds]
    if lost:
        raise PlanError(f"{v.name}: {lost[0]} is not visible")
    for f in v.filters:
        value = lambda x: F.lit(x).cast(kinds[f.column])  # noqa: E731, B023
        c = F.col(f.column)
        simple = {"=": c == value(f.value), "<>": c != value(f.value), "<": c < value(f.value), "<=": c <= value(f.value), ">": c > value(f.value), ">=": c >= value(f.value)} if f.op in ("=", "<>", "<", "<=", ">", ">=") else {}
        simple |= {"is_null": c.isNull(), "is_not_null": c.isNotNull()}
        if f.op == "in":
            simple["in"] = c.isin(*[value(x) for x in f.value])
        if f.op not in simple:
            raise PlanError(f"{v.name}: {f.op} is not supported in a view")
        df = df.where(simple[f.op])
    if not v.aggregates:
        return df.select(*v.columns)
    aggs = [(F.count("*") if c == "*" else FUNCTIONS[f](c)).alias(n) for f, c, n in v.aggregates]
    return df.groupBy(*v.group_by).agg(*aggs)


def query_view(spark: SparkSession, sf_dir: str, views: dict[str, View], top: str, question: View) -> DataFrame:
    """A question asked of a view. Over a transparent stack it may filter and aggregate; over an aggregated one it may only pick columns."""
    if any(v.aggregates for v in stack(views, top)) and (question.filters or question.aggregates):
        raise PlanError(f"{top} is aggregated: only its columns can be picked")
    return applied(compiled(spark, sf_dir, views, top), replace(question, source=top))


def composed(views: dict[str, View], top: str, question: View) -> Plan:
    """A question over a view as a plan over the product below: its facts name base rows and cells, however many levels lie between.

    Levels are composed from the product upwards. What a level filters by testifies for every row above it. A level
    that aggregates is a barrier: what stands above it may pick its groups' keys and values, whose facts are derived ones
    of the base rows that took part.
    """
    levels = [*stack(views, top), replace(question, source=top)]
    product = levels[0].source if len(levels) > 1 else top
    role = lambda c: c if c == "*" else f"{product}.{c}"
    seen: tuple[str, ...] = tuple(PRODUCTS[product].columns)
    filters: list[Filter] = []
    keys: tuple[str, ...] = ()
    made: dict[str, Aggregate] = {}
    for v in levels:
        used = (*v.columns, *v.group_by, *(f.column for f in v.filters), *(c for _, c, _ in v.aggregates if c != "*"))
        lost = [c for c in used if c not in seen]
        if lost:
            raise PlanError(f"{v.name}: {lost[0]} is not visible")
        if made and (v.filters or v.aggregates):
            raise PlanError(f"{v.name}: only columns can be picked above an aggregate")
        filters += [replace(f, column=role(f.column)) for f in v.filters]
        if v.aggregates:
            keys, made = v.group_by, {n: Aggregate(f, role(c), n) for f, c, n in v.aggregates}
            seen = (*keys, *made)
        else:
            seen = v.columns
    if made and not any(c in made for c in seen):
        raise PlanError(f"{top}: at least one aggregate must be picked")
    plain = tuple(role(c) for c in seen if c not in made)
    return Plan({product: product}, plain, filters=tuple(filters), group_by=tuple(map(role, keys)), aggregates=tuple(made[c] for c in seen if c in made))


def lineage(views: dict[str, View], top: str, column: str) -> list[str]:
    """The product columns that a view's column is made of, filters included, found by composing the levels."""
    levels, wanted = stack(views, top), {column}
    for v in reversed(levels):
        made = {n: c for _, c, n in v.aggregates}
        if not wanted <= {*v.columns, *v.group_by, *made}:
            raise PlanError(f"{v.name}: {', '.join(sorted(wanted))} is not visible")
        wanted = {made.get(c, c) for c in wanted if made.get(c, c) != "*"} | {f.column for f in v.filters}
    return sorted(wanted)
