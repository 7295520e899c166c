"""DataFrames of a plan: the visible result, and next to it the provenance, one row per proof of a result row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.products import PRODUCTS, scan
from .plan import Filter, Plan, Rule, join_order, output_type, validate

#: Literal lists longer than this are joined instead of written into the filter.
LONG_LIST = 200


#: Scans a product under a role: (session, place, product, role).
Reader = Callable[[SparkSession, str, str, str], DataFrame]


def name(column: str) -> str:
    return column.replace(".", "__")


def condition(plan: Plan, f: Filter) -> Column:
    """A filter as an expression; unknown keeps no row."""
    kind, c = plan.type_of(f.column), F.col(name(f.column))
    lit = lambda v: F.lit(v).cast(kind)
    if f.op == "is_null":
        return c.isNull()
    if f.op == "is_not_null":
        return c.isNotNull()
    if f.op == "like":
        return c.like(f.value)
    if f.op == "in":
        return c.isin(*[lit(v) for v in f.value])
    if f.op == "not_in":
        return ~c.isin(*[lit(v) for v in f.value])
    ops = {"=": Column.__eq__, "<>": Column.__ne__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
    return ops[f.op](c, lit(f.value))


def apply_filter(df: DataFrame, plan: Plan, f: Filter) -> DataFrame:
    """A filter on a frame; long lists become semi- or anti-joins with the literals."""
    if f.op in ("in", "not_in") and len(f.value) > LONG_LIST:
        kind, c = plan.type_of(f.column), name(f.column)
        known = [v for v in f.value if v is not None]
        if f.op == "not_in" and len(known) < len(f.value):
            return df.where(F.lit(False))  # nothing is known to be unequal to null
        values = df.sparkSession.createDataFrame([(str(v),) for v in known], "v string").select(F.col("v").cast(kind).alias("__v")).distinct()
        if f.op == "in":
            return df.join(values, df[c] == values["__v"], "left_semi")
        return df.where(F.col(c).isNotNull()).join(values, df[c] == values["__v"], "left_anti")
    return df.where(condition(plan, f))


def scope_filters(plan: Plan, scope: dict[str, object]) -> list[Filter]:
    """Mandatory filters: a Rule as it says, else a value is equality, a list membership, a pair under a date range both bounds."""
    out = []
    for role, product in plan.sources.items():
        for s in PRODUCTS[product].scopes:
            if s.name not in scope:
                continue
            v, c = scope[s.name], f"{role}.{s.column}"
            if isinstance(v, Rule):
                out.append(Filter(c, v.op, v.value))
            elif s.kind == "date_range":
                out += [Filter(c, ">=", v[0]), Filter(c, "<=", v[1])]
            elif isinstance(v, (list, tuple)):
                out.append(Filter(c, "in", tuple(v)))
            else:
                out.append(Filter(c, "=", v))
    return out


def joined(spark: SparkSession, sf_dir: str, plan: Plan, scope: dict[str, object] | None = None, read: Reader = scan) -> DataFrame:
    """Scanned, scoped, filtered and joined rows with every column and key; Catalyst prunes and pushes down.

    ``read`` scans a product under a role; ``sf_dir`` is whatever it reads from.
    """
    leaf = [f for f in plan.filters if f.leaf] + scope_filters(plan, scope or {})
    frames = {}
    for role, product in plan.sources.items():
        df = read(spark, sf_dir, product, role)
        frames[role] = reduce(lambda d, f: apply_filter(d, plan, f), [f for f in leaf if f.column.startswith(role + ".")], df)
    order = join_order(plan)
    df = frames[order[0][0]]
    for role, conds in order[1:]:
        df = df.join(frames[role], reduce(Column.__and__, [F.col(name(a)) == F.col(name(b)) for a, b in conds]), "inner")
    return reduce(lambda d, f: apply_filter(d, plan, f), [f for f in plan.filters if not f.leaf], df)


def provenance(spark: SparkSession, sf_dir: str, plan: Plan, scope: dict[str, object] | None = None, read: Reader = scan, more: tuple[str, ...] = ()) -> DataFrame:
    """One row per proof: keys (and ``more`` that the reader gives of each source) and evidence columns, without aggregation; with ``branch`` for a union."""
    validate(plan)
    df = joined(spark, sf_dir, plan, scope, read)
    keep = [f"{r}__{c}" for r in plan.sources for c in ("key", *more)] + [name(c) for c in evidence(plan)]
    if plan.union:
        parts = [reduce(lambda d, f: apply_filter(d, plan, f), branch, df).select(*keep, F.lit(k).alias("branch")) for k, branch in enumerate(plan.branches)]
        return reduce(DataFrame.unionByName, parts)
    return df.select(*keep)


def evidence(plan: Plan) -> list[str]:
    """Columns that a row's facts are about: shown, grouped, aggregated, joined on, filtered by the caller."""
    cols = [*plan.columns, *plan.distinct_on, *plan.group_by, *[a.column for a in plan.aggregates if a.column != "*"], *[c for j in plan.joins for on in j.on for c in on], *[f.column for f in plan.filters], *[f.column for b in plan.union for f in b]]
    return list(dict.fromkeys(cols))


def aggregate(plan: Plan, function: str, column: str) -> Column:
    if column == "*":
        return F.count("*")
    c = F.col(name(column))
    if function == "sum":
        kind = plan.type_of(column)
        return F.sum(c.cast("decimal(38,0)") if kind == "bigint" else c)
    return {"count": F.count, "min": F.min, "max": F.max}[function](c)


def visible(spark: SparkSession, sf_dir: str, plan: Plan, scope: dict[str, object] | None = None) -> DataFrame:
    """The result a caller sees: columns under their aliases, in a total order if one is asked for or paging needs it."""
    validate(plan)
    df = joined(spark, sf_dir, plan, scope)
    df, keys = results(df, plan)
    shown = [*plan.columns, *(a.name for a in plan.aggregates)]
    if plan.order_by or plan.limit or plan.offset:
        df = page(df, plan, keys)
    return df.select([F.col(name(c)).alias(plan.aliases.get(c, c.rpartition(".")[2])) for c in shown])


def results(df: DataFrame, plan: Plan) -> tuple[DataFrame, list[str]]:
    """Groups, distinct rows or plain rows of the joined rows, and what tells them apart."""
    if plan.aggregates:
        aggs = [aggregate(plan, a.function, a.column).cast(output_type(plan, a)).alias(a.name) for a in plan.aggregates]
        keys = [name(c) for c in plan.group_by]
        return (df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)), keys
    if plan.union:
        whole = [name(c) for c in plan.tuple_columns]
        parts = [reduce(lambda d, f: apply_filter(d, plan, f), b, df).select(*whole) for b in plan.branches]
        return reduce(DataFrame.unionByName, parts).distinct(), whole
    return df, [f"{r}__key" for r in sorted(plan.sources)]


def delivered(spark: SparkSession, sf_dir: str, plan: Plan, scope: dict[str, object] | None = None) -> DataFrame:
    """Plain rows of a join with their ``position`` in delivery order, that of all entity keys, without a sort in one task."""
    from ..operators.snapshots import numbered

    validate(plan)
    rows = numbered(joined(spark, sf_dir, plan, scope), [f"{r}__key" for r in sorted(plan.sources)], "position")
    return rows.select(*[F.col(name(c)).alias(plan.aliases.get(c, c.rpartition(".")[2])) for c in plan.columns], "position")


def page(df: DataFrame, plan: Plan, keys: list[str]) -> DataFrame:
    """Ordered as asked, nulls last going up and first going down; entity or group keys make the order total when paging."""
    order = [F.col(name(o.column)).desc_nulls_first() if o.descending else F.col(name(o.column)).asc_nulls_last() for o in plan.order_by]
    if plan.limit or plan.offset:
        order += [F.col(k).asc_nulls_last() for k in keys]
    df = df.orderBy(*order) if order else df  # a global aggregate is one row
    if plan.offset:
        df = df.offset(plan.offset)
    return df.limit(plan.limit) if plan.limit else df


def paged_provenance(spark: SparkSession, sf_dir: str, plan: Plan, scope: dict[str, object] | None = None, read: Reader = scan, more: tuple[str, ...] = ()) -> DataFrame:
    """Provenance of what a page delivers only: its rows, groups or distinct rows are found first, then the proofs semi-joined.

    Nulls are equal here, as they are in groups. A global aggregate is one row, which an offset passes over.
    """
    validate(plan)
    proofs = provenance(spark, sf_dir, plan, scope, read, more)
    if not (plan.limit or plan.offset):
        return proofs
    df, keys = results(joined(spark, sf_dir, plan, scope, read), plan)
    if not keys:
        return proofs.where(F.lit(not plan.offset))
    held = page(df, plan, keys).select([F.col(k).alias(f"__{k}") for k in keys])
    return proofs.join(held, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_semi")
