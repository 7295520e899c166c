"""Which questions a query asks: predicate atoms, plan keys, outcome facts, over single plans and over query logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical, canonical_literal, composite, composite_list, composite_text, digest
from ..plans.plan import Filter, Plan
from .digest import set_digest

#: Literals and atoms that one query may hold.
MOST_ATOMS = 20_000


def atoms_of(plan: Plan) -> list[tuple[str, str, str]]:
    """(column, op, literal) of each tested literal: membership is one equality each, exclusion one inequality each."""
    out = set()
    for f in (*plan.filters, *[f for b in plan.union for f in b]):
        out |= {(f.column, op, literal) for op, literal in _tests(f, plan.type_of(f.column))}
    return sorted(out)


def _tests(f: Filter, kind: str) -> list[tuple[str, str]]:
    """(op, literal) of a filter; a literal is its value as the column's type, so 50000 and 50000.00 are one, and null is no text."""
    literal = lambda v: canonical_literal(v, kind)
    if f.op in ("is_null", "is_not_null"):
        return [(f.op, "")]
    if f.op in ("in", "not_in"):
        return [("=" if f.op == "in" else "<>", literal(v)) for v in f.value]
    return [("<>" if f.op == "!=" else f.op, literal(f.value))]


def context(plan: Plan, scope: dict[str, object] | None = None) -> str:
    """Where a predicate is asked: the publications, the join graph and the scope, whatever their order."""
    from .facts import bundle

    graph = sorted(composite_text(*sorted(composite_text(*sorted(pair)) for pair in j.on)) for j in plan.joins)
    limits = sorted(composite_text(k, repr(v)) for k, v in (scope or {}).items())
    return composite_text(bundle(plan), composite_text(*graph), composite_text(*limits))


def plan_text(plan: Plan) -> str:
    """A plan's canonical text: aliases are gone, conjunctions, projections, aggregates and group keys are sorted.

    Every part and every part of a part is preceded by its length, so different plans have different texts.
    """
    each = lambda found: composite_text(*sorted({composite_text(*x) for x in found}))
    tests = lambda filters: [(f.column, o, v) for f in filters for o, v in _conjuncts(f, plan.type_of(f.column))]
    order = [composite_text(o.column, "desc" if o.descending else "asc") for o in plan.order_by] if plan.limit or plan.offset else []
    return composite_text(
        each(plan.sources.items()),
        each([(c,) for c in plan.columns]),
        each([(a.function, a.column) for a in plan.aggregates]),
        each([(c,) for c in plan.group_by]),
        each([(c,) for c in plan.distinct_on]),
        each(tests(plan.filters)),
        composite_text(*order),
        composite_text(str(plan.limit), str(plan.offset)),
        composite_text(*sorted(each(tests(b)) for b in plan.union)),
    )


def _conjuncts(f: Filter, kind: str) -> list[tuple[str, str]]:
    """A filter as conjuncts: a list of alternatives is one, as they are not asked each for itself."""
    tests = _tests(f, kind)
    return [("in", composite_text(*sorted({v for _, v in tests})))] if f.op == "in" and len(set(tests)) > 1 else tests


def outcome(spark: SparkSession, plan: Plan, scope: dict[str, object] | None = None) -> DataFrame:
    """(kind, fact_hash): one fact per tested literal and one for the whole question."""
    where = context(plan, scope)
    rows = [("predicate-atom", composite_text(*x)) for x in atoms_of(plan)]
    if len(rows) > MOST_ATOMS:
        raise ValueError("too many literals")
    rows.append(("composite-outcome", plan_text(plan)))
    df = spark.createDataFrame(rows, "kind string, text string")
    return df.select("kind", digest(F.col("kind"), where, F.col("text")).alias("fact_hash"))


def outcome_fact(plan_digest: Column, outcome_digest: Column, rows: Column) -> Column:
    """The fact of a whole answer: what was asked, what set was released, how many rows came."""
    return digest("outcome", plan_digest, outcome_digest, rows.cast("string"))


# -- over a log of queries: (query_id, product, columns, filters array<struct<col, op, values>>, group_by, ...) -------


def typed(log: DataFrame, types: dict[str, str]) -> DataFrame:
    """The log with each literal as the canonical text of its column's type (a text if it isn't of that type, or of a column without one)."""

    def one(column: Column, value: Column) -> Column:
        out = canonical(value, "string")
        for name, kind in types.items():
            cast = value.try_cast(kind)
            out = F.when((column == name) & cast.isNotNull(), canonical(cast, kind)).otherwise(out)
        return out

    return log.withColumn("filters", F.transform("filters", lambda f: F.struct(f["col"].alias("col"), f["op"].alias("op"), F.transform(f["values"], lambda v: one(f["col"], v)).alias("values"))))


def atom_hash(*before: str) -> Column:
    """The hash of an atom (col, op, literal); a null literal has one of its own, which no text has."""
    parts = [*before, F.col("col"), F.col("op")]
    return F.when(F.col("literal").isNull(), digest(*parts)).otherwise(digest(*parts, F.col("literal")))


def log_atoms(log: DataFrame) -> DataFrame:
    """(query_id, col, op, literal): the distinct tested literals of each query; null is a literal, too."""
    f = log.select("query_id", F.explode("filters").alias("f")).select("query_id", "f.col", "f.op", F.explode("f.values").alias("literal"))
    op = F.when(F.col("op") == "in", "=").when(F.col("op") == "not_in", "<>").when(F.col("op") == "!=", "<>").otherwise(F.col("op"))
    return f.select("query_id", "col", op.alias("op"), "literal").distinct()


def log_predicate_sets(log: DataFrame) -> DataFrame:
    """(query_id, n, digest): the set of atoms of each query, independent of their order and repetition."""
    atoms = log_atoms(log).select("query_id", atom_hash().alias("h"))
    return set_digest(atoms, "h", ["query_id"])


def log_plan_keys(log: DataFrame) -> DataFrame:
    """(query_id, plan_key): equal for queries that differ only in the order of terms, columns, aggregates or group keys."""
    put = lambda c: composite_list(F.array_sort(F.array_distinct(c)))
    terms = F.transform("filters", lambda f: composite(f["col"], F.when(f["op"] == "!=", "<>").otherwise(f["op"]), put(f["values"])))
    key = composite(F.col("product"), put(F.col("columns")), put(F.col("aggregates")), put(F.col("group_by")), put(terms), F.col("limit").cast("string"), F.col("offset").cast("string"))
    return log.select("query_id", F.sha2(key, 256).alias("plan_key"))


#: Nodes over one child beyond which its key is sent to all tasks.
SHARED = 100_000


def algebra_keys(nodes: DataFrame, most: int = 64) -> DataFrame:
    """(node, key) of nested algebra given as rows (node, kind, text, children array<long>): keys of children first.

    Children of joins and unions are put in order, those of a union also once each, so that order doesn't matter there.
    Levels are hashed bottom-up, a join per level; a cycle or more levels than ``most`` is refused. Children that very many
    nodes share, of which there are few, go to their nodes and not the nodes to them.
    """
    from ..streaming.shared import durable

    done = durable(nodes.where(F.size("children") == 0).select("node", digest(F.col("kind"), F.col("text")).alias("key")))
    left = nodes.where(F.size("children") > 0)
    for _ in range(most):
        if left.isEmpty():
            return done
        each = left.select("node", "kind", "text", F.size("children").alias("n"), F.posexplode("children").alias("at", "child"))
        keyed = done.select(F.col("node").alias("child"), "key")
        shared = durable(each.groupBy("child").agg(F.count("*").alias("m")).where(F.col("m") > SHARED).join(keyed, "child").select("child", "key"))
        met = each.join(F.broadcast(shared), "child").unionByName(each.join(F.broadcast(shared.select("child")), "child", "left_anti").join(keyed, "child"))
        ready = met.groupBy("node", "kind", "text", "n").agg(F.sort_array(F.collect_list(F.struct("at", "key"))).alias("k")).where(F.size("k") == F.col("n"))
        keys = F.transform("k", lambda x: x["key"])
        keys = F.when(F.col("kind") == "join", F.array_sort(keys)).when(F.col("kind") == "union", F.array_sort(F.array_distinct(keys))).otherwise(keys)
        new = ready.withColumn("keys", keys)
        one = (F.col("kind") == "union") & (F.size("keys") == 1)
        new = durable(new.select("node", F.when(one, F.element_at("keys", 1)).otherwise(digest(F.col("kind"), F.col("text"), F.array_join("keys", ","))).alias("key")))
        if new.isEmpty():
            break
        done = durable(done.unionByName(new))
        left = durable(left.join(done, "node", "left_anti"))
    raise ValueError("the algebra has a cycle, an unknown child, or too many levels")
