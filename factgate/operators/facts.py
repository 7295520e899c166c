"""Which facts a result reveals, depends on and asks about."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical, cell_fact, composite, composite_text, derived_fact, digest, order_free, row_fact
from ..plans.build import name, paged_provenance, visible
from ..plans.plan import Plan, base, output_type
from ..sources.products import PRODUCTS
from .digest import set_digest


def role_of(column: str) -> str:
    return column.partition(".")[0]


def cell(plan: Plan, column: str) -> Column:
    p, field = plan.product(column)
    return cell_fact(p.namespace, p.snapshot, F.col(f"{role_of(column)}__key"), field, p.columns[field], F.col(name(column)))


def row(plan: Plan, role: str) -> Column:
    p = PRODUCTS[plan.sources[role]]
    return row_fact(p.namespace, p.snapshot, F.col(f"{role}__key"))


def row_witness(plan: Plan) -> dict[str, list[str | None]]:
    """By role, what testifies that a joined row exists: the row (None), cells of caller filters, once each, and join-key cells once per equality."""
    out: dict[str, list[str | None]] = {role: [None] for role in plan.sources}
    for leaf in (True, False):
        for c in dict.fromkeys(f.column for f in plan.filters if f.leaf is leaf):
            out[role_of(c)].append(c)
    for j in plan.joins:
        for pair in j.on:
            for c in pair:
                out[role_of(c)].append(c)
    return out


def by_source(proofs: DataFrame, plan: Plan, wanted: dict[str, list[tuple[str, str | None]]], keep: list[str]) -> DataFrame:
    """(keep..., namespace, snapshot, key, cells): for every proof and source its row's key and the canonical texts of the wanted cells.

    ``wanted`` lists (output, column) by role; a column of None stands for the row. All sources come out of one pass over
    the proofs, and rows are made distinct or counted on this form before any fact is hashed.
    """
    sources = []
    for role, entries in wanted.items():
        if not entries:
            continue
        p = PRODUCTS[plan.sources[role]]
        cells = []
        for output, c in entries:
            kind = p.columns[role_column(c)] if c else ""
            value = canonical(F.col(name(c)), kind) if c else F.lit("")
            cells.append(F.struct(F.lit(output).alias("output"), F.lit(role_column(c) if c else "").alias("field"), F.lit(base(kind)).alias("type"), value.alias("value")))
        sources.append(F.struct(F.lit(p.namespace).alias("namespace"), F.lit(p.snapshot).alias("snapshot"), F.col(f"{role}__key").alias("key"), F.array(*cells).alias("cells")))
    return proofs.select(*keep, F.explode(F.array(*sources)).alias("s")).select(*keep, "s.*")


def role_column(column: str) -> str:
    return column.partition(".")[2]


def fact_of() -> Column:
    """The fact of a cell ``c`` of ``by_source``: the same hashes as row_fact and cell_fact."""
    where = (F.col("namespace"), F.col("snapshot"), F.col("key"))
    return F.when(F.col("c.field") == "", digest("row", *where)).otherwise(digest("cell", *where, F.col("c.field"), F.col("c.type"), F.col("c.value")))


def row_identity(plan: Plan) -> Column:
    """Identity of a joined row from those of its sources' rows, whichever was joined to which."""
    return order_free(*[row(plan, role) for role in plan.sources])


def bundle(plan: Plan) -> str:
    """The snapshots a plan reads, one per namespace."""
    return "|".join(sorted(f"{PRODUCTS[p].namespace}@{PRODUCTS[p].snapshot}" for p in plan.sources.values()))


def influence_columns(plan: Plan) -> dict[str, list[str | None]]:
    """By role, the row (None) and the columns whose cells a result depends on."""
    parts = row_witness(plan)
    union = [f.column for b in plan.union for f in b]
    for c in [*plan.columns, *plan.distinct_on, *plan.group_by, *[a.column for a in plan.aggregates if a.column != "*"], *union]:
        parts[role_of(c)].append(c)
    return parts


def influence(spark: SparkSession, sf_dir: str, plan: Plan, scope: dict[str, object] | None = None) -> DataFrame:
    """(fact_hash): base rows and cells that took part in any delivered row, group or distinct row.

    Each source's contributing rows are made distinct before cells are exploded, so the joined rows are never multiplied
    by their evidence, and are joined once for all sources.
    """
    proofs = paged_provenance(spark, sf_dir, plan, scope)
    parts = influence_columns(plan)
    wanted = {role: [("", c) for c in dict.fromkeys(cols)] for role, cols in parts.items()}
    once = by_source(proofs, plan, wanted, []).distinct()
    return once.select("namespace", "snapshot", "key", F.explode("cells").alias("c")).select(fact_of().alias("fact_hash")).distinct()


def base_cells(spark: SparkSession, sf_dir: str, plan: Plan, scope: dict[str, object] | None = None) -> DataFrame:
    """(namespace, snapshot, key, cells): the base facts of an observation by their source rows, not hashed yet.

    A cell's ``output`` is its dimension. Of grouped and distinct rows only the influence is here; what they release is
    derived (``release``). Rows of a join may be repeated, so these are made distinct.
    """
    wanted = {role: [("influence", c) for c in dict.fromkeys(cols)] for role, cols in influence_columns(plan).items()}
    if not (plan.aggregates or plan.union):
        for c in dict.fromkeys(plan.columns):
            wanted[role_of(c)].append(("release", c))
    rows = by_source(paged_provenance(spark, sf_dir, plan, scope), plan, wanted, [])
    return rows.distinct() if plan.joins or plan.union else rows


def witnesses(proofs: DataFrame, plan: Plan) -> DataFrame:
    """(group_key, output, fact_hash, n): how often each fact testifies for each visible cell of each group.

    COUNT(*) is witnessed by its members' row witnesses, other aggregates by their argument's cells, a key by its cells.
    Proofs are counted per group and source row before facts are exploded.
    """
    wanted: dict[str, list[tuple[str, str | None]]] = {role: [] for role in plan.sources}
    for a in plan.aggregates:
        for role, cols in (row_witness(plan) if a.column == "*" else {role_of(a.column): [a.column]}).items():
            wanted[role] += [(a.name, c) for c in cols]
    for c in plan.columns:
        wanted[role_of(c)].append((c, c))
    each = by_source(proofs.withColumn("group_key", group_key(plan)), plan, wanted, ["group_key"])
    counted = each.groupBy(*each.columns).agg(F.count("*").alias("n"))
    long = counted.select("group_key", "namespace", "snapshot", "key", F.explode("cells").alias("c"), "n").select("group_key", F.col("c.output").alias("output"), fact_of().alias("fact_hash"), "n")
    return long.groupBy("group_key", "output", "fact_hash").agg(F.sum("n").alias("n"))


def group_key(plan: Plan) -> Column:
    """Identity of a group: its keys' canonical values; nulls are equal."""
    if not plan.group_by:
        return F.lit(composite_text("group-row"))
    return composite("group-row", *[canonical(F.col(name(c)), plan.type_of(c)) for c in plan.group_by])


def derived(spark: SparkSession, sf_dir: str, plan: Plan, scope: dict[str, object] | None = None) -> DataFrame:
    """(group_key, output, fact_hash): the fact that each visible cell of a delivered group reveals."""
    proofs = paged_provenance(spark, sf_dir, plan, scope)
    commit = set_digest(witnesses(proofs, plan), "fact_hash", ["group_key", "output"], "n").select("group_key", "output", F.col("digest").alias("commitment"))
    full = Plan(plan.sources, plan.group_by, plan.joins, plan.filters, plan.group_by, plan.aggregates, plan.order_by, plan.limit, plan.offset, aliases={c: name(c) for c in plan.group_by})
    shown = visible(spark, sf_dir, full, scope)
    cells = [F.struct(F.lit(c).alias("output"), F.lit(f"key:{c}").alias("expression"), F.lit(plan.type_of(c)).alias("type"), canonical(F.col(name(c)), plan.type_of(c)).alias("value")) for c in plan.columns]
    cells += [F.struct(F.lit(a.name).alias("output"), F.lit(f"{a.function}:{a.column}").alias("expression"), F.lit(output_type(plan, a)).alias("type"), canonical(F.col(a.name), output_type(plan, a)).alias("value")) for a in plan.aggregates]
    long = shown.select(group_key(plan).alias("group_key"), F.explode(F.array(*cells)).alias("c")).select("group_key", "c.*")
    empty = F.lit("empty")
    return long.join(commit, ["group_key", "output"], "left").select("group_key", "output", derived_fact(bundle(plan), F.col("group_key"), F.col("expression"), F.col("type"), F.col("value"), F.coalesce("commitment", empty)).alias("fact_hash"))


def release(spark: SparkSession, sf_dir: str, plan: Plan, scope: dict[str, object] | None = None) -> DataFrame:
    """(fact_hash): base cells of plain rows; derived facts of grouped cells; for a union base cells where all candidates agree."""
    if plan.aggregates:
        return derived(spark, sf_dir, plan, scope).select("fact_hash").distinct()
    if plan.union:
        return union_release(spark, sf_dir, plan, scope)
    proofs = paged_provenance(spark, sf_dir, plan, scope)
    return proofs.select(F.explode(F.array(*[cell(plan, c) for c in plan.columns])).alias("fact_hash")).distinct()


def union_witnesses(proofs: DataFrame, plan: Plan) -> DataFrame:
    """(tuple, fact_hash, n): for each distinct row the largest multiplicity of a fact over its candidates."""
    role = next(iter(plan.sources))
    whole = [canonical(F.col(name(c)), plan.type_of(c)) for c in plan.tuple_columns]
    facts = [cell(plan, c) if c else row(plan, role) for c in row_witness(plan)[role]] + [cell(plan, c) for c in plan.tuple_columns]
    each = proofs.select(composite("tuple", *whole).alias("tuple"), F.col(f"{role}__key").alias("candidate"), F.explode(F.array(*facts)).alias("fact_hash"))
    return each.groupBy("tuple", "candidate", "fact_hash").agg(F.count("*").alias("n")).groupBy("tuple", "fact_hash").agg(F.max("n").alias("n"))


def union_release(spark: SparkSession, sf_dir: str, plan: Plan, scope: dict[str, object] | None = None) -> DataFrame:
    proofs = paged_provenance(spark, sf_dir, plan, scope)
    commit = set_digest(union_witnesses(proofs, plan), "fact_hash", ["tuple"], "n").select("tuple", F.col("digest").alias("commitment"))
    whole = composite("tuple", *[canonical(F.col(name(c)), plan.type_of(c)) for c in plan.tuple_columns])
    cells = [F.struct(F.lit(c).alias("field"), F.lit(plan.type_of(c)).alias("type"), canonical(F.col(name(c)), plan.type_of(c)).alias("value"), cell(plan, c).alias("base")) for c in plan.columns]
    each = proofs.select(whole.alias("tuple"), F.explode(F.array(*cells)).alias("c")).select("tuple", "c.*").groupBy("tuple", "field", "type", "value").agg(F.min("base").alias("lo"), F.max("base").alias("hi"))
    fact = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(derived_fact(bundle(plan), F.col("tuple"), F.concat(F.lit("union:"), "field"), F.col("type"), F.col("value"), F.col("commitment")))
    return each.join(commit, "tuple").select(fact.alias("fact_hash")).distinct()


def observation(spark: SparkSession, sf_dir: str, plan: Plan, scope: dict[str, object] | None = None) -> DataFrame:
    """(dim, fact_hash): everything a query exposes, the question itself included."""
    from .footprint import outcome

    parts = [release(spark, sf_dir, plan, scope).select(F.lit("release").alias("dim"), "fact_hash"), influence(spark, sf_dir, plan, scope).select(F.lit("influence").alias("dim"), "fact_hash"), outcome(spark, plan, scope).select(F.lit("outcome").alias("dim"), "fact_hash")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def merged(*observations: DataFrame) -> DataFrame:
    """The union of observations; what several have counts once."""
    out = observations[0]
    for o in observations[1:]:
        out = out.unionByName(o)
    return out.distinct()


def observation_digest(observed: DataFrame) -> DataFrame:
    """(dim, n, digest) of an observation."""
    return set_digest(observed, "fact_hash", ["dim"])


def reconcile(shown: DataFrame, proven: DataFrame, key: list[str], value: str) -> DataFrame:
    """Groups whose visible value differs from the one that the proofs give, or that only one side has."""
    a, b = shown.select(*key, F.col(value).alias("shown"), F.lit(1).alias("in_shown")), proven.select(*key, F.col(value).alias("proven"), F.lit(1).alias("in_proven"))
    same = [a[k].eqNullSafe(b[k]) for k in key]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    both = a.join(b, cond, "full")
    return both.where("in_shown is null or in_proven is null or not (shown <=> proven)").select(*[F.coalesce(a[k], b[k]).alias(k) for k in key], "shown", "proven")


# The kinds of facts.
KINDS = ("base-row", "base-cell", "derived", "outcome", "predicate-atom", "composite-outcome")


def violations(facts: DataFrame) -> DataFrame:
    """Facts that break the rules of their kind, with the rule."""
    rule = (
        F.when(F.col("fact_hash").isNull() | ~F.col("fact_hash").rlike("^[0-9a-f]{64}$"), "hash")
        .when(~F.col("kind").isin(*KINDS), "kind")
        .when((F.col("kind") == "base-row") & F.col("field").isNotNull(), "row with a field")
        .when((F.col("kind") == "base-cell") & F.col("field").isNull(), "cell without a field")
        .when(F.col("kind").startswith("base") & F.col("entity_key").isNull(), "no entity")
    )
    return facts.withColumn("rule", rule).where("rule is not null")


def collisions(facts: DataFrame, payload: str = "payload") -> DataFrame:
    """Hashes under which different payloads stand; must be none."""
    return facts.groupBy("fact_hash").agg(F.min(payload).alias("lo"), F.max(payload).alias("hi")).where("lo <> hi")


def cardinality_problems(observed: DataFrame) -> DataFrame:
    """(root, seq, atoms, composites): requests (root, seq, kind, fact_hash) whose outcome isn't their atoms and one composite."""
    of = lambda k: F.coalesce(F.max(F.col("kind") == k), F.lit(False))
    each = observed.groupBy("root", "seq", "fact_hash").agg(of("predicate-atom").alias("atom"), of("composite-outcome").alias("composite"))
    n = lambda c=None: F.count(F.when(F.col(c), F.col("fact_hash")) if c else "fact_hash")
    found = each.groupBy("root", "seq").agg(n("atom").alias("atoms"), n("composite").alias("composites"), n().alias("n"))
    return found.where("composites <> 1 or n <> atoms + 1").select("root", "seq", "atoms", "composites")


def upper_bound(spark: SparkSession, sf_dir: str, plan: Plan) -> DataFrame:
    """(most): base facts that a plan can touch at most: rows of each source times its evidence columns and one."""
    from ..plans.build import evidence
    from ..sources.products import load

    parts = [load(spark, sf_dir, p).agg((F.count("*") * (1 + sum(1 for c in evidence(plan) if role_of(c) == r))).alias("most")) for r, p in plan.sources.items()]
    return reduce(DataFrame.unionByName, parts).agg(F.sum("most").alias("most"))
