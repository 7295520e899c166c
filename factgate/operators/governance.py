"""Grants, sensitivity, scopes, view stacks and catalogs as tables, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import composite_list, digest
from ..streaming.shared import shared_folder
from .digest import set_digest

#: From least to most sensitive.
LEVELS = ("public", "internal", "confidential", "restricted")


def rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level)


def effective_sensitivity(requests: DataFrame, products: DataFrame) -> DataFrame:
    """(request, sensitivity): the highest of the requested products (request, products array); unknown products give null."""
    each = requests.select("request", F.explode_outer("products").alias("product")).join(products, "product", "left")
    out = each.groupBy("request").agg(F.max(rank(F.col("sensitivity"))).alias("r"), F.max(F.col("sensitivity").isNull()).alias("unknown"))
    return out.select("request", F.when(~F.col("unknown"), F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("r").cast("int"))).alias("sensitivity"))


def approval_routes(requests: DataFrame, routes: DataFrame, defaults: DataFrame) -> DataFrame:
    """(request, route): a route for exactly the set of products first, else the sensitivity's; partial overlap with a set is refused.

    ``requests`` is (request, products, sensitivity), ``routes`` (products, route), ``defaults`` (sensitivity, route).
    """
    key = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    r = requests.withColumn("k", key(F.col("products")))
    exact = routes.select(key(F.col("products")).alias("k"), F.col("route").alias("exact"))
    members = routes.select(key(F.col("products")).alias("s"), F.explode("products").alias("product"))
    touched = r.select("request", "k", F.explode("products").alias("product")).join(members, "product").where("k <> s").select("request").distinct().withColumn("partial", F.lit(True))
    out = r.join(exact, "k", "left").join(touched, "request", "left").join(defaults.select("sensitivity", F.col("route").alias("general")), "sensitivity", "left")
    return out.select("request", F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("partial"), "refused").otherwise(F.coalesce("general", F.lit("refused"))).alias("route"))


def task_policy(requests: DataFrame, products: DataFrame, routes: DataFrame, defaults: DataFrame, budgets: DataFrame) -> DataFrame:
    """(request, sensitivity, route, budget columns) of requested product sets."""
    known = requests.join(effective_sensitivity(requests, products), "request")
    routed = approval_routes(known, routes, defaults)
    return known.join(routed, "request").join(budgets, "sensitivity", "left").drop("products")


def narrowing_violations(grants: DataFrame) -> DataFrame:
    """(task, reason): where a delegated grant is wider than its parent's.

    Grants are (task, parent, root, products, columns array<'product.column'>, sensitivity, max_queries, max_rows, expires).
    """
    p = grants.select([F.col(c).alias(f"p_{c}") for c in grants.columns])
    both = grants.where("parent is not null").join(p, F.col("parent") == F.col("p_task"), "left")
    more = lambda a, b: F.size(F.array_except(a, b)) > 0
    rules = [
        ("no parent", F.col("p_task").isNull()),
        ("other root", F.col("root") != F.col("p_root")),
        ("products", more("products", "p_products")),
        ("columns", more("columns", "p_columns")),
        ("sensitivity", rank(F.col("sensitivity")) > rank(F.col("p_sensitivity"))),
        ("queries", F.col("max_queries") > F.col("p_max_queries")),
        ("rows", F.col("max_rows") > F.col("p_max_rows")),
        ("expiry", F.col("expires") > F.col("p_expires")),
    ]
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))
    return both.select("task", F.explode(found).alias("reason"))


def scope_violations(scopes: DataFrame, parents: DataFrame) -> DataFrame:
    """(task, name, reason): scope entries (task, parent, name, kind, values) not inside the parent's of that name.

    A text equals, a list is a subset, a date range lies inside; a scope that the parent has must not be missing.
    """
    p = parents.select(F.col("task").alias("parent"), "name", F.col("kind").alias("p_kind"), F.col("values").alias("p_values"))
    tasks = scopes.select("task", "parent").distinct()
    due = tasks.join(p, "parent")
    both = due.join(scopes.select("task", "name", "kind", "values"), ["task", "name"], "left")
    outside = F.when(F.col("kind") == "date_range", (F.element_at("values", 1) < F.element_at("p_values", 1)) | (F.element_at("values", 2) > F.element_at("p_values", 2))).otherwise(F.size(F.array_except("values", "p_values")) > 0)
    reason = F.when(F.col("kind").isNull(), "missing").when(F.col("kind") != F.col("p_kind"), "kind").when(outside, "wider")
    return both.select("task", "name", reason.alias("reason")).where("reason is not null")


def scope_problems(requests: DataFrame, domains: DataFrame) -> DataFrame:
    """(request, name, reason): requested scopes (request, product, name, values) outside the declared domain, unknown or missing.

    ``domains`` is (product, name, kind, domain, required).
    """
    asked = requests.join(domains, ["product", "name"], "left")
    outside = F.when(F.col("kind") == "date_range", (F.size("values") != 2) | (F.element_at("values", 1) > F.try_element_at("values", F.lit(2))) | (F.element_at("values", 1) < F.element_at("domain", 1)) | (F.try_element_at("values", F.lit(2)) > F.element_at("domain", 2))).otherwise(F.size(F.array_except("values", "domain")) > 0)
    reason = F.when(F.col("kind").isNull(), "unknown").when(outside, "outside")
    bad = asked.select("request", "name", reason.alias("reason")).where("reason is not null")
    due = requests.select("request", "product").distinct().join(domains.where("required").select("product", "name"), "product")
    missing = due.join(requests.select("request", "product", "name"), ["request", "product", "name"], "left_anti").select("request", "name", F.lit("missing").alias("reason"))
    return bad.unionByName(missing)


def column_problems(requests: DataFrame, fields: DataFrame) -> DataFrame:
    """(request, column, reason): requested columns (request, product, columns) that don't exist, repeat, or are none at all."""
    each = requests.select("request", "product", F.explode("columns").alias("column"))
    unknown = each.join(fields.select("product", "column"), ["product", "column"], "left_anti").select("request", "column", F.lit("unknown").alias("reason"))
    twice = each.groupBy("request", "product", "column").agg(F.count("*").alias("n")).where("n > 1").select("request", "column", F.lit("repeated").alias("reason"))
    empty = requests.where(F.coalesce(F.size("columns"), F.lit(0)) <= 0).select("request", F.lit(None).cast("string").alias("column"), F.lit("empty").alias("reason"))
    return unknown.unionByName(twice).unionByName(empty).distinct()


def delegated_budget(candidate: DataFrame, parent: DataFrame, columns: list[str]) -> DataFrame:
    """(task, columns...): the smaller of what a delegate asks and what its parent has."""
    p = parent.select(F.col("task").alias("parent"), *[F.col(c).alias(f"p_{c}") for c in columns])
    return candidate.join(p, "parent").select("task", *[F.least(c, f"p_{c}").alias(c) for c in columns])


def closure(edges: DataFrame, a: str = "view", b: str = "depends_on", most: int = 64, start: DataFrame | None = None) -> DataFrame:
    """(view, base, depth): everything that each view reaches, with its greatest distance. Cycles and deeper stacks are refused.

    Each step is written once and they are united at the end. ``start`` (view) limits whose reach is followed. Steps are
    joined by a merge, as a broadcast would send the edges through the driver again for each.
    """
    spark, base = edges.sparkSession, shared_folder(edges.sparkSession, "closure")
    nexts = edges.select(F.col(a).alias("__a"), F.col(b).alias("__b")).distinct()
    step = edges.select(F.col(a).alias("view"), F.col(b).alias("base")).distinct()
    step = step.join(start, "view", "left_semi") if start is not None else step
    kind = ", ".join(f"{c} {t}" for c, t in step.dtypes)
    for depth in range(1, most + 2):
        step.withColumn("depth", F.lit(depth)).write.parquet(f"{base}/step={depth}")
        step = spark.read.schema(kind).parquet(f"{base}/step={depth}")
        state = step.agg(F.count("*").alias("n"), F.coalesce(F.max(F.col("view") == F.col("base")), F.lit(False)).alias("cycle")).first()
        if not state["n"]:
            break
        if depth > most or state["cycle"]:
            raise ValueError("the views form a cycle or are stacked too deep")
        step = step.join(nexts.hint("merge"), F.col("base") == F.col("__a")).select("view", F.col("__b").alias("base")).distinct()
    return spark.read.schema(f"{kind}, depth int").parquet(base).groupBy("view", "base").agg(F.max("depth").alias("depth"))


def inactive_ancestors(tasks: DataFrame, most: int = 64) -> DataFrame:
    """(task, ancestor): tasks with an ancestor that isn't active, following (task, parent, state) down from those."""
    down = tasks.where("parent is not null").select(F.col("parent").alias("view"), F.col("task").alias("depends_on"))
    found = closure(down, most=most, start=tasks.where("state <> 'active'").select(F.col("task").alias("view")))
    return found.select(F.col("base").alias("task"), F.col("view").alias("ancestor"))


def schema_digest(fields: DataFrame) -> DataFrame:
    """(table_name, n, digest) of rows (table_name, column, type)."""
    return set_digest(fields.withColumn("h", digest(F.col("column"), F.col("type"))), "h", ["table_name"])


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table_name, column, change): columns that were added, dropped or changed type between two registries."""
    a, b = old.select("table_name", "column", F.col("type").alias("was")), new.select("table_name", "column", F.col("type").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "dropped").when(F.col("was") != F.col("now"), "retyped")
    return a.join(b, ["table_name", "column"], "full").select("table_name", "column", change.alias("change")).where("change is not null")


def view_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(view, change): what changed of views (view, interface, definition, depends_on array) between two registries.

    The interface is what callers see, the definition how it is made, the dependencies what it is made from.
    """
    made = lambda df: df.select("view", digest("interface", F.col("interface")).alias("i"), digest("definition", F.col("definition")).alias("d"), F.sha2(composite_list(F.array_sort(F.array_distinct("depends_on"))), 256).alias("p"))
    x, y = made(old), made(new)
    both = x.select("view", *[F.col(c).alias(f"was_{c}") for c in "idp"]).join(y, "view", "full")
    rules = [("interface", "i"), ("definition", "d"), ("dependencies", "p")]
    changed = F.array_compact(F.array(*[F.when(F.col(f"was_{c}") != F.col(c), F.lit(name)) for name, c in rules]))
    found = F.when(F.col("was_i").isNull(), F.array(F.lit("added"))).when(F.col("i").isNull(), F.array(F.lit("dropped"))).otherwise(changed)
    return both.select("view", F.explode(found).alias("change"))


def delegated_lifetime(candidate: DataFrame, parent: DataFrame, now: str) -> DataFrame:
    """(task, seconds): what a delegate (task, parent, seconds) may live: no longer than its parent (task, expires) still does, and not below 0."""
    left = F.unix_timestamp("expires") - F.unix_timestamp(F.lit(now).cast("timestamp"))
    p = parent.select(F.col("task").alias("parent"), F.greatest(left, F.lit(0)).alias("__left"))
    return candidate.join(p, "parent").select("task", F.least(F.col("seconds").cast("bigint"), "__left").alias("seconds"))


def view_gaps(edges: DataFrame, view_scopes: DataFrame, required: DataFrame, sensitivity: DataFrame) -> DataFrame:
    """(view, base, reason): base tables whose required scope a view lacks, or that are more sensitive than the view.

    ``view_scopes`` is (view, name), ``required`` (base, name), ``sensitivity`` (name, level) of views and base tables.
    """
    reach = closure(edges).select("view", "base")
    lacks = reach.join(required, "base").join(view_scopes, ["view", "name"], "left_anti").select("view", "base", F.concat(F.lit("scope "), "name").alias("reason"))
    level = lambda c: sensitivity.select(F.col("name").alias(c), rank(F.col("level")).alias(f"{c}_rank"))
    hot = reach.join(level("view"), "view").join(level("base"), "base").where("base_rank > view_rank").select("view", "base", F.lit("sensitivity").alias("reason"))
    return lacks.unionByName(hot)


def bindings(contracts: DataFrame) -> DataFrame:
    """(task, n, digest) of the view contracts (task, view, contract) that a task is bound to."""
    return set_digest(contracts.withColumn("h", digest(F.col("view"), F.col("contract"))), "h", ["task"])


def rebound(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tasks whose bound contracts changed."""
    a, b = bindings(old).select("task", F.col("digest").alias("a")), bindings(new).select("task", F.col("digest").alias("b"))
    return a.join(b, "task", "full").where("not (a <=> b)").select("task")


def catalog_problems(products: DataFrame, fields: DataFrame, admitted: list[str]) -> DataFrame:
    """(subject, problem): repeated products, fields of unknown products or types, products without fields."""
    twice = products.groupBy("product").agg(F.count("*").alias("n")).where("n > 1").select(F.col("product").alias("subject"), F.lit("repeated product").alias("problem"))
    lost = fields.join(products, "product", "left_anti").select(F.concat_ws(".", "product", "column").alias("subject"), F.lit("unknown product").alias("problem"))
    odd = fields.where(~F.split("type", r"\(")[0].isin(*admitted)).select(F.concat_ws(".", "product", "column").alias("subject"), F.lit("type").alias("problem"))
    bare = products.join(fields, "product", "left_anti").select(F.col("product").alias("subject"), F.lit("no fields").alias("problem"))
    return twice.unionByName(lost).unionByName(odd).unionByName(bare)


# Which events are legal in which state of a task, and the state that follows.
TRANSITIONS = {("pending", "approve"): "active", ("pending", "reject"): "rejected", ("active", "complete"): "completed", ("active", "revoke"): "revoked", ("active", "expire"): "expired", ("active", "exhaust"): "exhausted"}


def task_states(events: DataFrame) -> DataFrame:
    """(task, state, illegal): each task's state after its events (task, seq, event), and how many were illegal.

    A task is decided by its first approve or reject; an approved one ends with its first closing event after that.
    """
    start = events.where(F.col("event").isin("approve", "reject")).groupBy("task").agg(F.min(F.struct("seq", "event")).alias("d"))
    ends = [e for (s, e) in TRANSITIONS if s == "active"]
    after = events.where(F.col("event").isin(*ends)).join(start.where("d.event = 'approve'").select("task", F.col("d.seq").alias("at")), "task").where("seq > at")
    close = after.groupBy("task").agg(F.min(F.struct("seq", "event")).alias("c"))
    state = F.lit("pending")
    for (s, e), to in TRANSITIONS.items():
        state = F.when(F.col("c.event") == e, to).otherwise(state) if s == "active" else F.when(F.col("c").isNull() & (F.col("d.event") == e), to).otherwise(state)
    total = events.groupBy("task").agg(F.count("*").alias("n"))
    legal = F.col("d").isNotNull().cast("int") + F.col("c").isNotNull().cast("int")
    return total.join(start, "task", "left").join(close, "task", "left").select("task", state.alias("state"), (F.col("n") - legal).alias("illegal"))
