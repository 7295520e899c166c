"""The ledger of what a task family has learned: novelty, settlement under caps, replay, and resource budgets."""

from __future__ import annotations

from collections.abc import Iterator

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import digest
from ..streaming.shared import durable
from .digest import set_digest

DIMS = ("release", "influence", "outcome")


def novel(observed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Observed facts (root, dim, fact_hash, ...) that the root's ledger lacks."""
    return observed.join(ledger.select("root", "dim", "fact_hash"), ["root", "dim", "fact_hash"], "left_anti")


def first_seen(stream: DataFrame) -> DataFrame:
    """(root, dim, fact_hash, seq): the first request of a root to show each fact, if all are accepted."""
    return stream.groupBy("root", "dim", "fact_hash").agg(F.min("seq").alias("seq"))


def charges(stream: DataFrame) -> DataFrame:
    """(root, seq, dim, actual, charged): facts of each request, and those that are new with it, if all are accepted."""
    actual = stream.groupBy("root", "seq", "dim").agg(F.count_distinct("fact_hash").alias("actual"))
    new = first_seen(stream).groupBy("root", "seq", "dim").agg(F.count("*").alias("charged"))
    return actual.join(new, ["root", "seq", "dim"], "left").select("root", "seq", "dim", "actual", F.coalesce("charged", F.lit(0)).alias("charged"))


def outcome_charges(stream: DataFrame) -> DataFrame:
    """(root, seq, atoms, charged_atoms, charged_composite) of outcomes (root, seq, kind, fact_hash): tested literals apart from whole questions.

    A question made of known literals only is still new once; a literal is charged with the first question that tests it.
    """
    each = charges(stream.select("root", "seq", F.col("kind").alias("dim"), "fact_hash"))
    of = lambda k, c: F.coalesce(F.sum(F.when(F.col("dim") == k, F.col(c))), F.lit(0)).cast("long")
    return each.groupBy("root", "seq").agg(of("predicate-atom", "actual").alias("atoms"), of("predicate-atom", "charged").alias("charged_atoms"), of("composite-outcome", "charged").alias("charged_composite"))


def by_root(tasks: DataFrame, stream: DataFrame) -> DataFrame:
    """A stream (task, ...) under the root that each task (task, root) accounts to.

    Both are shuffled: were the tasks broadcast once the stream is shuffled, a task would read all that one task has written.
    """
    return stream.join(tasks.select("task", "root").hint("shuffle_hash"), "task")


def linked(stream: DataFrame, settled: DataFrame) -> DataFrame:
    """(root, seq, dim, fact_hash, new): the facts that each accepted request showed, and whether it was the first to."""
    shown = stream.select("root", "seq", "dim", "fact_hash").distinct().join(settled.where("accepted").select("root", "seq"), ["root", "seq"], "left_semi")
    first = first_seen(shown).withColumnRenamed("seq", "first")
    return shown.join(first, ["root", "dim", "fact_hash"]).select("root", "seq", "dim", "fact_hash", (F.col("seq") == F.col("first")).alias("new"))


#: Rounds in which requests are decided together; what is left after them is folded in order, as are roots of few new facts.
ROUNDS, FOLDED = 12, 1_000_000


def settle(stream: DataFrame, caps: DataFrame, ledger: DataFrame | None = None, used: DataFrame | None = None, folded: int = FOLDED) -> DataFrame:
    """(root, seq, accepted, charged_release, charged_influence, charged_outcome) in order of seq within each root.

    A request is charged the facts that its root hasn't learned, in each dimension; if any dimension would pass the
    root's cap the request is refused whole and teaches nothing. A request without new facts always passes. A request
    is a (root, seq); ``caps`` is (root, max_release, max_influence, max_outcome); roots without caps accept nothing new.

    A root whose new facts fit its caps altogether is never refused, so its requests are charged by grouped minima
    (``first_seen``), in no order. For the others a refusal changes what later requests are charged. A root with at most
    ``folded`` new facts is folded in order in one task (``in_order``), which is cheap and bounded; larger ones are decided in
    rounds (``in_rounds``), each of which charges and refuses very many requests at once, however many one root has.
    What the ledger already has is taken out before, so replays send no facts. ``used`` (root, used_release, ...) says
    how much of its caps each root has used, where the ledger given is only the part of it that the stream touches.
    """
    facts = stream.select("root", "seq", "dim", "fact_hash").distinct()
    limits = caps.select("root", *[F.col(f"max_{d}").cast("long").alias(f"room_{d}") for d in DIMS])
    if ledger is not None:
        facts = novel(facts, ledger)
        used = used or ledger.groupBy("root").agg(*[F.sum(F.when(F.col("dim") == d, 1).otherwise(0)).alias(f"used_{d}") for d in DIMS])
    if used is not None:
        limits = limits.join(used, "root", "left").select("root", *[(F.col(f"room_{d}") - F.coalesce(f"used_{d}", F.lit(0))).alias(f"room_{d}") for d in DIMS])
    marks = stream.select("root", "seq").distinct().select("root", "seq", F.lit(None).cast("string").alias("dim"), F.lit(None).cast("string").alias("fact_hash"))
    first = first_seen(facts)
    count = lambda d: F.count(F.when(F.col("dim") == d, F.col("fact_hash")))
    total = first.groupBy("root").agg(*[count(d).alias(f"n_{d}") for d in DIMS])
    fits = reduce(Column.__and__, [F.coalesce(f"n_{d}", F.lit(0)) <= F.greatest(F.coalesce(f"room_{d}", F.lit(0)), F.lit(0)) for d in DIMS])
    state = durable(marks.select("root").distinct().join(total, "root", "left").join(limits, "root", "left").select("root", fits.alias("free"), reduce(Column.__add__, [F.coalesce(f"n_{d}", F.lit(0)) for d in DIMS]).alias("n")))
    free, bound = state.where("free").select("root"), state.where("not free").select("root", (F.col("n") > folded).alias("large"))
    easy = first.join(free, "root", "left_semi").groupBy("root", "seq").agg(*[count(d).alias(f"charged_{d}") for d in DIMS])
    easy = marks.select("root", "seq").join(free, "root", "left_semi").join(easy, ["root", "seq"], "left").select("root", "seq", F.lit(True).alias("accepted"), *[F.coalesce(f"charged_{d}", F.lit(0)).cast("long").alias(f"charged_{d}") for d in DIMS])
    rooms = bound.join(limits, "root", "left").select("root", "large", *[F.coalesce(f"room_{d}", F.lit(0)).cast("long").alias(f"room_{d}") for d in DIMS])
    out = easy
    if bound.isEmpty():
        return out
    for large, decide in ((False, in_order), (True, in_rounds)):
        own = durable(rooms.where(F.col("large") == large).drop("large"))
        if not own.isEmpty():
            out = out.unionByName(decide(facts.join(own, "root", "left_semi"), marks.select("root", "seq").join(own, "root", "left_semi"), own))
    return out


def in_rounds(facts: DataFrame, requests: DataFrame, rooms: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Decides requests (root, seq) of new facts (root, seq, dim, fact_hash) in order of seq, as ``settle`` does, without folding them.

    A round takes all open requests for accepted and charges each fact to the first of them that shows it, by grouped
    minima. Before the first request of a root that would pass a cap nothing was refused, so all these are settled as
    charged; that one is refused. Later ones learn no more than this assumes, so none can be charged less: those that
    would not fit even so in what the settled ones have left are refused with it. What was learned and what the refused
    showed is dropped. Where a dimension has no room left nothing more is learned in it, so every request that still shows a
    fact of it is refused at once, not only the first to show it, and the rest goes on. A root's running sums are over
    the requests that bring something new, three numbers each; its facts are never together. Roots that stay open after so
    many rounds are folded in order.
    """
    left, open_, rooms, done = durable(facts), durable(requests), rooms, []
    sum_of = lambda d: F.coalesce(F.sum(F.when(F.col("dim") == d, F.col("n"))), F.lit(0)).cast("long").alias(f"new_{d}")
    for _ in range(rounds):
        first = durable(left.groupBy("root", "dim", "fact_hash").agg(F.min("seq").alias("seq")))
        new = first.groupBy("root", "seq", "dim").agg(F.count("*").alias("n")).groupBy("root", "seq").agg(*[sum_of(d) for d in DIMS])
        new = durable(new)
        upto = Window.partitionBy("root").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        summed = new.join(rooms, "root").select("*", *[F.sum(f"new_{d}").over(upto).alias(f"sum_{d}") for d in DIMS])
        passes = reduce(Column.__or__, [(F.col(f"new_{d}") > 0) & (F.col(f"sum_{d}") > F.col(f"room_{d}")) for d in DIMS])
        stops = durable(summed.where(passes).groupBy("root").agg(F.min("seq").alias("stop")))
        each = open_.join(new, ["root", "seq"], "left").join(rooms, "root").na.fill(0, [f"new_{d}" for d in DIMS])
        each = each.join(stops, "root", "left")
        before = F.col("stop").isNull() | (F.col("seq") < F.col("stop"))
        spent = each.where(before).groupBy("root").agg(*[F.sum(f"new_{d}").alias(f"spent_{d}") for d in DIMS])
        each = each.join(spent, "root", "left").na.fill(0, [f"spent_{d}" for d in DIMS])
        hopeless = reduce(Column.__or__, [(F.col(f"new_{d}") > 0) & (F.col(f"new_{d}") > F.col(f"room_{d}") - F.col(f"spent_{d}")) for d in DIMS])
        state = F.when(before, "accepted").when((F.col("seq") == F.col("stop")) | hopeless, "refused").otherwise("open")
        each = durable(each.withColumn("state", state))
        done.append(each.where("state <> 'open'").select("root", "seq", (F.col("state") == "accepted").alias("accepted"), *[F.when(F.col("state") == "accepted", F.col(f"new_{d}")).otherwise(0).cast("long").alias(f"charged_{d}") for d in DIMS]))
        open_ = each.where("state = 'open'")
        rooms = durable(open_.select("root", *[(F.col(f"room_{d}") - F.col(f"spent_{d}")).alias(f"room_{d}") for d in DIMS]).distinct())
        open_ = open_.select("root", "seq")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
        learned_ = first.join(stops, "root").where("seq < stop").select("root", "dim", "fact_hash")
        left = left.join(open_, ["root", "seq"], "left_semi").join(learned_, ["root", "dim", "fact_hash"], "left_anti")
        full = reduce(Column.__or__, [(F.col("dim") == d) & (F.col(f"room_{d}") <= 0) for d in DIMS])
        left = durable(left.join(rooms, "root").withColumn("full", full).select("root", "seq", "dim", "fact_hash", "full"))
        never = durable(left.where("full").select("root", "seq").distinct())
        done.append(never.select("root", "seq", F.lit(False).alias("accepted"), *[F.lit(0).cast("long").alias(f"charged_{d}") for d in DIMS]))
        open_ = durable(open_.join(never, ["root", "seq"], "left_anti"))
        left = durable(left.drop("full").join(never, ["root", "seq"], "left_anti"))
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
    return reduce(DataFrame.unionByName, [*done, in_order(left, open_, rooms)])


def in_order(facts: DataFrame, requests: DataFrame, rooms: DataFrame) -> DataFrame:
    """The same decisions by a fold: rows are dealt by root, sorted by the shuffle, and streamed through a task that holds
    the facts the root has learned, never more than its rooms, and those of one request."""
    marks = requests.select("root", "seq", F.lit(None).cast("string").alias("dim"), F.lit(None).cast("string").alias("fact_hash"))
    rows = facts.select("root", "seq", "dim", "fact_hash").unionByName(marks).join(rooms, "root")
    # by a hash of the root: a repartition by what a join has dealt by already would be dropped, and the join may be broadcast
    dealt = rows.select("root", "seq", "dim", "fact_hash", *[f"room_{d}" for d in DIMS]).withColumn("__deal", F.xxhash64("root")).repartition("__deal")
    kinds = {c: dict(requests.dtypes)[c] for c in ("root", "seq")}
    schema = f"root {kinds['root']}, seq {kinds['seq']}, accepted boolean, " + ", ".join(f"charged_{d} long" for d in DIMS)
    return dealt.sortWithinPartitions("root", "seq").drop("__deal").mapInArrow(_fold, schema)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests in order of (root, seq), each with all its facts: one row per request with the decision."""
    root, seq, room = object(), None, (0, 0, 0)
    known: list[set] = [set() for _ in DIMS]
    new: list[set] = [set() for _ in DIMS]
    out: list[tuple] = []

    def close() -> None:
        fits = all(not n or len(k) + len(n) <= r for k, n, r in zip(known, new, room))
        out.append((root, seq, fits, *(len(n) if fits else 0 for n in new)))
        for k, n in zip(known, new):
            if fits:
                k |= n
            n.clear()

    types = None
    for batch in batches:
        types = batch.schema
        for r, s, dim, fact, *limits in zip(*[c.to_pylist() for c in batch.columns]):
            if (r, s) != (root, seq):
                if seq is not None:
                    close()
                if r != root:
                    known = [set() for _ in DIMS]
                root, seq, room = r, s, limits
            if fact is not None:
                k = DIMS.index(dim)
                if fact not in known[k]:
                    new[k].add(fact)
        yield _decisions(out, types)
    if seq is not None:
        close()
        yield _decisions(out, types)


def _decisions(out: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    fields = [types.field("root"), types.field("seq"), pa.field("accepted", pa.bool_()), *[pa.field(f"charged_{d}", pa.int64()) for d in DIMS]]
    columns = list(zip(*out)) if out else [[] for _ in fields]
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], [f.name for f in fields])


def learned(stream: DataFrame, settled: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """(root, dim, fact_hash) known after settlement."""
    new = stream.join(settled.where("accepted").select("root", "seq"), ["root", "seq"], "left_semi").select("root", "dim", "fact_hash").distinct()
    return new if ledger is None else new.unionByName(ledger.select("root", "dim", "fact_hash")).distinct()


def balance(ledger: DataFrame, caps: DataFrame) -> DataFrame:
    """(root, used and remaining by dimension)."""
    used = ledger.groupBy("root").agg(*[F.sum(F.when(F.col("dim") == d, 1).otherwise(0)).alias(f"used_{d}") for d in DIMS])
    return caps.join(used, "root", "left").select("root", *[F.coalesce(f"used_{d}", F.lit(0)).alias(f"used_{d}") for d in DIMS], *[(F.col(f"max_{d}") - F.coalesce(f"used_{d}", F.lit(0))).alias(f"left_{d}") for d in DIMS])


def observation_refs(stream: DataFrame) -> DataFrame:
    """(root, seq, ref): digest of each request's whole observation."""
    each = set_digest(stream.withColumn("h", digest(F.col("dim"), F.col("fact_hash"))), "h", ["root", "seq"])
    return each.select("root", "seq", F.col("digest").alias("ref"))


def replays(stream: DataFrame) -> DataFrame:
    """(root, seq, first_seq): requests whose observation an earlier one of the same root had in full; they cost nothing."""
    refs = observation_refs(stream)
    first = refs.groupBy("root", "ref").agg(F.min("seq").alias("first_seq"))
    return refs.join(first, ["root", "ref"]).where("seq > first_seq").select("root", "seq", "first_seq")


def touched_difference(candidate: DataFrame, ledger: DataFrame) -> DataFrame:
    """Candidate hashes that a ledger partitioned by ``prefix``, two hex digits, lacks; only the folders of the candidate's prefixes are read."""
    c = candidate.withColumn("prefix", F.substring("fact_hash", 1, 2))
    asked = [r["prefix"] for r in c.select("prefix").distinct().limit(257).collect()]
    ledger = ledger.where(F.col("prefix").isin(asked)) if len(asked) <= 256 else ledger
    return c.join(ledger.select("prefix", "fact_hash"), ["prefix", "fact_hash"], "left_anti").drop("prefix")


def idempotent(log: DataFrame) -> DataFrame:
    """(task, request_id, seq, payload, status): the first request of an id wins; repeats are replays or, with another payload, conflicts."""
    w = Window.partitionBy("task", "request_id").orderBy("seq")
    first = F.first("payload").over(w)
    return log.select("task", "request_id", "seq", "payload", F.when(F.row_number().over(w) == 1, "first").when(F.col("payload").eqNullSafe(first), "replay").otherwise("conflict").alias("status"))


def spend(log: DataFrame, budget: DataFrame) -> DataFrame:
    """Running resource use per task over a log (task, seq, status, reserved_rows, rows, ms): queries, rows, milliseconds.

    A completed query costs what it used, a failed one a query and its time, an indeterminate one all it reserved.
    """
    rows = F.when(F.col("status") == "completed", F.col("rows")).when(F.col("status") == "failed", F.lit(0)).otherwise(F.col("reserved_rows"))
    w = Window.partitionBy("task").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = log.select("task", "seq", "status", F.count("*").over(w).alias("queries_used"), F.sum(rows).over(w).alias("rows_used"), F.sum("ms").over(w).alias("ms_used"))
    return out.join(budget, "task").select("task", "seq", "status", "queries_used", "rows_used", "ms_used", ((F.col("queries_used") > F.col("max_queries")) | (F.col("rows_used") > F.col("max_rows")) | (F.col("ms_used") > F.col("max_ms"))).alias("exhausted"))


def task_states(used: DataFrame, tasks: DataFrame, now: str) -> DataFrame:
    """(task, state): expired by the clock, exhausted by its last balance, else active. ``used`` is from ``spend``."""
    last = used.groupBy("task").agg(F.max_by("exhausted", "seq").alias("exhausted"))
    return tasks.join(last, "task", "left").select("task", F.when(F.col("expires") <= F.lit(now).cast("timestamp"), "expired").when(F.coalesce("exhausted", F.lit(False)), "exhausted").otherwise("active").alias("state"))


def recover(log: DataFrame) -> DataFrame:
    """The log after a restart: interrupted reservations become indeterminate and are charged what they reserved."""
    open_ = F.col("status") == "reserved"
    return log.withColumn("charged_rows", F.when(open_, F.col("reserved_rows")).otherwise(F.col("rows"))).withColumn("status", F.when(open_, "indeterminate").otherwise(F.col("status")))


def reusable(requests: DataFrame, results: DataFrame, bound: list[str], now: str) -> DataFrame:
    """(query_id, result_id): a stored result that answers a request: all bound columns agree, it completed and hasn't expired."""
    live = results.where((F.col("status") == "completed") & (F.col("expires") > F.lit(now).cast("timestamp"))).groupBy(*bound).agg(F.min("result_id").alias("result_id"))
    return requests.join(live, bound).select("query_id", "result_id")


def unusable(cache: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Cached results whose artifact is gone."""
    return cache.join(artifacts.select("result_id"), "result_id", "left_anti")


def binding_key(*columns: str):
    """The reuse key over all columns that an answer depends on; null is no text."""
    return digest("result-binding", *[F.coalesce(F.concat(F.lit("v:"), F.col(c).cast("string")), F.lit("null")) for c in columns])


def baselines(log: DataFrame) -> DataFrame:
    """(root, queries, rows, bytes, cells, without_history): what simpler meters would charge."""
    return log.groupBy("root").agg(F.count("*").alias("queries"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.sum(F.col("rows") * F.col("columns")).alias("cells"), F.sum("facts").alias("without_history"))


def keyset_page(log: DataFrame, order: list[str], cursor: tuple | None, limit: int) -> DataFrame:
    """The next page of a log after a cursor, which holds the order columns of the last row seen."""
    if cursor is not None:
        later = F.lit(False)
        for k in range(len(order)):
            same = F.lit(True)
            for j in range(k):
                same = same & (F.col(order[j]) == F.lit(cursor[j]))
            later = later | (same & (F.col(order[k]) > F.lit(cursor[k])))
        log = log.where(later)
    return log.orderBy(*order).limit(limit)
