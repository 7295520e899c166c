"""Tamper-evident event logs, and retention of stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import digest
from ..streaming.shared import parts_of, spread

START = "0" * 64


def event_hash(prev: Column, seq: Column, actor: Column, kind: Column, payload: Column) -> Column:
    return digest("audit", prev, seq.cast("string"), actor, kind, payload)


def segment_start(segment: Column) -> Column:
    return F.sha2(F.concat(F.lit("segment:"), segment.cast("string")), 256)


def link(events: DataFrame, prev: str = START, size: int | None = None) -> DataFrame:
    """Events (seq, actor, event_type, payload) with prev_hash and hash, linked from a head.

    Linking is sequential by nature. Without ``size`` the events are one micro-batch, which goes through one task. With
    it a log of any length is linked in segments of so many numbers, each from a start of its own, by as many tasks as
    there are; ``heads`` then links the segments. Verification has no limit either way.
    """
    import hashlib

    def fold(batches):
        import pandas as pd

        head, segment = prev, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if size and r.seq // size != segment:
                    segment = r.seq // size
                    head = hashlib.sha256(f"segment:{segment}".encode()).hexdigest()
                parts = ["audit", head, str(r.seq), r.actor, r.event_type, r.payload]
                h = hashlib.sha256("".join(f"{len(p.encode())}:{p}" for p in parts).encode()).hexdigest()
                out.append((r.seq, r.actor, r.event_type, r.payload, head, h))
                head = h
            yield pd.DataFrame(out, columns=["seq", "actor", "event_type", "payload", "prev_hash", "hash"])

    rows = events.select("seq", "actor", "event_type", "payload")
    rows = spread(rows, F.floor(F.col("seq") / size)).sortWithinPartitions("seq") if size else rows.repartition(1).sortWithinPartitions("seq")
    return rows.mapInPandas(fold, "seq long, actor string, event_type string, payload string, prev_hash string, hash string")


def heads(chain: DataFrame, size: int) -> DataFrame:
    """The last hash of each segment as an event of a chain of its own, a ``size``-th as long: linking it binds the segments together."""
    last = chain.groupBy(F.floor(F.col("seq") / size).cast("long").alias("seq")).agg(F.max_by("hash", "seq").alias("payload"))
    return last.select("seq", F.lit("audit").alias("actor"), F.lit("segment").alias("event_type"), "payload")


def breaks(chain: DataFrame, start: str = START, size: int | None = None) -> DataFrame:
    """(seq, problem) wherever a chain doesn't hold: a wrong hash, a wrong link, a gap or a repeated number.

    Each event is joined with the one before by number, so no task sorts the whole log. Hashes are checked before that,
    so payloads aren't shuffled, and events are dealt to as many tasks as they need. ``size`` is that of its segments.
    """
    own = event_hash(F.col("prev_hash"), F.col("seq"), F.col("actor"), F.col("event_type"), F.col("payload"))
    first = chain.agg(F.min("seq").alias("lo"))
    parts = parts_of(chain)
    dealt = spread(chain.select("seq", "prev_hash", "hash", (F.col("hash") != own).alias("__wrong")), "seq", parts=parts)
    before = spread(chain.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("__before")), "seq", parts=parts).dropDuplicates(["seq"])
    rows = dealt.join(before, "seq", "left").crossJoin(F.broadcast(first))
    inner = F.col("seq") > F.col("lo")
    wanted = F.when(inner, F.col("__before")).otherwise(F.lit(start))
    if size:
        opens = (F.col("seq") % size == 0) | ~inner
        wanted = F.when(opens, segment_start(F.floor(F.col("seq") / size))).otherwise(wanted)
    problem = F.when(F.col("__wrong"), "hash").when(inner & F.col("__before").isNull(), "gap").when(F.col("prev_hash") != wanted, "link")
    out = rows.select("seq", problem.alias("problem")).where("problem is not null")
    repeated = chain.groupBy("seq").agg(F.count("*").alias("n")).where("n > 1").select("seq", F.lit("repeated").alias("problem"))
    return out.unionByName(repeated)


def listed(log: DataFrame, after: int = -1, limit: int = 100, **wanted: str) -> DataFrame:
    """A page of a log in order of ``seq``: what comes after a number and has the wanted values, ``limit`` events at most.

    ``wanted`` names columns (task, query, actor, event_type); an empty value asks for nothing. A page has 1 to 500 events.
    All conditions reach the scan, and the page is the least numbers of every task's rows, so nothing is sorted as a whole.
    """
    if not 1 <= limit <= 500:
        raise ValueError("a page has 1 to 500 events")
    unknown = set(wanted) - set(log.columns)
    if unknown:
        raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
    for column, value in wanted.items():
        if value != "":
            log = log.where(F.col(column) == F.lit(value))
    return log.where(F.col("seq") > F.lit(after)).orderBy("seq").limit(limit)


def between(log: DataFrame, after: int, through: int) -> DataFrame:
    """All events after one number up to another, itself included."""
    if after < 0 or through < after:
        raise ValueError("not a range of numbers")
    return log.where((F.col("seq") > F.lit(after)) & (F.col("seq") <= F.lit(through)))


def included(chain: DataFrame, seq: int, checkpoint_seq: int, checkpoint_hash: str) -> bool:
    """Whether an event is linked without a break to a checkpoint."""
    part = chain.where((F.col("seq") >= seq) & (F.col("seq") <= checkpoint_seq))
    if part.where((F.col("seq") == checkpoint_seq) & (F.col("hash") == checkpoint_hash)).isEmpty() or part.where(F.col("seq") == seq).isEmpty():
        return False
    start = part.where(F.col("seq") == seq).select("prev_hash").first()[0]
    return breaks(part, start).isEmpty()


def expired(artifacts: DataFrame, holds: DataFrame, cutoff: str) -> DataFrame:
    """Stored results (result_id, task, created_at) before a cutoff whose task has no active hold."""
    active = holds.where("released_at is null").select("task").distinct()
    return artifacts.where(F.col("created_at") < F.lit(cutoff).cast("timestamp")).join(active, "task", "left_anti")


def awaiting(files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(name, action): staged files without metadata are orphans, metadata without a file is missing, pending ones await promotion."""
    both = files.select("name", F.lit(1).alias("f")).join(artifacts.select("name", "status"), "name", "full")
    action = F.when(F.col("status").isNull(), "orphan").when(F.col("f").isNull(), "missing").when(F.col("status") == "pending", "promote")
    return both.select("name", action.alias("action")).where("action is not null")
