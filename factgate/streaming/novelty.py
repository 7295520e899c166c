"""The ledger as a stream: first-seen facts, settlement per micro-batch, exactly-once requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.canonical import digest
from ..operators import radix
from ..operators.ledger import DIMS, idempotent, learned, settle
from .shared import durable

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def off_heap(spark: SparkSession) -> None:
    """Keeps the state of streams started from now on in RocksDB, not on the executors' heaps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def first_seen(requests: DataFrame) -> DataFrame:
    """The facts of a request stream (root, dim, fact_hash, ...) that are new to their root; state grows with distinct facts only."""
    return requests.dropDuplicates(["root", "dim", "fact_hash"])


def once(requests: DataFrame) -> DataFrame:
    """Each request id of a task once."""
    return requests.dropDuplicates(["task", "request_id"])


def once_or_conflict(requests: DataFrame, base: str, checkpoint: str) -> StreamingQuery:
    """Settles request ids (task, request_id, seq, payload): the first request of an id wins, repeats of its payload are replays.

    Others are conflicts and go to a side output, ``conflicts``; winners go to ``first``, replays to ``replays``. A
    batch that is run again overwrites its own folders only, and reads the winners of earlier batches.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        log, known = batch.select("task", "request_id", "seq", "payload"), winners_before(spark, base, number)
        new = log
        if known is not None:
            old = known.select("task", "request_id", F.col("payload").alias("won"))
            met = log.join(old, ["task", "request_id"])
            new = log.join(old, ["task", "request_id"], "left_anti")
        done = idempotent(new)
        if known is not None:
            done = done.unionByName(met.select("task", "request_id", "seq", "payload", F.when(F.col("payload").eqNullSafe(F.col("won")), "replay").otherwise("conflict").alias("status")))
        done = durable(done)
        for status, folder in (("first", "first"), ("replay", "replays"), ("conflict", "conflicts")):
            done.where(F.col("status") == status).drop("status").write.mode("overwrite").parquet(f"{base}/{folder}/batch={number}")

    return requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def winners_before(spark: SparkSession, base: str, number: int) -> DataFrame | None:
    """The winning requests of batches before ``number``."""
    if number == 0:
        return None
    first = spark.read.parquet(f"{base}/first")
    return first.where(first["batch"] < number).select("task", "request_id", "payload")


#: Members of a leaf of the stored ledger: what a batch reads for a fact at most.
LEDGER_LEAF = 256


def settle_batches(requests: DataFrame, caps: DataFrame, base: str, checkpoint: str, split: int = LEDGER_LEAF) -> StreamingQuery:
    """Settles a request stream (root, seq, dim, fact_hash) against a stored ledger, all or nothing per request.

    The ledger is a radix set of keys of (root, dim, fact_hash), of which a batch reads the leaves that its facts belong
    to and writes those that it adds to, whatever the batches before it have left there; what each root has used is a row
    a root. Each micro-batch writes folders named by its number and reads those of the batch before it; a batch that is
    run again overwrites its own folders only, so a retry charges nothing twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = durable(batch.select("root", "seq", "dim", "fact_hash").withColumn("key", ledger_key()))
        keys = stream.select(F.col("key").alias("fact_hash"))
        known, used = None, None
        if number:
            new = radix.difference(spark, f"{base}/ledger", number - 1, keys)
            known = stream.join(new, stream["key"] == new["fact_hash"], "left_anti").select("root", "dim", stream["fact_hash"]).distinct()
            known = durable(known)
            used = spark.read.parquet(f"{base}/used/batch={number - 1}")
        done = durable(settle(stream.drop("key"), caps, known, used))
        new = durable(learned(stream.drop("key"), done))
        if known is not None:
            new = new.join(known, ["root", "dim", "fact_hash"], "left_anti")
        new.write.mode("overwrite").parquet(f"{base}/facts/batch={number}")
        done.write.mode("overwrite").parquet(f"{base}/settled/batch={number}")
        spent = done.groupBy("root").agg(*[F.sum(f"charged_{d}").alias(f"used_{d}") for d in DIMS])
        total = spent if used is None else used.unionByName(spent).groupBy("root").agg(*[F.sum(f"used_{d}").alias(f"used_{d}") for d in DIMS])
        total.write.mode("overwrite").parquet(f"{base}/used/batch={number}")
        change = radix.union(spark, f"{base}/ledger", spark.read.parquet(f"{base}/facts/batch={number}").select(ledger_key().alias("fact_hash")), number - 1 if number else None, number, split)
        spark.createDataFrame([(number, change.new, change.read, change.leaves)], "batch long, new long, read long, leaves long").coalesce(1).write.mode("overwrite").parquet(f"{base}/changes/batch={number}")

    return requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger_key() -> Column:
    return digest(F.col("root"), F.col("dim"), F.col("fact_hash"))
