"""Shared helpers of the corpus operators: lineage cuts, text buffers, document ranges, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a task, in bytes.
SLICE_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def durable(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, on storage that all executors share.

    The folder comes from ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary one; on a
    cluster, where no other machine could read that, it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp("checkpoints")
    return base


def kept(df: DataFrame) -> DataFrame:
    """Marks a small frame that several branches read; lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


# -- text inside a task ---------------------------------------------------------------------------------------------


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as its bytes and len + 1 offsets into them; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the text column of each holds about ``most`` bytes (a longer text comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Every text cut before each run of ASCII white space: the pieces, dictionary-coded, and per text its range of them."""
    if not len(data):
        return pa.array([], pa.binary()).dictionary_encode(), np.zeros(len(offsets), np.int64)
    blank = SPACE[data]
    starts = blank.copy()
    starts[1:] &= ~blank[:-1]
    starts[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(starts)
    bounds = np.append(at, len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return pieces.dictionary_encode(), np.searchsorted(at, offsets)


def ragged(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``rows`` of a flattened list column, one after another, and their offsets."""
    lengths = offsets[rows + 1] - offsets[rows]
    out = np.concatenate(([0], np.cumsum(lengths)))
    return flat[np.repeat(offsets[rows] - out[:-1], lengths) + np.arange(out[-1])], out


# -- document ranges ------------------------------------------------------------------------------------------------


#: Ranges that one level of cuts makes of a range, and cut lists that are broadcast at most (64 numbers each).
CUTS, BROADCAST_CUTS = 64, 100_000


def ordered_ranges(df: DataFrame, column: str, parts: int) -> tuple[DataFrame, int]:
    """The rows with a column ``range`` that follows the order of the integer ``column``, and ranges per coarse range.

    About ``parts`` ranges hold about as many rows each, however the values lie: each level of at most CUTS percentiles
    splits every range of the level before by percentiles of its own values. Rows of one value stay together; null goes
    to the first range. The driver holds one level's cuts; further levels are tables, broadcast only while they are
    small.
    """
    out, made, coarse = df.withColumn("range", F.lit(0).cast("long")), 1, 1
    while made < parts:
        n = min(CUTS, -(-parts // made))
        found = F.percentile_approx(column, [i / n for i in range(1, n)], 2000).alias("__cuts")
        if made == 1:
            cuts, coarse = F.array(*[F.lit(c).cast("long") for c in out.agg(found).first()[0] or []]), n
        else:
            level = durable(out.where(F.col(column).isNotNull()).groupBy("range").agg(found))
            out, cuts = out.join(F.broadcast(level) if made <= BROADCAST_CUTS else level, "range", "left"), F.col("__cuts")
        below = F.coalesce(F.size(F.filter(cuts, lambda c: c < F.col(column))), F.lit(0))
        out = out.withColumn("range", F.col("range") * n + F.greatest(below, F.lit(0))).select(*df.columns, "range")
        made *= n
    return out, max(1, made // coarse)


# -- connected components -------------------------------------------------------------------------------------------


#: Links that one task unites at once (their two ends take 4 MB).
LINKS = 1 << 18


def join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites the sets of i and j in a forest of smallest labels, in place."""
    while True:
        a, b = labels[i], labels[j]
        on = a != b
        if not on.any():
            return
        low = np.minimum(a[on], b[on])
        np.minimum.at(labels, a[on], low)
        np.minimum.at(labels, b[on], low)
        while (up := labels[labels]).tobytes() != labels.tobytes():
            labels[:] = up


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the given ones do, each from a node to the smallest of its component."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    labels = np.arange(len(nodes))
    join_labels(labels, at[: len(u)], at[len(u) :])
    on = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[on], nodes[labels[on]]


def contracted(edges: DataFrame, most: int) -> DataFrame:
    """(u, v): each task's links as stars around the smallest nodes, about ``most`` links united at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= most:
                held = [stars(*map(np.concatenate, zip(*held)))]
                n = len(held[0][0])
                if 2 * n >= most:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], ["u", "v"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, stars(*map(np.concatenate, zip(*held))))], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge list, whose ends are integers, with the smallest node that it reaches.

    Each task first makes stars of its own links, so paths get short before anything is shuffled. Then the large-star and
    small-star steps alternate, each a grouped minimum and an equi-join, until the edges form stars around their minima.
    Links that are, or have become, no more than LINKS go to as many tasks as they need, one, without further rounds.
    Every round is written to the checkpoint folder, so a lost executor costs one round. A node with very many edges is
    a skewed join key, which AQE splits; the minima are combined before the shuffle. Self-links and repeated links are
    allowed; null ends are ignored. No edges give no rows.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    e = durable(contracted(e, LINKS))
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        if not mark[0]:
            break
        if mark[0] <= LINKS:
            e = durable(contracted(e.coalesce(1), LINKS + 1))
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = durable(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
