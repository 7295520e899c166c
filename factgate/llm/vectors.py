"""Embedding near-duplicates: PCA-ordered tiled comparison that stops early on suffix-norm bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, durable, join_labels, ordered_ranges

THRESHOLD = 0.9
#: Vectors in a stripe (two stripes are in a task's memory at once) and in a tile within it.
STRIPE, TILE = 8192, 1024
#: Dimensions after which a pair is checked against its bound.
STOPS = (16, 32)
#: Leading dimensions whose ranges bound a pair of stripes.
BOX = 8
#: What single precision may lose of a sum of products of unit vectors.
SLACK = 1e-4
#: Pairs that are gathered at once.
GATHER = 50_000


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotation(vectors: DataFrame, size: int) -> np.ndarray:
    """Principal axes of all vectors, strongest first: tasks add up products, the driver decomposes one size x size matrix."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], ["at", "x"])

    rows = vectors.select("embedding").mapInArrow(moments, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(size * size)
    for r in rows:
        total[r["at"]] = r["x"]
    return np.linalg.eigh(total.reshape(size, size))[1][:, ::-1].copy()


def alike(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` with cosine at or over the threshold; ra and rb are the same, rotated to the principal axes.

    The first block of dimensions is multiplied for the whole tile. What is left of a product is at most the product
    of the suffix norms; pairs that cannot reach the threshold are dropped after each block, the others verified in
    double precision on the vectors as they came.
    """
    stops = [s for s in STOPS if s < ra.shape[1]]
    tails = lambda r: [np.sqrt((r[:, s:] ** 2).sum(1)) for s in stops]
    ta, tb = tails(ra), tails(rb)
    first = stops[0] if stops else ra.shape[1]
    part = ra[:, :first].astype(np.float32) @ rb[:, :first].astype(np.float32).T
    reach = part + np.outer(ta[0], tb[0]).astype(np.float32) if stops else part
    ii, jj = np.nonzero(reach >= threshold - SLACK)
    if not len(ii):
        return ii, jj
    sums, keep_i, keep_j = part[ii, jj].astype(np.float64), [], []
    for k in range(0, len(ii), GATHER):
        i, j, s = ii[k : k + GATHER], jj[k : k + GATHER], sums[k : k + GATHER]
        for n in range(1, len(stops)):
            s = s + np.einsum("ij,ij->i", ra[i, stops[n - 1] : stops[n]], rb[j, stops[n - 1] : stops[n]])
            on = s + ta[n][i] * tb[n][j] >= threshold - SLACK
            i, j, s = i[on], j[on], s[on]
        on = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
        keep_i.append(i[on]), keep_j.append(j[on])
    return np.concatenate(keep_i), np.concatenate(keep_j)


def compare(left: pa.Table, right: pa.Table | None, axes: np.ndarray, threshold: float) -> pa.Table:
    """Within one stripe (right is None) or between two: each vector's number of links, and links that keep its components."""
    ids, copies, x = left["rep"].to_numpy(), left["copies"].to_numpy(), matrix(left["embedding"])
    if right is None:
        ids2, copies2, y = ids, copies, x
    else:
        ids2, copies2, y = right["rep"].to_numpy(), right["copies"].to_numpy(), matrix(right["embedding"])
    rx, ry = x @ axes, y @ axes
    counts, counts2 = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    base = 0 if right is None else len(x)
    labels = np.arange(base + len(y))
    for p in range(0, len(x), TILE):
        for q in range(p if right is None else 0, len(y), TILE):
            i, j = alike(x[p : p + TILE], y[q : q + TILE], rx[p : p + TILE], ry[q : q + TILE], threshold)
            if right is None and p == q:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            i, j = i + p, j + q
            counts += np.bincount(i, copies2[j], len(x)).astype(np.int64)
            counts2 += np.bincount(j, copies[i], len(y)).astype(np.int64)
            join_labels(labels, i, j + base)
    if right is None:
        counts += counts2
        names = ids
    else:
        names, ids, counts = np.concatenate((ids, ids2)), np.concatenate((ids, ids2)), np.concatenate((counts, counts2))
    on, linked = counts > 0, labels != np.arange(len(labels))
    a, b = np.concatenate((ids[on], names[linked])), np.concatenate((np.zeros(on.sum(), np.int64), names[labels[linked]]))
    n = np.concatenate((counts[on], np.zeros(linked.sum(), np.int64)))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64(), mask=n > 0), "n": pa.array(n, pa.int64())})


def links(reps: DataFrame, size: int, threshold: float) -> DataFrame:
    """(a, b, n): either a vector and how many others it links with, or a link of a forest that joins what links."""
    axes = rotation(reps, size)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r = matrix(batch.column(2)) @ axes
                box = [pa.array(r[:, k]) for k in range(min(BOX, size))]
                tail = pa.array(np.sqrt((r[:, BOX:] ** 2).sum(1)) if size > BOX else np.zeros(len(r)))
                order = pa.array(np.round(r[:, 0] * (1 << 40)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, order, tail, *box], ["rep", "copies", "embedding", "at", "tail", *[f"y{k}" for k in range(len(box))]])

    dims = [f"y{k}" for k in range(min(BOX, size))]
    kind = dict(reps.dtypes)["embedding"]
    placed = durable(reps.select("rep", "copies", "embedding").mapInArrow(project, f"rep long, copies long, embedding {kind}, at long, tail double, {', '.join(f'{d} double' for d in dims)}"))
    placed, _ = ordered_ranges(placed, "at", -(-placed.count() // STRIPE))
    placed = placed.withColumnRenamed("range", "stripe")
    box = placed.groupBy("stripe").agg(F.max("tail").alias("tail"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))])
    last = box.agg(F.max("stripe")).first()[0]
    other = box.select([F.col(c).alias(f"o_{c}") for c in box.columns])
    best = F.col("tail") * F.col("o_tail")
    for d in dims:
        best = best + F.greatest(*[F.col(f"{x}_{d}") * F.col(f"o_{y}_{d}") for x in ("lo", "hi") for y in ("lo", "hi")])
    pairs = box.select("*", F.explode(F.sequence("stripe", F.lit(last))).alias("o_stripe")).join(other, "o_stripe").where(best >= threshold - SLACK).select(F.col("stripe").alias("i"), F.col("o_stripe").alias("j"))
    pairs = durable(pairs)
    fields = ["i", "j", "rep", "copies", "embedding"]
    left = placed.join(pairs, placed["stripe"] == pairs["i"]).select(*fields)
    right = placed.join(pairs.where("i < j"), F.col("stripe") == F.col("j")).select(*[F.col(c).alias(f"o_{c}") for c in fields])

    def both(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        return compare(a, b.rename_columns(fields) if key[0].as_py() != key[1].as_py() else None, axes, threshold)

    return left.groupBy("i", "j").cogroup(right.groupBy("o_i", "o_j")).applyInArrow(both, "a long, b long, n long")


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): each vector, how many others have cosine >= threshold, and its component.

    Equal arrays are compared once and counted as often as they occur. Vectors are sorted by their first principal
    coordinate into stripes; only pairs of stripes whose boxes of leading coordinates and suffix norms can reach the
    threshold meet, and within them tiles stop early. A task returns counts and a spanning forest, never all pairs.
    Vectors that are null, zero, empty, or hold null or non-finite components, and rows without vec_id, link with
    nothing and are their own component; vectors of different lengths never link. Repeated rows count as others. An
    empty table gives no rows; other columns, whatever their names, are not read.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good, F.lit(False)))
    reps = durable(rows.where("good").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    sizes = [r["n"] for r in reps.select(F.size("embedding").alias("n")).distinct().collect()]
    found = [links(reps.where(F.size("embedding") == n), n, threshold) for n in sorted(sizes)]
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    both = durable(both)
    counts = both.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    names = components(both.where("n = 0")).withColumnRenamed("node", "rep")
    known = reps.join(counts, "rep", "left").join(names, "rep", "left").select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    good_rows = rows.where("good").join(known, "embedding").select("vec_id", "n_links", "component_id")
    rest = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good_rows.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
