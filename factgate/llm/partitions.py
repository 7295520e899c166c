"""Nearest neighbours by learned partitions: a neighbour graph cut into balanced parts, a classifier that routes, reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable

#: Numbers in a stripe of candidates and queries in a block; a task compares one of each. Pairs that are measured at once.
STRIPE_NUMBERS, QUERIES, GATHER = 1 << 19, 4096, 1 << 16
#: What double precision may lose of a sum of products, as a share of both norms.
SLACK = 1e-9


@dataclass(frozen=True)
class Learning:
    """How the index is fitted: on at most about ``sample`` rows, an eighth of which only chooses the number of probes.

    The graph links each row to ``near`` others; it is cut into ``parts`` (fewer, if a part would have under ``least``
    rows of the sample). The classifier has one layer of ``hidden`` units. A query goes to so many parts that held-out
    rows of the sample find the share ``recall`` of their true neighbours; for 1, to all parts, which is exact.
    """

    sample: int = 9216
    near: int = 10
    parts: int = 64
    least: int = 16
    hidden: int = 128
    epochs: int = 24
    recall: float = 0.96
    seed: int = 7


def good(embedding: str) -> F.Column:
    """Whether a vector takes part: neither null, empty nor zero, and all its components finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(embedding).isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


# -- fitting on the sample -------------------------------------------------------------------------------------------


def nearest(rows: np.ndarray, all_: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """The k rows of ``all_`` with the largest inner product for each of ``rows``, whose own places are left out."""
    out = []
    for p in range(0, len(rows), 1024):
        s = rows[p : p + 1024].astype(np.float32) @ all_.T.astype(np.float32)
        if own is not None:
            s[np.arange(len(s)), own[p : p + 1024]] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def halves(a: np.ndarray, b: np.ndarray, n: int, draw: np.random.Generator) -> np.ndarray:
    """Cuts a graph of n nodes (links a, b both ways) into two of equal size with few links between.

    The nodes are ordered by the second eigenvector of the normalised graph, found by iteration, and cut at the median.
    Then those that gain most change sides in equal numbers, as long as fewer links are cut.
    """
    scale = 1 / np.sqrt(np.bincount(a, minlength=n) + 1e-9)
    lead, v, weight = 1 / scale, draw.normal(size=n), scale[a] * scale[b]
    lead = lead / np.linalg.norm(lead)
    for _ in range(60):
        v = v - lead * (lead @ v)
        v = v + np.bincount(a, weight * v[b], n)
        v /= np.linalg.norm(v)
    side = np.zeros(n, bool)
    side[np.argsort(v * scale, kind="stable")[n // 2 :]] = True
    cut, share = int((side[a] != side[b]).sum()), 0.5
    while share > 0.01:
        gain = np.bincount(a, np.where(side[a] != side[b], 1, -1), n)
        left, right = (x[np.argsort(-gain[x], kind="stable")] for x in (np.flatnonzero(~side), np.flatnonzero(side)))
        both = min(len(left), len(right))
        many = int((gain[left[:both]] + gain[right[:both]] > 0).sum() * share)
        if not many:
            break
        new = side.copy()
        new[left[:many]], new[right[:many]] = True, False
        if (now := int((new[a] != new[b]).sum())) < cut:
            side, cut = new, now
        else:
            share /= 2
    return side


def balanced(near: np.ndarray, levels: int, draw: np.random.Generator) -> np.ndarray:
    """The part of each node of a neighbour graph (rows of neighbours), halved so many times."""
    n = len(near)
    key = np.repeat(np.arange(n), near.shape[1]) * n + near.ravel()
    key = np.unique(np.concatenate((key, key % n * n + key // n)))
    a, b, part = key // n, key % n, np.zeros(n, np.int64)
    for level in range(levels):
        new = part * 2
        for p in range(1 << level):
            nodes = np.flatnonzero(part == p)
            at = np.full(n, -1)
            at[nodes] = np.arange(len(nodes))
            on = (at[a] >= 0) & (at[b] >= 0)
            new[nodes] += halves(at[a[on]], at[b[on]], len(nodes), draw)
        part = new
    return part


@dataclass
class Router:
    """A classifier with one hidden layer: the probability of each part for a vector."""

    width: int
    scale: float
    layers: list[np.ndarray]
    probes: int = 1

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w, u, v, z = self.layers
        out = np.maximum(x * self.scale @ w + u, 0) @ v + z
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)

    @property
    def parts(self) -> int:
        return len(self.layers[3])


def trained(x: np.ndarray, wanted: np.ndarray, how: Learning, draw: np.random.Generator) -> Router:
    """Fits the classifier to shares of parts by gradient descent with momentum and scaled steps."""
    (n, d), parts, batch = x.shape, wanted.shape[1], 256
    router = Router(d, float(np.sqrt(d) / max(1e-300, np.sqrt((x * x).sum(1).mean()))), [draw.normal(size=(d, how.hidden)) * np.sqrt(2 / d), np.zeros(how.hidden), draw.normal(size=(how.hidden, parts)) / np.sqrt(how.hidden), np.zeros(parts)])
    mean, square = [np.zeros_like(t) for t in router.layers], [np.zeros_like(t) for t in router.layers]
    steps, done = how.epochs * -(-n // batch), 0
    for _ in range(how.epochs):
        order = draw.permutation(n)
        for k in range(0, n, batch):
            rows = x[order[k : k + batch]]
            hidden = np.maximum(rows * router.scale @ router.layers[0] + router.layers[1], 0)
            slope = (router.probabilities(rows) - wanted[order[k : k + batch]]) / len(rows)
            back = slope @ router.layers[2].T * (hidden > 0)
            done += 1
            for t, g, m, s in zip(router.layers, (rows.T @ back * router.scale, back.sum(0), hidden.T @ slope, slope.sum(0)), mean, square):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                t -= 0.003 * (1 - done / (steps + 1)) * (m / (1 - 0.9**done)) / (np.sqrt(s / (1 - 0.999**done)) + 1e-8)
    return router


def fitted(spark: SparkSession, x: np.ndarray, k: int, how: Learning) -> Router:
    """The router of a bounded sample: tasks find its neighbour graph, the driver cuts that and trains the classifier."""
    draw = np.random.default_rng(how.seed)
    x = x[draw.permutation(len(x))]
    held, learn = x[: len(x) // 8], x[len(x) // 8 :]
    near = min(how.near, len(learn) - 1)
    levels = max(0, int(np.log2(max(1, min(how.parts, len(learn) // how.least)))))
    if near < 1 or not levels:
        return Router(x.shape[1], 1.0, [np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)])
    shared = spark.sparkContext.broadcast(learn)  # at most how.sample rows

    def graph(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            found = nearest(shared.value[rows], shared.value, near, rows)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(found.tolist(), pa.list_(pa.int32()))], ["row", "near"])

    found = spark.range(0, len(learn), 1, -(-len(learn) // 1024)).mapInArrow(graph, "row long, near array<int>").toArrow().sort_by("row")
    links = np.asarray(found["near"].combine_chunks().flatten()).reshape(len(learn), near).astype(np.int64)
    part = balanced(links, levels, draw)
    wanted = np.zeros((len(learn), 1 << levels))
    np.add.at(wanted, (np.repeat(np.arange(len(learn)), near), part[links].ravel()), 0.7 / near)
    wanted[np.arange(len(learn)), part] += 0.3
    router = trained(learn, wanted, how, draw)
    # probes: what held-out rows need to meet their true neighbours among all of the sample
    k = min(k, len(x) - 1)
    if not len(held) or k < 1 or how.recall >= 1:
        router.probes = router.parts
        return router
    p = router.probabilities(x)
    true = nearest(held, x, k, np.arange(len(held)))
    order = np.argsort(-p[: len(held)], axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    needed = np.take_along_axis(place, p.argmax(1)[true], 1)
    share = np.cumsum(np.bincount(needed.ravel(), minlength=router.parts)) / needed.size
    router.probes = int(np.searchsorted(share, how.recall)) + 1
    return router


# -- index and search ------------------------------------------------------------------------------------------------


def placed(rows: DataFrame, router: Router) -> DataFrame:
    """Every row (vec_id, size, embedding) with its most probable part; one of another length than the router's by its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.asarray(batch.column(0)) % router.parts
            own = np.flatnonzero(np.asarray(batch.column(1)) == router.width)
            if len(own):
                part[own] = router.probabilities(matrix(batch.column(2).take(pa.array(own)))).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], ["vec_id", "size", "embedding", "part"])

    kind = dict(rows.dtypes)["embedding"]
    return rows.select("vec_id", "size", "embedding").mapInArrow(run, f"vec_id long, size int, embedding {kind}, part long")


def routed(queries: DataFrame, router: Router, sizes: np.ndarray, k: int) -> DataFrame:
    """Each query (query_id, size, embedding) once for each part it is sent to.

    These are the most probable ones, as many as the router probes, and more until they hold over k rows. A query of
    another length than the router's goes to all parts, whose rows of its length are few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pick = np.ones((batch.num_rows, router.parts), bool)
            own = np.flatnonzero(np.asarray(batch.column(1)) == router.width)
            if len(own):
                order = np.argsort(-router.probabilities(matrix(batch.column(2).take(pa.array(own)))), axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                chosen = np.zeros((len(own), router.parts), bool)
                np.put_along_axis(chosen, order, (np.arange(router.parts) < router.probes) | (before <= k), 1)
                pick[own] = chosen
            row, part = np.nonzero(pick)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(part)], ["query_id", "size", "embedding", "part"])

    kind = dict(queries.dtypes)["embedding"]
    return queries.select("query_id", "size", "embedding").mapInArrow(run, f"query_id long, size int, embedding {kind}, part long")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up component by component from the first one on."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def reranked(queries: pa.Table, stripe: pa.Table, k: int) -> pa.Table:
    """(query_id, vec_id, score): each query's k best rows of a stripe, itself left out, ties by smaller vec_id."""
    names, ids = queries["query_id"].to_numpy(), stripe["vec_id"].to_numpy()
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(names) and len(ids):
        q, c = matrix(queries["embedding"]), matrix(stripe["embedding"])
        slack = SLACK * np.sqrt((c * c).sum(1).max()) * np.sqrt((q * q).sum(1))
        for p in range(0, len(q), 256):
            s = q[p : p + 256] @ c.T
            s[names[p : p + 256, None] == ids] = -np.inf
            floor = np.partition(s, -k, axis=1)[:, -k] - slack[p : p + 256] if k < len(ids) else np.full(len(s), -np.inf)
            row, col = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
            exact = np.concatenate([products(q[p + row[g : g + GATHER]], c[col[g : g + GATHER]]) for g in range(0, len(row), GATHER)] or [np.zeros(0)])
            order = np.lexsort((ids[col], -exact, row))
            row, col, exact = row[order], col[order], exact[order]
            on = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((names[p + row[on]], ids[col[on]], exact[on]))
    return pa.table({n: np.concatenate(x) for n, x in zip(("query_id", "vec_id", "score"), zip(*out))})


def neighbours(table: DataFrame, queries: DataFrame, k: int = 20, how: Learning = Learning(), vec_id: str = "vec_id", embedding: str = "embedding", query_id: str = "query_id", query: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the largest inner product found for each query, never its own.

    Every row is placed in its most probable part, every query sent to its most probable ones; a part is compared in
    stripes of rows and blocks of queries, so a part that holds a third of all rows is many tasks' work. Scores are exact, in
    double precision on the vectors as they came, equal ones go by smaller vec_id.

    A query's own rows are those with its id; queries that repeat an id count once, with the least of their vectors.
    Rows that repeat a vec_id are ranked each. Vectors that are null, empty, zero, or hold null or non-finite components, and
    rows without an id, take no part. Only vectors of one length are compared; those of another length than most are
    compared with all of their length. If there are at most k candidates, all are returned. Empty tables give no rows;
    other columns, whatever their names, are not read.
    """
    spark = table.sparkSession
    ask = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query).alias("embedding"))
    ask = ask.where(F.col("query_id").isNotNull() & good("embedding")).groupBy("query_id").agg(F.min("embedding").alias("embedding")).withColumn("size", F.size("embedding"))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & good("embedding")).withColumn("size", F.size("embedding"))
    lengths = rows.groupBy("size").agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), "size").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # about how.sample rows of the usual length, by a hash of the id and the vector
    share = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30)) < int(min(1.0, how.sample / most["n"]) * (1 << 30))
    sample = matrix(rows.where((F.col("size") == most["size"]) & share).select("embedding").limit(2 * how.sample).toArrow()["embedding"]) if most["n"] else np.zeros((0, 1))
    router = fitted(spark, np.unique(sample, axis=0), k, how)
    index = durable(placed(rows, router).withColumn("deal", F.xxhash64("vec_id", F.monotonically_increasing_id())))
    sizes = durable(index.groupBy("size", "part").agg(F.count("*").alias("n")))
    known = np.zeros(router.parts, np.int64)
    for r in sizes.where(F.col("size") == router.width).collect():  # a row for each part
        known[r["part"]] = r["n"]
    sent = durable(routed(ask, router, known, k))
    asked = sent.groupBy("size", "part").agg(F.count("*").alias("asked"))
    plan = sizes.join(asked, ["size", "part"]).select("size", "part", F.ceil(F.col("n") * F.col("size") / STRIPE_NUMBERS).alias("stripes"), F.ceil(F.col("asked") / QUERIES).alias("blocks"))
    plan = durable(plan)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = ["size", "part", "stripe", "block"]
    right = index.join(plan, ["size", "part"]).withColumn("stripe", F.pmod("deal", "stripes")).select("vec_id", "embedding", "size", "part", "stripe", every("blocks").alias("block"))
    left = sent.join(plan, ["size", "part"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).select("query_id", "embedding", "size", "part", every("stripes").alias("stripe"), "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: reranked(a, b, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(table, table.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"))
