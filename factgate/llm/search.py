"""Ranked lexical search: documents grouped by the mask of an item's terms that they have, masks scored best bound first."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buffers, documents, durable, slices

BEST = 20
#: Item text that is searched in one pass over the documents, in bytes; more items take more passes.
ITEM_BYTES = 1 << 20
#: Documents and postings in a block, which one task searches at once, and cells of a presence table in memory.
BLOCK, POSTINGS, CELLS = 32_768, 8_000_000, 1 << 24
#: First documents scored for an item in a block; twice as many each time that the next mask may still matter.
FIRST = 128

_c = np.arange(256)
#: Bytes of terms: ASCII letters and digits, and all bytes of other characters. Only A-Z are lower-cased.
IN_TERM = ((_c >= 48) & (_c <= 57)) | ((_c >= 65) & (_c <= 90)) | ((_c >= 97) & (_c <= 122)) | (_c >= 128)
LOWER = np.where((_c >= 65) & (_c <= 90), _c + 32, _c).astype(np.uint8)


def terms(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of every text in order, dictionary-coded, and per text its range of them."""
    data, offsets = buffers(column)
    on = IN_TERM[data]
    begin, stop = on.copy(), on.copy()
    begin[1:] &= ~on[:-1]
    stop[:-1] &= ~on[1:]
    if len(data):
        full = offsets[:-1] < offsets[1:]
        begin[offsets[:-1][full]] = on[offsets[:-1][full]]
        stop[offsets[1:][full] - 1] = on[offsets[1:][full] - 1]
    start = np.flatnonzero(begin)
    bounds = np.concatenate(([0], np.cumsum(np.flatnonzero(stop) + 1 - start))).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(LOWER[data[on]])]).dictionary_encode()
    return coded, np.searchsorted(start, offsets)


def counted(docs: DataFrame, known: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): each document's number of terms, and which of the known ones it has how often."""
    size = max(1, len(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            coded, at = terms(batch.column(1))
            names = np.array([known.get(t, -1) for t in coded.dictionary.to_pylist()] or [0], np.int64)
            held = names[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
            n = np.diff(at)
            pairs, tf = np.unique((np.repeat(np.arange(len(n)), n) * size + held)[held >= 0], return_counts=True)
            lists = pa.array(np.searchsorted(pairs // size, np.arange(len(n) + 1)), pa.int32())
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.ListArray.from_arrays(lists, pa.array(pairs % size, pa.int32())), pa.ListArray.from_arrays(lists, pa.array(tf, pa.int32()))], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Block:
    """Some documents' postings of the known terms, by term: who has it, and what it adds to their scores."""

    def __init__(self, batches: list[pa.RecordBatch], weight: np.ndarray, total: int, length: int):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.doc_id = table["doc_id"].to_numpy()
        lists = table["terms"].chunk(0)
        m = 75 + (25 * table["n"].to_numpy() * total) // length
        doc = np.repeat(np.arange(len(m)), np.diff(lists.offsets.to_numpy()))
        term, tf = lists.flatten().to_numpy(), table["tfs"].chunk(0).flatten().to_numpy().astype(np.int64)
        adds = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        order = np.argsort(term, kind="stable")
        self.doc, self.adds = doc[order], adds[order]
        self.start = np.searchsorted(term[order], np.arange(len(weight) + 1))

    def best(self, item: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc_id, score) of the k best documents of an item, whose distinct terms occur in it so many times.

        A mask says which of the terms a document has; documents of one mask are a group. No score in it passes the sum
        of the most that each of its terms adds in this block, so groups are scored in descending order of that bound
        until the k-th score is above the next one. Equal scores go by doc_id, so a bound that is equal is still scored.
        """
        item, times = item[on := self.start[item + 1] > self.start[item]], times[on]
        if not len(item):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = [slice(self.start[t], self.start[t + 1]) for t in item]
        most = np.array([self.adds[h].max() for h in held]) * times
        masks, group = grouped(self.masks(held))
        bound = np.unpackbits(masks, axis=1, bitorder="little")[:, : len(item)].astype(np.int64) @ most
        rank = np.empty(len(bound), np.int64)
        rank[np.argsort(-bound, kind="stable")] = np.arange(len(bound))
        place = rank[group]
        line = np.argsort(place, kind="stable")  # documents by descending bound of their masks
        ends = np.cumsum(np.bincount(place))
        bound = np.sort(bound)[::-1]
        ids, scores, done, next_, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0, FIRST
        while next_ < len(bound) and bound[next_] > 0 and (len(scores) < k or bound[next_] >= scores[-1]):
            next_ = max(next_ + 1, int(np.searchsorted(ends, done + step, "right")))
            docs = np.sort(line[done : ends[next_ - 1]])
            done, step = ends[next_ - 1], 2 * step
            total = np.zeros(len(docs), np.int64)
            for h, t in zip(held, times):
                own = self.doc[h]
                at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
                total += np.where(own[at] == docs, self.adds[h][at], 0) * t
            ids, scores = np.concatenate((ids, self.doc_id[docs])), np.concatenate((scores, total))
            first = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[first], scores[first]
        return ids[scores > 0], scores[scores > 0]

    def masks(self, held: list[slice]) -> np.ndarray:
        """A bitmap for each document: the terms it has, eight to a byte; made of the terms' bitmaps of documents."""
        out = np.empty((len(self.doc_id), -(-len(held) // 8)), np.uint8)
        step = max(1, CELLS // len(held))
        for low in range(0, len(out), step):
            high = min(low + step, len(out))
            has = np.zeros((len(held), high - low), bool)
            for j, h in enumerate(held):
                own = self.doc[h]
                i, e = np.searchsorted(own, (low, high)) if high - low < len(out) else (0, len(own))
                has[j, own[i:e] - low] = True
            out[low:high] = np.packbits(has, axis=0, bitorder="little").T
        return out


def grouped(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct masks, and which of them each row has; eight bytes at a time."""
    wide = np.zeros((len(masks), -(-masks.shape[1] // 8) * 8), np.uint8)
    wide[:, : masks.shape[1]] = masks
    words, group = wide.view(np.uint64), np.zeros(len(masks), np.int64)
    for k in range(words.shape[1]):
        different, own = np.unique(words[:, k], return_inverse=True)
        group = np.unique(group * len(different) + own, return_inverse=True)[1]
    first = np.unique(group, return_index=True)[1]
    return masks[first], group


def best_of_blocks(found: DataFrame, items: list[tuple[int | None, np.ndarray, np.ndarray]], weight: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of every item in each block of documents; a task has a block in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = postings = 0
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                held.append(part)
                rows, postings = rows + part.num_rows, postings + len(part.column(2).flatten())
                if rows >= BLOCK or postings >= POSTINGS:
                    yield from searched(held)
                    held, rows, postings = [], 0, 0
        if rows:
            yield from searched(held)

    def searched(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, out = Block(held, weight, total, length), []
        for number, (_, own, times) in enumerate(items):
            ids, scores = block.best(own, times, k)
            out.append((np.full(len(ids), number), ids, scores))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["item", "doc_id", "score"])

    return found.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the highest scores above 0, ties by smaller doc_id.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII. A term of df documents weighs
    floor(1000 ln((2N + 2) / (2 df + 1))), and adds to a document's score by how often it has it and by its length.
    Counts are those of all documents with a term. Items come in blocks of about ITEM_BYTES, whose terms go to all
    tasks; each block of items takes one pass over the documents, whose counts of these terms are stored and read twice.

    A null text has no terms. Documents without doc_id count in the statistics, but cannot be named and are not
    returned; rows that repeat a doc_id are ranked each. An item that is repeated whole counts once; different texts
    under one item_id (or null) are ranked each on its own. An item without terms, or none of whose terms occurs, gives no rows; nor
    do empty tables. Texts of any length count whole; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull()).distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts, out = -(-size // ITEM_BYTES), None
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        coded, at = terms(pa.array([r["text"] for r in rows], pa.string()))
        known = {t: k for k, t in enumerate(coded.dictionary.to_pylist())}
        codes = coded.indices.to_numpy() if len(coded) else np.zeros(0, np.int64)
        each = [(r["item_id"], *np.unique(codes[i:j], return_counts=True)) for r, i, j in zip(rows, at[:-1], at[1:])]
        found = durable(counted(docs, known, doc_id, text))
        total, length = found.agg(F.count("*"), F.sum("n")).first()
        if not total:
            break
        df = np.zeros(len(known), np.int64)
        for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
            df[r["term"]] = r["df"]
        weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        best = best_of_blocks(found.where("doc_id is not null"), each, weight, total, length, k)
        ids = spark.createDataFrame([(n, r[0]) for n, r in enumerate(each)], "item long, item_id long")
        best = best.join(F.broadcast(ids), "item").withColumn("item", F.col("item") + (part << 32))
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc("doc_id")]
    # in two steps, so that an item's candidates of very many blocks don't meet in one task
    some = out.withColumn("rank", F.row_number().over(Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(32))).orderBy(*order))).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
