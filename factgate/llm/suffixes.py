"""Repeated passages by sparse suffix arrays: suffixes at minimiser positions, sorted, compared with neighbours and extended both ways."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, documents, durable, slices
from .words import MIX, Stretches, covered, mix, word_hashes, word_spans

#: Words of a repeat at least, and of the grams among which minimisers are chosen.
LENGTH, GRAM = 50, 8
#: Suffixes of one gram that are sorted in one task (their words take 50 MB); those of a more frequent gram meet by the names of their stretches.
RUN = 1 << 16
#: Buckets of doc_ids that are broadcast to leave out documents before their texts are shuffled.
BUCKETS = 1 << 20


def minimisers(words: np.ndarray, at: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Ascending positions of words where, for some stretch of ``length`` words in one text, its (leftmost) smallest gram starts."""
    wide = length - gram + 1
    if len(words) < length:
        return np.zeros(0, np.int64)
    n = len(words) - gram + 1
    grams = Stretches(words)(np.arange(n), np.arange(n) + gram)
    inside = np.zeros(len(words) + 1, np.int64)
    has = np.flatnonzero(np.diff(at) >= length)
    np.add.at(inside, at[has], 1)
    np.add.at(inside, at[has + 1] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside) > 0)
    view = np.lib.stride_tricks.sliding_window_view(grams, wide)
    found = [starts[k : k + 65536] + view[starts[k : k + 65536]].argmin(1) for k in range(0, len(starts), 65536)]
    return np.unique(np.concatenate(found)) if found else starts


def suffixes(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, h, at, gram, front, tail): one row per kept suffix.

    ``gram``, ``tail`` and ``front`` name the first ``gram`` and the first ``length`` words of the suffix and the
    ``length`` - ``gram`` words before it, cut at the text's ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            words, at = word_hashes(batch.column(2))
            p = minimisers(words, at, length, gram)
            doc = np.searchsorted(at, p, "right") - 1
            name = Stretches(words)
            low, high = np.maximum(at[doc], p - (length - gram)), np.minimum(at[doc + 1], p + length)
            take = pa.array(doc)
            cols = [batch.column(0).take(take), batch.column(1).take(take), pa.array(p - at[doc]), *(pa.array(x.view(np.int64)) for x in (name(p, p + gram), name(low, p), name(p, high)))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "at", "gram", "front", "tail"])

    return docs.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, at long, gram long, front long, tail long")


def contexts(docs: DataFrame, edges: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, h, at, gram, right, left): for each place of ``edges`` the ``length`` words from it on and the words before it, nearest first.

    Words are 64-bit hashes, eight bytes each, as many as the text has.
    """
    both = docs.join(edges.groupBy("doc_id", "h").agg(F.collect_set("at").alias("__at")), ["doc_id", "h"])
    where = [both.columns.index(c) for c in ("doc_id", "h", "text", "__at")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, where[2]):
            doc_id, h, text, places = (batch.column(k) for k in where)
            words, at = word_hashes(text)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
            p = places.flatten().to_numpy() + at[doc]
            right, left = np.minimum(at[doc + 1] - p, length), np.minimum(p - at[doc], length - gram)
            ends = lambda n: np.concatenate(([0], np.cumsum(n)))
            inner = lambda n: np.arange(n.sum()) - np.repeat(ends(n)[:-1], n)
            flat = lambda n, w: pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((8 * ends(n)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(w))])
            take = pa.array(doc)
            cols = [doc_id.take(take), h.take(take), pa.array(p - at[doc]), pa.array(Stretches(words)(p, p + gram).view(np.int64))]
            cols += [flat(right, words[np.repeat(p, right) + inner(right)]), flat(left, words[np.repeat(p, left) - 1 - inner(left)])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "at", "gram", "right", "left"])

    return both.mapInArrow(run, "doc_id long, h long, at long, gram long, right binary, left binary")


def wide_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A column of hashed words as a matrix, short rows filled with zeros, and the words of each row."""
    data, offsets = buffers(column)
    n = np.diff(offsets) // 8
    out = np.zeros((len(n), width), np.uint64)
    out[np.arange(width) < n[:, None]] = np.frombuffer(data.tobytes(), np.uint64)
    return out, n


def extended(doc: np.ndarray, right: np.ndarray, n_right: np.ndarray, left: np.ndarray, n_left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matches of sorted suffixes with those of smaller documents: (row, source, words before, words after the place).

    Neighbours are compared: the words that two adjacent suffixes share from their start on. Suffixes that share the
    next r words are a stretch of neighbours none of which share fewer. A repeat of ``length`` words that has o words
    before the place has length - o from it on, so for each o, from 0 on, suffixes are taken within such stretches by
    their o words to the left, one word more at a time; the first document of each such set is the source of the
    others, and the words of both are compared. What holds for several o joins, as all contain the place.
    """
    length, none = right.shape[1], np.zeros(0, np.int64)
    if len(doc) < 2:
        return none, none, none, none
    differ = right[1:] != right[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), length)
    shared = np.concatenate(([0], shared, [0]))  # with the one before; the last has none after it
    by_doc = np.argsort(doc, kind="stable")
    name = np.zeros(len(doc), np.uint64)
    rows, sources, befores = [], [], []
    for o in range(left.shape[1] + 1):
        if o:
            name = mix(name * MIX + left[:, o - 1] + np.uint64(1))
        r = length - o
        fits = (n_right >= r) & (n_left >= o) & ((shared[:-1] >= r) | (shared[1:] >= r))
        at = by_doc[fits[by_doc]]
        if len(at) < 2:
            continue
        stretch = np.cumsum(shared[:-1] < r)
        key = mix(stretch[at].astype(np.uint64) * MIX ^ name[at])
        order = np.argsort(key, kind="stable")
        new = np.ones(len(at), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        first = np.empty(len(at), np.int64)
        first[order] = at[order[np.flatnonzero(new)[np.cumsum(new) - 1]]]
        later = doc[first] < doc[at]
        i, j = at[later], first[later]
        same = (stretch[i] == stretch[j]) & (left[i, :o] == left[j, :o]).all(1)
        rows.append(i[same]), sources.append(doc[j[same]]), befores.append(np.full(int(same.sum()), o))
    if not rows:
        return none, none, none, none
    row, source, before = map(np.concatenate, (rows, sources, befores))
    order = np.lexsort((before, source, row))
    row, source, before = row[order], source[order], before[order]
    head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (source[1:] != source[:-1])))) if len(row) else none
    if not len(head):
        return none, none, none, none
    return row[head], source[head], np.maximum.reduceat(before, head), length - np.minimum.reduceat(before, head)


def neighbours(found: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, h, lo, hi, src): suffixes with their contexts dealt by their first words, sorted by content, compared and extended.

    A task goes through its sorted suffixes batch by batch and holds the last gram's back until it is complete.
    """
    names = ["doc_id", "h", "at", "gram", "right", "left"]

    def marks(rows: pa.Table) -> pa.RecordBatch:
        column = lambda c: rows[c].combine_chunks() if rows[c].num_chunks != 1 else rows[c].chunk(0)
        doc, at = rows["doc_id"].to_numpy(), rows["at"].to_numpy()
        row, src, before, after = extended(doc, *wide_rows(column("right"), length), *wide_rows(column("left"), length - gram))
        take = lambda c: rows[c].combine_chunks().take(pa.array(row))
        return pa.RecordBatch.from_arrays([take("doc_id"), take("h"), pa.array(at[row] - before), pa.array(at[row] + after), pa.array(src)], ["doc_id", "h", "lo", "hi", "src"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            last = rows["gram"].to_numpy()
            end = int(np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1])))[-1])
            if end:
                yield marks(rows.slice(0, end))
            held = rows.slice(end).combine_chunks()
        if held is not None:
            yield marks(held)

    dealt = found.repartition("gram").sortWithinPartitions("gram", "right", "left").select(*names)
    return dealt.mapInArrow(run, "doc_id long, h long, lo long, hi long, src long")


def named_stretches(docs: DataFrame, edges: DataFrame, length: int, gram: int) -> DataFrame:
    """The same marks for grams too frequent for one task: all stretches of ``length`` words around the places meet by name.

    A name is two independent 64-bit hashes. The smallest doc_id of each name is combined before the shuffle and stands
    on storage before it is joined back, so that a stretch which very many documents share can be split.
    """
    wide = length - gram
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    few = docs.join(F.broadcast(edges.select(bucket.alias("__bucket")).distinct()), bucket == F.col("__bucket"), "left_semi")
    both = few.join(edges.groupBy("doc_id", "h").agg(F.collect_set("at").alias("__at")), ["doc_id", "h"])
    where = [both.columns.index(c) for c in ("doc_id", "h", "text", "__at")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, where[2]):
            doc_id, h, text, places = (batch.column(k) for k in where)
            words, at = word_hashes(text)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
            p = places.flatten().to_numpy() + at[doc]
            s = (p[:, None] - np.arange(wide + 1)).ravel()
            doc = np.repeat(doc, wide + 1)
            s = np.unique(s[(s >= at[doc]) & (s + length <= at[doc + 1])])
            doc = np.searchsorted(at, s, "right") - 1
            take = pa.array(doc)
            cols = [doc_id.take(take), h.take(take), pa.array(s - at[doc])]
            cols += [pa.array(Stretches(w)(s, s + length).view(np.int64)) for w in (words, mix(words ^ MIX))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "lo", "name", "check"])

    own = durable(both.mapInArrow(run, "doc_id long, h long, lo long, name long, check long"))
    first = durable(own.groupBy("name", "check").agg(F.min("doc_id").alias("src"), F.max("doc_id").alias("other")).where("src < other").select("name", "check", "src"))
    return own.join(first, ["name", "check"]).where("doc_id > src").select("doc_id", "h", "lo", (F.col("lo") + length).alias("hi"), "src")


def passages(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, h, marks): per document with repeats, stretches (lo, hi, src) of words that the smaller doc_id src has too.

    ``docs`` has doc_id, h (a hash of the text), text and maybe more. Every stretch of ``length`` words holds its
    minimiser, at the same place wherever the stretch occurs. So two equal stretches belong to two kept suffixes with
    the same first gram, and the words before and after these decide.

    1. Suffixes are kept at minimisers; those whose gram no other document has are dropped.
    2. Copies of a whole context (gram, the ``length`` words from the place on, those before it) are a class, whose first
       document stands for it: the others match it over the full width. So a passage that very many documents share
       goes on as one suffix.
    3. The suffixes left, if their gram goes on in different ways, are dealt by gram and sorted by the words that follow;
       neighbours are compared and matches extended to the left and right on the words (``extended``).
    4. A gram with over RUN suffixes left would be one task's; its stretches meet by name (``named_stretches``).
    Counts and minima stand on storage before they are joined back, so that AQE can split what is frequent.
    """
    kept = suffixes(docs, length, gram)
    grams = durable(kept.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("gram"))
    live = durable(kept.join(grams, "gram"))
    classes = durable(live.groupBy("gram", "tail", "front").agg(F.min("doc_id").alias("first")))
    met = durable(live.join(classes, ["gram", "tail", "front"]).select("doc_id", "h", "at", "gram", F.xxhash64("tail", "front").alias("form"), "first"))
    full = met.where("doc_id > first").select("doc_id", "h", F.greatest(F.col("at") - (length - gram), F.lit(0)).alias("lo"), (F.col("at") + length).alias("hi"), F.col("first").alias("src"))
    heads = met.where("doc_id = first").select("doc_id", "h", "at", "gram", "form")
    forms = durable(heads.groupBy("gram").agg(F.count("*").alias("n"), F.min("form").alias("a"), F.max("form").alias("b")).where("a < b").select("gram", "n"))
    edges = heads.join(forms, "gram")
    found = full.unionByName(neighbours(contexts(docs, edges.where(F.col("n") <= RUN), length, gram), length, gram))
    if not forms.where(F.col("n") > RUN).isEmpty():
        found = found.unionByName(named_stretches(docs, edges.where(F.col("n") > RUN), length, gram))
    return found.groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "hi", "src")).alias("marks"))


def gone_of(marks: list[dict] | None, n: int) -> np.ndarray:
    if not marks:
        return np.zeros(n, bool)
    lo, hi = np.array([m["lo"] for m in marks]), np.array([m["hi"] for m in marks])
    return covered(n, lo, hi - lo)


def cut(text: bytes, gone: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """What stays of a text, as it was written, stretches put on lines of their own; and the spans of words that went."""
    turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    spans = list(zip(turn[::2].tolist(), turn[1::2].tolist()))
    if not spans:
        return text, []
    starts, ends = word_spans(text)
    parts, at = [], 0
    for lo, hi in [*spans, (len(gone), len(gone))]:
        if at < lo:
            parts.append(text[starts[at] : ends[lo - 1]])
        at = hi
    return b"\n".join(parts), spans


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, spans, sources, kept, kept_sha256) for every document.

    A word goes if it lies in ``length`` consecutive words that also start in a document with a smaller doc_id; the
    spans of words that went and the doc_ids that have them come along. Words are runs of anything but ASCII white
    space, compared as 64-bit hashes. Null and empty texts have no words; a text of any length is read whole, as are
    repeated rows, each with its own row; rows with the same doc_id don't shorten each other; rows without doc_id are
    kept whole and shorten none. An empty table gives no rows; other columns are not read.
    """
    if not 1 <= gram < length:
        raise ValueError("gram must be at least 1 and less than length")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out = []
            for doc, t, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = t.encode()
                gone = gone_of(marks, len(raw.split()))
                kept, spans = cut(raw, gone)
                src = sorted({m["src"] for m in marks or ()})
                out.append({"doc_id": doc, "n_words": len(gone), "n_removed": int(gone.sum()), "spans": [{"start": a, "end": b} for a, b in spans], "sources": src, "kept": kept.decode(), "kept_sha256": hashlib.sha256(kept).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, OUT)

    fields = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, sources array<long>, kept string, kept_sha256 string"
    known = rows.where("doc_id is not null")  # shuffled once: both joins deal the documents alike
    marked = known.join(passages(known, length, gram), ["doc_id", "h"], "left").select("doc_id", "text", "marks").mapInArrow(run, fields)
    loose = rows.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<struct<lo: long, hi: long, src: long>>").alias("marks"))
    return marked.unionByName(loose.mapInArrow(run, fields))


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("sources", pa.list_(pa.int64())), ("kept", pa.string()), ("kept_sha256", pa.string())])


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Documents with repeated passages cut out of ``text``; those of which nothing is left go. Other columns stay.

    Null, empty and very long texts, repeated rows, rows without doc_id and an empty table as in ``without_repeats``;
    a column may have any name, as those of the work in between are set apart.
    """
    names, kinds = docs.columns, T.StructType(docs.schema.fields)
    rows = docs.where("doc_id is not null").select([F.col(c).alias(f"__{c}") if c not in ("doc_id", "text") else F.col(c) for c in names]).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    marked = rows.join(passages(rows, length, gram), ["doc_id", "h"], "left").select(*[F.col(c if c in ("doc_id", "text") else f"__{c}").alias(c) for c in names], F.col("marks").alias("__marks"))
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, where):
            texts, stay = [], []
            for t, marks in zip(batch.column(where).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if marks:
                    raw = t.encode()
                    t = cut(raw, gone_of(marks, len(raw.split())))[0].decode()
                texts.append(t)
                stay.append(not marks or bool(t.strip()))
            out = batch.set_column(where, batch.schema.field(where), pa.array(texts, batch.schema.field(where).type))
            yield pa.RecordBatch.from_arrays(out.columns[:-1], out.schema.names[:-1]).filter(pa.array(stay, pa.bool_()))

    return marked.mapInArrow(run, kinds).unionByName(docs.where("doc_id is null"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
