"""Packing examples into sequences: vector bin packing by the dot-product heuristic."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import documents, slices

#: Id after every document.
END_ID = 1
#: Tokens, segments and loss-bearing tokens that a sequence holds at most.
TOKENS, SEGMENTS, LOSS = 2048, 128, 2048
#: Pieces among which the heuristic chooses.
POOL = 512


class Packer:
    """Places pieces of examples into sequences under three limits at once: tokens, segments, loss-bearing tokens.

    Of the pieces at hand that fit, the one goes in whose demand vector has the largest dot product with what is left of
    the sequence, both in shares of the limits. When none fits, the longest is cut to what is left. A sequence that
    stays short (a limit other than tokens was reached, or the input ended) is dealt out to sequences whose lengths are
    powers of two, which need no padding. A piece is (example, start, length, loss_from): its tokens from index
    ``loss_from`` of the example on bear loss, as the answer after a prompt does.
    """

    def __init__(self, tokens: int, segments: int, loss: int, pool: int = POOL):
        if min(tokens, segments, loss, pool) < 1:
            raise ValueError("limits and pool must be at least 1")
        self.limit = np.array([tokens, segments, loss], np.float64)
        self.items: list[tuple[object, int, int, int]] = []
        self.need = np.zeros((pool + 1, 3))
        self.pool = pool

    def _demand(self, start: int, length: int, loss_from: int) -> tuple[int, int, int]:
        return length, 1, max(0, start + length - max(start, loss_from))

    def _put(self, k: int, item: tuple[object, int, int, int]) -> None:
        self.need[k] = self._demand(*item[1:])
        if k == len(self.items):
            self.items.append(item)
        else:
            self.items[k] = item

    def _drop(self, k: int) -> None:
        last = self.items.pop()
        if k < len(self.items):
            self._put(k, last)

    def add(self, example: object, length: int, loss_from: int = 0) -> Iterator[list[tuple[object, int, int]]]:
        """Takes a whole example; gives the sequences that this completes."""
        start, whole = 0, int(self.limit[0])
        while length - start >= whole and self._demand(start, whole, loss_from)[2] <= self.limit[2]:
            yield [(example, start, whole)]
            start += whole
        if length > start:
            self._put(len(self.items), (example, start, length - start, loss_from))
        while len(self.items) > self.pool:
            yield from self._one()

    def flush(self) -> Iterator[list[tuple[object, int, int]]]:
        while self.items:
            yield from self._one()

    def _one(self) -> Iterator[list[tuple[object, int, int]]]:
        left, out = self.limit.copy(), []
        while self.items:
            need = self.need[: len(self.items)]
            score = np.where((need <= left).all(1), (need / self.limit) @ (left / self.limit), -1.0)
            k = int(score.argmax())
            if score[k] >= 0:
                example, start, length, loss_from = self.items[k]
                left -= need[k]
                self._drop(k)
            else:
                k = int(need[:, 0].argmax())
                example, start, length, loss_from = self.items[k]
                room = int(min(left[0], length, max(0, loss_from - start) + left[2]))
                if room < 1 or left[1] < 1:
                    break
                self._put(k, (example, start + room, length - room, loss_from))
                length = room
                left -= self._demand(start, length, loss_from)
            out.append((example, start, length))
        if left[0] < 1:
            yield out
            return
        used = int(self.limit[0] - left[0])
        for bit in reversed(range(used.bit_length())):
            size, part = used & (1 << bit), []
            while size:
                example, start, length = out.pop(0)
                took = min(size, length)
                part.append((example, start, took))
                size -= took
                if took < length:
                    out.insert(0, (example, start + took, length - took))
            if part:
                yield part


FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment long"


def pack(docs: DataFrame, path: str, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, doc_id: str = "doc_id", text: str = "text", prompt: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence.

    Documents are tokenised and packed in the task that reads them, so no ids are shuffled: a task keeps the rests of
    at most ``POOL`` documents, and full sequences of long documents leave at once. Every task packs to the end of its
    rows without padding, so how rows are dealt to tasks doesn't matter. ``prompt`` names a column of texts that come
    before ``text`` in the example and bear no loss (null or not given: none). ``keys`` are whole numbers that come back,
    as long, with every piece, where ``doc_id`` alone doesn't tell an example. Null and empty texts are the end id
    alone; texts of any length are packed whole; repeated rows are packed each; an empty table gives no rows; other
    columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = vocabulary(path), Packer(tokens, segments, loss)
        number = TaskContext.get().partitionId() << 40
        held: dict[int, list] = {}  # ids of a document until its last one is placed
        rows: list[tuple] = []

        def place(sequences: Iterator[list[tuple[int, int, int]]]) -> None:
            nonlocal number
            for pieces in sequences:
                offset = 0
                for segment, (key, start, length) in enumerate(pieces):
                    doc = held[key]
                    ids = doc[1][start : start + length]
                    rows.append((doc[0], start, length, zlib.crc32(ids), len(doc[1]), number, offset, segment, *doc[3]))
                    offset += length
                    doc[2] -= length
                    if not doc[2]:
                        del held[key]
                number += 1

        def batch() -> pa.RecordBatch:
            names = [f.split(" ")[0] for f in FIELDS.split(", ")] + list(keys)
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], names)
            rows.clear()
            return out

        key = 0
        for part in slices(batches, 1):
            ids, at = words.encode(part.column(1))
            asked, start = words.encode(part.column(2)) if prompt else (ids[:0], np.zeros(len(at), np.int64))
            told = list(zip(*(c.to_pylist() for c in part.columns[len(part.columns) - len(keys) :]))) if keys else [()] * len(part)
            for k, doc in enumerate(part.column(0).to_pylist()):
                question = asked[start[k] : start[k + 1]]
                own = np.concatenate((question, ids[at[k] : at[k + 1]], [END_ID])).astype("<u4")
                held[key] = [doc, own, len(own), told[k]]
                place(packer.add(key, len(own), len(question)))
                key += 1
            yield batch()
        place(packer.flush())
        yield batch()

    columns = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *([F.col(prompt).alias("prompt")] if prompt else []), *(F.col(c).cast("long").alias(c) for c in keys)]
    return docs.select(*columns).mapInArrow(run, ", ".join([FIELDS, *(f"`{c}` long" for c in keys)]))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


#: Loss-bearing tokens that a sequence of instruction data holds at most.
ANSWERED = 1536


def answers(said: DataFrame) -> DataFrame:
    """(conv_id, turn, repeat, prompt, text): every answer, and all that was said in its conversation before it, joined by line breaks.

    Turns go by their number; rows of one number by role and text. ``repeat`` counts answers of one number from 0, so
    that (conv_id, turn, repeat) is unique. A turn without text says nothing, an answer without text is empty, one that
    nothing precedes has an empty prompt. Rows without conv_id have no conversation: they have no prompt, and are told
    apart by ``repeat`` alone. An empty table gives no rows; other columns, whatever their names, are not read.

    What an example holds is all that was said before, so results grow with the square of a conversation's turns; one of
    very many turns is one task's, which spills.
    """
    rows = said.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    told = rows.where("conv_id is not null").withColumn("prompt", F.concat_ws("\n", F.collect_list("text").over(before)))
    lost = rows.where("conv_id is null").withColumn("prompt", F.lit(""))
    numbered = told.where("role = 'assistant'").withColumn("repeat", F.row_number().over(same).cast("long") - 1)
    alone = lost.where("role = 'assistant'").withColumn("repeat", F.monotonically_increasing_id())
    return numbered.unionByName(alone).select("conv_id", "turn", "repeat", F.when(F.col("prompt") != "", F.concat("prompt", F.lit("\n"))).otherwise("").alias("prompt"), F.coalesce("text", F.lit("")).alias("text"))


def packing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with all turns before them, packed under all three limits: only an answer's tokens bear loss."""
    import public_tokenizers

    both = answers(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return pack(both, public_tokenizers.path("word_bpe_49k.json"), loss=ANSWERED, doc_id="conv_id", prompt="prompt", keys=("turn", "repeat"))
