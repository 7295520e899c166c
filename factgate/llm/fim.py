"""Fill-in-middle: chunks of each text sorted into output order, streamed into digests or texts, and sorted back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, documents, slices

#: Code points in a piece, and bytes of pieces that a task hands on at once.
CHUNK, OUT_BYTES = 2048, 4 << 20
PREFIX, MIDDLE, SUFFIX = range(3)
#: The parts of an output, in the order in which each form has them. A plain output is one part.
FORMS = {"plain": (PREFIX,), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: What a row of pieces has: its row's name and place, facts about the document (in the first piece only), and bytes.
PIECE = "row long, at long, doc_id long, n long, form string, prefix_chars long, middle_chars long, digest string, piece binary"


@dataclass(frozen=True)
class Rule:
    """How texts are cut: the seed of the draws, shares in percent, and the marks before prefix, middle and suffix."""

    seed: str = "1"
    transformed: int = 90
    suffix_first: int = 20
    marks: tuple[str, str, str] = ("<P>", "<M>", "<S>")

    def __post_init__(self) -> None:
        if len(set(self.marks)) < 3 or not all(self.marks) or any(m[0] in other[1:] for m in self.marks for other in self.marks):
            raise ValueError("marks must differ, and none may begin with what another has inside: a mark could arise at a seam")

    def draw(self, doc_id: int | None, n: int, text: bytes) -> tuple[str, int, int]:
        """(form, end of the prefix, end of the middle) in code points."""
        name = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(name[k : k + 8], 16) for k in range(0, 32, 8)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        if not n or h[2] % 100 >= self.transformed or any(m.encode() in text for m in self.marks):
            return "plain", n, n
        return ("spm" if h[3] % 100 < self.suffix_first else "psm"), a, b


def pieces(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text as pieces of at most CHUNK code points, each named by its row and its place in the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            data, offsets = buffers(batch.column(2))
            heads = np.flatnonzero((data & 0xC0) != 0x80)  # where code points start
            first = np.searchsorted(heads, offsets)
            bounds, raw, out = np.append(heads, len(data)), data.tobytes(), Pieces()
            for row, name, i, j, k, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), first[:-1].tolist(), first[1:].tolist()):
                n = end - k
                form, a, b = rule.draw(name, n, raw[i:j])
                spans = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, n)}
                info = (name, n, form, None if form == "plain" else a, None if form == "plain" else b - a, None)
                at = 0
                for part in FORMS[form]:
                    start, stop = spans[part]
                    mark = b"" if form == "plain" else rule.marks[part].encode()
                    cuts = bounds[k + np.append(np.arange(start, stop, CHUNK), stop)].tolist()
                    for p, q in zip(cuts[:-1], cuts[1:]) if start < stop else [(0, 0)]:
                        out.add(row, at, mark + raw[p:q], info if not at else None)
                        mark, at = b"", at + 1
            yield out.batch()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, PIECE)


class Pieces:
    """Rows of PIECE that wait to be handed on."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, row: int, at: int, piece: bytes, info: tuple | None) -> None:
        self.rows.append((row, at, *(info or (None,) * 6), piece))
        self.bytes += len(piece) + 64

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns = zip(*self.rows) if self.rows else [[] for _ in kinds]
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in PIECE.split(", ")])
        self.rows, self.bytes = [], 0
        return made


def in_order(found: DataFrame) -> DataFrame:
    """Pieces dealt by row and sorted by place within each partition, by the shuffle: repartition and sort in one.

    A row's pieces pass one task as a stream that no step gathers, so its memory grows neither with a text's length nor
    with the number of rows; rows are named apart even where they repeat a doc_id, so a repeated one isn't a hot key.
    """
    return found.repartition("row").sortWithinPartitions("row", "at")


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(row, its pieces in order) of sorted pieces, one piece after another."""
    rows = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns]))
    return groupby(rows, key=itemgetter(0))


class Reader:
    """Tells the parts of an output apart by its form and marks alone, however the stream of its bytes is cut."""

    def __init__(self, form: str, rule: Rule):
        self.left = [] if form == "plain" else [(rule.marks[part].encode(), part) for part in FORMS[form]]
        self.part, self.rest = (PREFIX if form == "plain" else None), b""

    def feed(self, piece: bytes) -> Iterator[tuple[int, bytes]]:
        self.rest += piece
        while self.left:
            mark, part = self.left[0]
            at = self.rest.find(mark)
            keep = len(self.rest) - len(mark) + 1 if at < 0 else at
            if keep > 0:
                if self.part is None:
                    raise ValueError("the output doesn't start with a mark")
                yield self.part, self.rest[:keep]
                self.rest = self.rest[keep:]
            if at < 0:
                return
            self.rest, self.part = self.rest[len(mark) :], part
            del self.left[0]
        if self.rest:
            yield self.part, self.rest
            self.rest = b""

    def close(self) -> None:
        if self.left:
            raise ValueError("the output lacks a mark")


def read_back(ordered: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Pieces named by their places in the text again, read from streams of outputs, which are digested on the way.

    Only an output's bytes and its form are used. The piece at place -1 has the facts and the SHA-256 of the output.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Pieces()
        for row, stream in streams(batches):
            digest, reader, k = hashlib.sha256(), None, 0
            for _, _, *info, _, piece in stream:
                if reader is None:
                    facts, reader = info, Reader(info[2], rule)
                digest.update(piece)
                for part, found in reader.feed(piece):
                    out.add(row, part << 40 | k, found, None)
                    k += 1
                if out.bytes > OUT_BYTES:
                    yield out.batch()
            reader.close()
            out.add(row, -1, b"", (*facts, digest.hexdigest()))
        yield out.batch()

    return ordered.mapInArrow(run, PIECE)


def digests(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256), one row for each document.

    Pieces are sorted into output order and streamed through incremental digests; what is read back from the outputs
    is sorted again, where it lies, and digested as the restored text. The one shuffle moves each text once.

    A null text counts as empty and stays plain, as does one that has a mark. Rows that repeat a doc_id are cut alike
    and keep a row each; a null doc_id draws as the empty name. Texts of any length count whole. An empty table gives no
    rows; other columns, whatever their names, are not read. Rows are named by their places in the table's partitions,
    so ``docs`` must read the same way again after a loss, as stored tables do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for _, stream in streams(batches):
            digest = hashlib.sha256()
            for _, at, *info, piece in stream:
                if at < 0:
                    facts = info
                digest.update(piece)
            done.append((*facts, digest.hexdigest()))
            if len(done) == 4096:
                yield finished(done)
        yield finished(done)

    def finished(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [[] for _ in names]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "form" or n.endswith("256") else pa.int64()) for c, n in zip(columns, names)], names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    again = read_back(in_order(pieces(docs, rule, doc_id, text)), rule).sortWithinPartitions("row", "at")
    return again.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def outputs(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): the transformed texts, one row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, stream in streams(batches):
            facts, whole = None, []
            for _, _, *info, _, piece in stream:
                facts = facts or info
                whole.append(piece)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*facts, b"".join(whole).decode()], kinds)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return in_order(pieces(docs, rule, doc_id, text)).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(made: DataFrame, rule: Rule = Rule(), form: str = "form", output: str = "output") -> DataFrame:
    """The rows of a table of outputs with a column ``text``, the text that each was made of."""

    @F.pandas_udf("string")
    def text(forms, outs):  # noqa: ANN001, ANN202
        def one(form_: str, out: str) -> str:
            reader, parts = Reader(form_, rule), [[], [], []]
            for part, found in reader.feed(out.encode()):
                parts[part].append(found)
            reader.close()
            return b"".join(b"".join(p) for p in parts).decode()

        return forms.combine(outs, one)

    return made.withColumn("text", text(F.col(form), F.col(output)))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
