"""Substring dedup by recompression: equal stretches of words get equal symbols, level by level; shared symbols reveal repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ordered_ranges
from .words import MIX, Stretches, covered, mix, word_hashes

#: Words of a repeat.
WINDOW = 13
#: Rounds after which symbols of at most 2 ** LEVELS words (runs apart) are compared between documents.
LEVELS = 2
#: Bytes of text in a range of documents, and names of windows in a group that is compared at once.
RANGE_BYTES, GROUP_NAMES = 8 << 20, 1 << 19
#: Stretches that are named at once, so that what a round touches stays in the processor's cache.
AT_ONCE = 1 << 16


class Round:
    """One round of recompression: maximal runs of a symbol are named by (symbol, length), then pairs by (left, right).

    A hash bit of the name says whether a symbol is a left or a right one; a left one and a right one after it are a
    pair. A name is a 64-bit hash of what it stands for, so all tasks give the same name without meeting.
    """

    def __init__(self, s: np.ndarray):
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        self.symbols, self.run, self.start = s, np.cumsum(first) - 1, np.flatnonzero(first)
        self.end = np.append(self.start[1:], len(s)) - 1
        size = (self.end - self.start + 1).astype(np.uint64)
        runs = np.where(size > 1, mix(s[self.start] + size * MIX), s[self.start])
        self.runs, self.is_right = runs, (mix(runs ^ MIX) >> np.uint64(63)).astype(bool)
        second = np.zeros(len(runs), bool)
        second[1:] = self.is_right[1:] & ~self.is_right[:-1]
        self.at = np.cumsum(~second) - 1
        heads = np.flatnonzero(~second)
        paired = np.append(second, False)[heads + 1]
        self.next = np.where(paired, mix(mix(runs[heads]) * MIX + runs[np.minimum(heads + 1, len(runs) - 1)]), runs[heads])
        self.heads = self.start[heads]

    def inside(self, l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which stretches l..r of symbols have whole new ones inside whatever surrounds them, and these new ones' places.

        At its ends a run may go on outside, or a symbol may pair with an outer one; these are left out.
        """
        l, r = self.run[l] + 1, self.run[r] - 1
        on = np.flatnonzero(l <= r)
        l, r = l[on], r[on]
        l = l + self.is_right[l]
        r = r - ((l <= r) & ~self.is_right[r])
        keep = l <= r
        return on[keep], self.at[l[keep]], self.at[r[keep]]


def window_names(symbols: np.ndarray, window: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Names of the stretches of ``window`` symbols from ``starts`` on (all): equal for equal stretches, whatever surrounds them.

    A stretch's symbols are the same everywhere but at its two ends; these are taken off in each round, and the
    stretch's name is the hash of all that was taken off, which tells the stretch in full.
    """
    starts = np.arange(max(0, len(symbols) - window + 1)) if starts is None else starts
    n = len(starts)
    front, back = np.full(n, np.uint64(window)), np.full(n, np.uint64(1))
    live, l, r, s = np.arange(n), starts, starts + window - 1, symbols
    while len(live):
        own = Round(s)
        a, b = own.run[l], own.run[r]
        one = a == b
        front[live] = mix(front[live] * MIX ^ s[l] + np.where(one, r - l + 1, own.end[a] - l + 1).astype(np.uint64))
        two = live[~one]
        back[two] = mix(back[two] * MIX ^ s[r[~one]] + (r - own.start[b] + 1)[~one].astype(np.uint64))
        on = b - a >= 2
        live, l, r = live[on], a[on] + 1, b[on] - 1
        off = own.is_right[l]
        front[live[off]] = mix(front[live[off]] * MIX ^ own.runs[l[off]])
        l = l + off
        off = (l <= r) & ~own.is_right[r]
        back[live[off]] = mix(back[live[off]] * MIX ^ own.runs[r[off]])
        r = r - off
        on = l <= r
        live, l, r, s = live[on], own.at[l[on]], own.at[r[on]], own.next
    return mix(front ^ mix(back))


def high_symbols(words: np.ndarray) -> tuple[list[Round], np.ndarray, np.ndarray]:
    """The first LEVELS rounds over a sequence, the symbols after them, and the places of words where these start."""
    rounds, s, place = [], words, np.arange(len(words))
    for _ in range(LEVELS):
        rounds.append(Round(s))
        s, place = rounds[-1].next, place[rounds[-1].heads]
    return rounds, s, place


class Block:
    """A range of documents by doc_id as one sequence of words."""

    def __init__(self, block: pa.Table, window: int):
        self.rows = block.sort_by("doc_id").combine_chunks()
        text = self.rows["text"].combine_chunks() if isinstance(self.rows["text"], pa.ChunkedArray) else self.rows["text"]
        self.words, self.at = word_hashes(text)
        self.window = window
        inside = np.zeros(len(self.words) + 1, np.int64)
        has = np.flatnonzero(np.diff(self.at) >= window)
        np.add.at(inside, self.at[has], 1)
        np.add.at(inside, self.at[has + 1] - window + 1, -1)
        #: Windows that lie within a document, and the doc_id of every word.
        self.starts = np.flatnonzero(np.cumsum(inside) > 0)
        self.ids = np.repeat(self.rows["doc_id"].to_numpy(), np.diff(self.at))

    def stretches(self) -> Iterator[tuple[int, np.ndarray]]:
        """The words, some at a time, each time with those that the last windows still need."""
        for k in range(0, max(1, len(self.words) - self.window + 1), AT_ONCE):
            yield k, self.words[k : k + AT_ONCE + self.window - 1]

    def symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """Different high-level symbols, ascending, and which of them several documents of the range have."""
        found = [(s, self.ids[k + place]) for k, words in self.stretches() if len(words) for _, s, place in (high_symbols(words),)]
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        s, ids = map(np.concatenate, zip(*found))
        order = np.argsort(s, kind="stable")  # documents stand by doc_id, so the first and last of equals are furthest apart
        s, ids = s[order], ids[order]
        edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        return s[edge], ids[edge] != ids[np.append(edge[1:], len(s)) - 1]

    def revealed(self, shared: np.ndarray) -> np.ndarray:
        """Which windows within documents have no symbol inside that only one document has; ``shared`` is ascending."""
        out = np.ones(len(self.words), bool)
        for k, words in self.stretches():
            n = len(words) - self.window + 1
            if n <= 0:
                continue
            rounds, s, _ = high_symbols(words)
            live, l, r = np.arange(n), np.arange(n), np.arange(n) + self.window - 1
            for own in rounds:
                on, l, r = own.inside(l, r)
                live = live[on]
            near = np.minimum(np.searchsorted(shared, s), max(0, len(shared) - 1))
            alone = shared[near] != s if len(shared) else np.ones(len(s), bool)
            before = np.concatenate(([0], np.cumsum(alone)))
            out[k + live] = before[r + 1] == before[l]
        return out[self.starts]

    def named(self, revealed: np.ndarray) -> None:
        """Names the windows that are revealed: by recompression, and by a second hash that tells them apart should those agree by chance."""
        self.starts = self.starts[revealed]
        cut = np.searchsorted(self.starts, np.arange(0, max(1, len(self.words)), AT_ONCE))
        parts = zip(self.stretches(), np.split(self.starts, cut[1:]))
        names = [window_names(words, self.window, starts - k) for (k, words), starts in parts]
        names = np.concatenate(names) if len(self.starts) else np.zeros(0, np.uint64)
        checks = Stretches(mix(self.words ^ MIX))(self.starts, self.starts + self.window) if len(self.starts) else names
        order = np.lexsort((checks, names))  # stable, so the first of equals has the smallest doc_id
        names, checks = names[order], checks[order]
        new = np.ones(len(order), bool)
        new[1:] = (names[1:] != names[:-1]) | (checks[1:] != checks[:-1])
        self.names, self.checks, self.first = names[new], checks[new], self.ids[self.starts][order][new]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1


def repeated(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): every text without the words of stretches that an earlier one has.

    A word goes if it lies in a stretch of ``window`` words that also starts in a document with a smaller doc_id;
    stretches are judged on the input. Documents come in ranges of doc_id.

    1. Every range recompresses its words for LEVELS rounds and sends its different high-level symbols, sorted and cut
       into groups by their leading bits; a group tells which symbols several ranges have, as one bit each.
    2. All occurrences of a stretch have the same symbols inside, so a stretch that repeats has none that only one
       document has. The windows left (those too uniform to hold a symbol are among them) are named by the symbols that
       are taken off their ends round by round, and sent as before, with a second, independent hash of their words that
       verifies them; a group tells which names an earlier range has.
    3. The range drops these and what repeats within it.
    A stretch that very many documents share is one symbol or name for each range, so no group holds more of it than
    there are ranges. The text is shuffled once, for all three steps.

    Null and empty texts have no words; a text of any length is read whole. Rows with the same doc_id don't shorten each
    other; rows without doc_id are kept whole and shorten none; repeated rows each keep a row. An empty table gives no
    rows; other columns are not read. Two of m different stretches agree by chance with probability m * m / 2 ** 129.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    ranges = max(1, -(-(size["b"] or 0) // RANGE_BYTES))
    bits = max(0, ((size["b"] or 0) // 6 // GROUP_NAMES).bit_length())
    rows, _ = ordered_ranges(rows, "doc_id", ranges)
    known, loose = rows.where("doc_id is not null"), rows.where("doc_id is null")

    def edges(own: np.ndarray) -> np.ndarray:
        """Where each group of the ascending names starts, and the end."""
        return np.append(np.searchsorted(own, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else 0, len(own))

    def parcels(number: int, own: np.ndarray, checks: np.ndarray | None = None, more: tuple[int, bytes] | None = None) -> pa.Table:
        cut = edges(own)
        on = np.flatnonzero(np.diff(cut)).tolist()
        names = [squeeze(own[cut[g] : cut[g + 1]]) for g in on]
        said = [checks[cut[g] : cut[g + 1]].tobytes() if checks is not None else b"" for g in on]
        if more:
            on, names, said = [*on, more[0]], [*names, more[1]], [*said, b""]
        return pa.table({"range": pa.array([number] * len(on), pa.int64()), "group": pa.array(on, pa.int64()), "names": pa.array(names, pa.binary()), "checks": pa.array(said, pa.binary())})

    def answers(own: np.ndarray, marks: pa.Table) -> np.ndarray:
        """The bits that the groups returned for the names of a range."""
        out, cut = np.zeros(len(own), bool), edges(own)
        for g, packed in zip(marks["group"].to_pylist(), marks["again"].to_pylist()):
            if g >= 0:
                out[cut[g] : cut[g + 1]] = np.unpackbits(np.frombuffer(packed, np.uint8), count=cut[g + 1] - cut[g])
        return out

    def meet(group: pa.Table, elsewhere: bool) -> pa.Table:
        """For every name of every range: has an earlier range the same (or, elsewhere, any other)?"""
        group = group.sort_by("range")
        lists = [expand(b) for b in group["names"].to_pylist()]
        names = np.concatenate(lists)
        said = b"".join(group["checks"].to_pylist())
        checks = np.frombuffer(said, np.uint64) if said else np.zeros(len(names), np.uint64)
        order = np.lexsort((checks, names))
        like = (names[order[1:]] == names[order[:-1]]) & (checks[order[1:]] == checks[order[:-1]])
        again = np.zeros(len(names), bool)
        again[order[1:]] = like
        if elsewhere:
            again[order[:-1]] |= like
        found = np.split(again, np.cumsum([len(x) for x in lists])[:-1])
        on = [(r, g, bits_) for r, g, bits_ in zip(group["range"].to_pylist(), group["group"].to_pylist(), found) if bits_.any()]
        return pa.table({"range": pa.array([r for r, _, _ in on], pa.int64()), "group": pa.array([g for _, g, _ in on], pa.int64()), "again": pa.array([np.packbits(x).tobytes() for _, _, x in on], pa.binary())})

    def send_symbols(key: tuple, block: pa.Table) -> pa.Table:
        return parcels(key[0].as_py(), Block(block, window).symbols()[0])

    def meet_symbols(key: tuple, group: pa.Table) -> pa.Table:
        return meet(group, True)

    def send_windows(key: tuple, block: pa.Table, marks: pa.Table) -> pa.Table:
        held = Block(block, window)
        own, several = held.symbols()
        revealed = held.revealed(own[several | answers(own, marks)])
        held.named(revealed)
        number = key[0].as_py()
        return parcels(number, held.names, held.checks, (-1 - number, np.packbits(revealed).tobytes()))

    def meet_windows(key: tuple, group: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:  # a range's note to itself: which windows it has named
            return pa.table({"range": group["range"], "group": group["group"], "again": group["names"]})
        return meet(group, False)

    def drop(key: tuple, block: pa.Table, marks: pa.Table) -> pa.Table:
        held = Block(block, window)
        note = next((packed for g, packed in zip(marks["group"].to_pylist(), marks["again"].to_pylist()) if g < 0), b"")
        held.named(np.unpackbits(np.frombuffer(note, np.uint8), count=len(held.starts)).astype(bool))
        again = answers(held.names, marks)[held.place] | (held.first[held.place] < held.ids[held.starts])
        return rest(held.rows, held.at, covered(int(held.at[-1]), held.starts[again], window))

    def rest(block: pa.Table, at: np.ndarray, gone: np.ndarray) -> pa.Table:
        texts = []
        for i, j, t in zip(at[:-1].tolist(), at[1:].tolist(), block["text"].to_pylist()):
            words = t.encode().split()
            texts.append(b" ".join(compress(words, (~gone[i:j]).tolist()) if gone[i:j].any() else words))
        before = np.concatenate(([0], np.cumsum(gone)))
        return pa.table({"doc_id": block["doc_id"], "n_words": pa.array(np.diff(at)), "n_removed": pa.array(before[at[1:]] - before[at[:-1]]), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts]), "kept": pa.array([t.decode() for t in texts])})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = pa.Table.from_batches([batch])
            at = np.concatenate(([0], np.cumsum([len(t.encode().split()) for t in block["text"].to_pylist()]))).astype(np.int64)
            yield from rest(block, at, np.zeros(at[-1], bool)).to_batches()

    fields, sent, told = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string", "range long, group long, names binary, checks binary", "range long, group long, again binary"
    symbols = known.groupBy("range").applyInArrow(send_symbols, sent).groupBy("group").applyInArrow(meet_symbols, told)
    windows = known.groupBy("range").cogroup(symbols.groupBy("range")).applyInArrow(send_windows, sent).groupBy("group").applyInArrow(meet_windows, told)
    done = known.groupBy("range").cogroup(windows.groupBy("range")).applyInArrow(drop, fields)
    return done.unionByName(loose.select("doc_id", "text").mapInArrow(whole, fields))


def squeeze(ascending: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, in just as many whole bytes each as the largest needs."""
    steps = np.diff(ascending, prepend=np.uint64(0))
    lead, steps = steps[:1], steps[1:]
    wide = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([wide]) + lead.astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def expand(packed: bytes) -> np.ndarray:
    wide = packed[0]
    body = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, wide)
    steps = np.zeros((len(body) + 1, 8), np.uint8)
    steps[0] = np.frombuffer(packed[1:9], np.uint8)
    steps[1:, :wide] = body
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def op8_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")
