"""Byte-level BPE in numpy: padded matrices of pieces of like length, merged round by round, and its two vocabularies."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, chunks, documents, ragged, slices

#: Pieces longer than this many bytes merge through a heap instead of a matrix, whose work grows with the square of a
#: piece: 64 KB in pieces of 1 KB take 0.3 s (heap: 3.3 s), of 4 KB 1.1 s (2.2 s), of 16 KB 4.1 s (2.1 s). Ids are equal.
LONG = 4096
#: Bytes of pieces in a matrix.
MATRIX = 1 << 21
#: Different stretches of text whose ids a worker keeps for later batches.
HELD = 400_000
NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: White space outside ASCII and the ASCII cases that regular expressions count differently; texts with any are cut whole.
ODD_SPACE = regex.compile("[\x1c-\x1f\x85\xa0  -     　]")


class Pairs:
    """Open-addressing hash table from a pair of ids to (rank, merged id)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(len(keys) * 3 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.rank, self.merged = np.full(1 << bits, NONE), np.zeros(1 << bits, np.int32)
        todo, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            _, first = np.unique(np.where(free, slot[todo], -1 - np.arange(len(todo))), return_index=True)
            won = todo[first[free[first]]]
            self.keys[slot[won]], self.rank[slot[won]], self.merged[slot[won]] = keys[won], rank[won], merged[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            todo = todo[lost[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, or -1; negative ids never pair."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32).astype(np.uint64)
        slot, out = self._slot(keys), np.full(keys.shape, -1, np.int64)
        open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        keys, slot, flat = keys.ravel(), slot.ravel(), out.ravel()
        for _ in range(self.probes):
            at = slot[open_]
            held = self.keys[at]
            hit = held == keys[open_]
            flat[open_[hit]] = at[hit]
            go = ~hit & (held != np.uint64(2**64 - 1))
            open_ = open_[go]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
        return flat.reshape(out.shape)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        slot = self.find(left, right)
        return np.where(slot >= 0, self.rank[slot], NONE)


class Vocabulary:
    """What encoding needs: ids of single bytes (and of a last byte, where words have ends), pairs, whole pieces, the cut."""

    def __init__(self, first: np.ndarray, last: np.ndarray, pairs: Pairs, whole: dict[bytes, int], split: Callable[[str], list[str]], tokens: list[bytes]):
        self.first, self.last, self.pairs, self.whole, self.split = first, last, pairs, whole, split
        self.token_offsets = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.seen: dict[bytes, int] = {}
        self.seen_ids, self.seen_offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, flattened, and their offsets."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        counts, found = np.zeros(len(pieces), np.int64), []
        low = 1
        while low <= LONG:
            rows = np.flatnonzero((lengths >= low) & (lengths < 2 * low) & (lengths <= LONG))
            most = max(1, MATRIX // (2 * low))
            for k in range(0, len(rows), most):
                part = rows[k : k + most]
                for who, n, ids in self._matrix([pieces[i] for i in part], lengths[part]):
                    counts[part[who]] = n
                    found.append((part[who], n, ids))
            low *= 2
        for i in np.flatnonzero(lengths > LONG):
            ids = self._heap(pieces[i])
            counts[i] = len(ids)
            found.append((np.array([i]), np.array([len(ids)]), ids))
        offsets = np.concatenate(([0], np.cumsum(counts)))
        flat = np.zeros(offsets[-1], np.int32)
        for who, n, ids in found:
            inner = np.concatenate(([0], np.cumsum(n)))
            flat[np.repeat(offsets[who] - inner[:-1], n) + np.arange(inner[-1])] = ids
        return flat, offsets

    def _matrix(self, pieces: list[bytes], lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Length-bucketed rows; each round every row merges its leftmost pair of minimum rank; finished rows leave."""
        wide = int(lengths.max())
        raw = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in pieces), np.uint8).reshape(-1, wide)
        column = np.arange(wide)
        ids = np.where(column < lengths[:, None], self.first[raw], np.int32(-1))
        ids[np.arange(len(ids)), lengths - 1] = self.last[raw[np.arange(len(ids)), lengths - 1]]
        rows = np.arange(len(ids))
        rank = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if rank.shape[1]:
                at = rank.argmin(1)
                live = rank[np.arange(len(rows)), at] != NONE
            else:
                live = np.zeros(len(rows), bool)
            if not live.all():
                out = ids[~live]
                full = out >= 0
                yield rows[~live], full.sum(1), out[full]
                if not live.any():
                    return
                ids, rank, rows, at = ids[live], rank[live], rows[live], at[live]
            k = np.arange(len(rows))
            merged = self.pairs.merged[self.pairs.find(ids[k, at], ids[k, at + 1])]
            later = column[1:-1] > at[:, None]  # columns after the merged one take their right neighbour
            new = ids[:, :-1].copy()
            new[:, 1:] = np.where(later, ids[:, 2:], ids[:, 1:-1])
            new[k, at] = merged
            ids = new
            fresh = rank[:, :-1].copy()
            if fresh.shape[1]:
                fresh[:] = np.where(column[: fresh.shape[1]] >= at[:, None], rank[:, 1:], fresh)
                left = np.flatnonzero(at > 0)
                fresh[left, at[left] - 1] = self.pairs.ranks(ids[left, at[left] - 1], ids[left, at[left]])
                right = np.flatnonzero(at < ids.shape[1] - 1)
                fresh[right, at[right]] = self.pairs.ranks(ids[right, at[right]], ids[right, at[right] + 1])
            rank = fresh
            column = np.arange(ids.shape[1])

    def _heap(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, in n log n steps."""
        raw = np.frombuffer(piece, np.uint8)
        ids = self.first[raw].copy()
        ids[-1] = self.last[raw[-1]]
        slots = self.pairs.find(ids[:-1], ids[1:])
        ids, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(int(self.pairs.rank[s]), i, ids[i], ids[i + 1]) for i, s in enumerate(slots.tolist()) if s >= 0]
        heapq.heapify(queue)
        table: dict[tuple[int, int], tuple[int, int]] = {}

        def look(a: int, b: int) -> tuple[int, int]:
            if (a, b) not in table:
                s = int(self.pairs.find(np.array([a]), np.array([b]))[0])
                table[a, b] = (int(self.pairs.rank[s]), int(self.pairs.merged[s])) if s >= 0 else (-1, -1)
            return table[a, b]

        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = look(a, b)[1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := look(ids[x], ids[y])[0]) >= 0:
                    heapq.heappush(queue, (r, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every text, flattened, and offsets by text. Repeated stretches between white space are merged once."""
        data, offsets = buffers(column)
        odd = [i for i in range(len(column)) if ODD_SPACE.search(str(data[offsets[i] : offsets[i + 1]].tobytes(), "utf-8"))] if ODD_SPACE.search(data.tobytes().decode()) else []
        if odd:  # these are cut whole, the others chunk by chunk
            texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(column))]
            parts = {i: self._unique([texts[i]]) for i in odd}
            rest = pa.array([b"" if i in parts else t for i, t in enumerate(texts)], pa.large_binary())
            flat, at = self.encode(rest)
            both = [parts[i][0] if i in parts else flat[at[i] : at[i + 1]] for i in range(len(texts))]
            return np.concatenate(both), np.concatenate(([0], np.cumsum([len(b) for b in both]))).astype(np.int64)
        coded, at = chunks(data, offsets)
        flat, inner = self._unique(coded.dictionary.to_pylist())
        ids, ends = ragged(flat, inner, coded.indices.to_numpy())
        return ids, ends[at]

    def _unique(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different texts, flattened, and their offsets. What a worker has merged it looks up for later batches."""
        if len(self.seen) > HELD:
            self.seen, self.seen_ids, self.seen_offsets = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        seen = self.seen
        fresh = [t for t in texts if t not in seen]
        if fresh:
            known: dict[bytes, int] = {}
            rows, counts = [], np.zeros(len(fresh), np.int64)
            for k, t in enumerate(fresh):
                seen[t] = len(seen)
                cut = self.split(t.decode())
                counts[k] = len(cut)
                for p in cut:
                    rows.append(known.setdefault(p, len(known)))
            pieces = list(known)
            whole = np.array([self.whole.get(p, -1) for p in pieces], np.int32)
            flat, inner = self.merge([b"\0" if w >= 0 else p for p, w in zip(pieces, whole.tolist())])
            flat[inner[:-1][whole >= 0]] = whole[whole >= 0]
            ids, ends = ragged(flat, inner, np.array(rows, np.int64))
            self.seen_ids = np.concatenate((self.seen_ids, ids))
            self.seen_offsets = np.concatenate((self.seen_offsets, self.seen_offsets[-1] + ends[np.cumsum(counts)]))
        return ragged(self.seen_ids, self.seen_offsets, np.fromiter(map(seen.__getitem__, texts), np.int64, len(texts)))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the tokens, flattened, and offsets by text."""
        data, ends = ragged(self.token_bytes, self.token_offsets, ids.astype(np.int64))
        return data, ends[offsets]


def from_ranks(path: str, pattern: str) -> Vocabulary:
    """A vocabulary of token bytes by rank: any two neighbours whose bytes together are a token may merge, at its rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    found = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    left, right, rank = np.array(found, np.int64).T
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    cut = regex.compile(pattern)
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    return Vocabulary(single, single, Pairs(left, right, rank.astype(np.int32), rank.astype(np.int32)), ranks, lambda s: [p.encode() for p in cut.findall(s)], tokens)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


def from_json(path: str) -> Vocabulary:
    """A lower-casing vocabulary with word ends, given as ordered merges; white space is dropped."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, end = spec["model"], spec["model"]["end_of_word_suffix"]
    pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    ids, letter = model["vocab"], byte_letters()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left, right, merged = (np.array(x, np.int64) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in merges)))
    cut = regex.compile(pattern)  # takes no white space, so neither changing nor dropping it needs a step
    by = {c: b for b, c in letter.items()}
    tokens = [b""] * (max(ids.values()) + 1)
    for t, i in ids.items():
        body = t.removesuffix(end)
        tokens[i] = bytes(by[c] for c in body if c in by) + (b" " if body != t else b"")

    def split(s: str) -> list[str]:
        if not s.isascii():
            s = unicodedata.normalize("NFC", s)
        low = s.lower() if "Σ" not in s else "".join(c.lower() for c in s)  # one letter at a time: no final sigma
        return [p.encode() for p in cut.findall(low)]

    return Vocabulary(np.array([ids[letter[b]] for b in range(256)], np.int32), np.array([ids[letter[b] + end] for b in range(256)], np.int32), Pairs(left, right, np.arange(len(merges), dtype=np.int32), merged.astype(np.int32)), {}, split, tokens)


_held: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str | None = None) -> Vocabulary:
    """The vocabulary of a file, read once in each worker."""
    key = (path, pattern or "")
    if key not in _held:
        _held[key] = from_ranks(path, pattern) if pattern else from_json(path)
    return _held[key]


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the token ids of every whole text as little-endian unsigned 32-bit numbers, and the bytes they stand for.

    Null and empty texts have no ids, an empty table gives no rows, texts of any length are encoded whole. Repeated rows
    are encoded each; other columns, whatever their names, are not read. A row's work depends on that row alone, so
    nothing is shuffled and a lost task only repeats its own rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in slices(batches, 1):
            ids, at = words.encode(batch.column(1))
            data, ends = words.decode(ids, at)
            raw = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
            text_ = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), raw.cast(pa.binary()), text_.cast(pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode``, digested in the same task so that no ids leave it; all else as there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in slices(batches, 1):
            ids, at = words.encode(batch.column(1))
            data, ends = words.decode(ids, at)
            raw, data = memoryview(ids.astype("<u4").tobytes()), memoryview(data.tobytes())
            sha = lambda b: hashlib.sha256(b).hexdigest()
            one = [sha(raw[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            two = [sha(data[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(one), pa.array(two)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
