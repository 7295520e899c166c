"""Words of whole texts as hashes, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from .common import SPACE, buffers, chunks

MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Stretches:
    """Hashes of stretches of a word sequence, from prefix sums of words times powers of an odd number modulo 2 ** 64."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        power = np.full(n + 1, MIX)
        power[0] = 1
        self.inverse = np.full(n + 1, np.uint64(pow(int(MIX), -1, 1 << 64)))
        self.inverse[0] = 1
        power, self.inverse = np.cumprod(power), np.cumprod(self.inverse)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[:-1])))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * MIX)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of anything but ASCII white space) of every text, flattened, and offsets by text."""
    data, offsets = buffers(column)
    coded, at = chunks(data, offsets)
    names = np.array([xxhash.xxh3_64_intdigest(w) if (w := t.strip(b" \t\n\x0b\x0c\r")) else 0 for t in coded.dictionary.to_pylist()] or [0], np.uint64)
    blank = np.array([not t.strip(b" \t\n\x0b\x0c\r") for t in coded.dictionary.to_pylist()] or [True])
    codes = coded.indices.to_numpy()
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    real = ~blank[codes]
    before = np.concatenate(([0], np.cumsum(real)))
    return names[codes[real]], before[at]


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where the words of one text start and end."""
    blank = SPACE[np.frombuffer(b" " + text + b" ", np.uint8)]
    turn = np.flatnonzero(blank[1:] != blank[:-1])
    return turn[::2], turn[1::2]


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n words lie in a span of ``length`` words from one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0
