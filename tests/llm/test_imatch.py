import hashlib
import struct
from collections import Counter

import pytest
import regex
import xxhash

from factgate.llm import imatch


def edited(rows):
    ids = sorted((i, t or "") for i, t in rows if i is not None)
    out = []
    for k, (i, t) in enumerate(ids):
        after = ids[(k + 1) % len(ids)][1]
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("range_rows", [500, 3])
def test_edits_and_likeness(docs, rows, monkeypatch, range_rows):
    monkeypatch.setattr(imatch, "RANGE_ROWS", range_rows)
    got = imatch.fingerprints(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got if r.doc_id is not None) == edited(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = {}
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", set()).add(i)
    for r in got:
        for t, ids in texts.items():
            if len(ids) > 1 and r.doc_id in ids and [x for x, y in rows if x == r.doc_id] == [r.doc_id]:
                by.setdefault(t, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values())


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = imatch.op3_imatch(spark, sf).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == edited(rows)
    mean = lambda f: sum(map(f, got)) / len(got)
    assert mean(lambda r: r.near_edited) > mean(lambda r: r.near_next)


def test_one_and_none(spark, none):
    assert imatch.fingerprints(none).count() == 0
    one = imatch.fingerprints(spark.createDataFrame([(1, "one two three")], "doc_id long, text string")).first()
    assert one.n_chars == 13 and one.near_next == 1.0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xxh(raw, seed=42):
    return xxhash.xxh64_intdigest(raw, seed & (2**64 - 1))


def murmur(x):
    """Spark's 32-bit hash of a 64-bit number."""
    mask, h = 0xFFFFFFFF, 42
    for half in (x & mask, (x >> 32) & mask):
        k = half * 0xCC9E2D51 & mask
        k = (k << 15 | k >> 17) & mask
        h ^= k * 0x1B873593 & mask
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    h ^= 8
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * by & mask
    return h - (1 << 32) if h >> 31 else h


def by_hand(rows):
    """doc_id: (fingerprint, edited fingerprint, likeness to the edited and to the next), one text after the other."""
    ids = sorted((i, t or "") for i, t in rows)
    split = lambda t: {signed(xxh(w.encode())) for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w}
    df = Counter(w for _, t in ids for w in split(t))
    band = {w for w, n in df.items() if max(2, 2e-4 * len(ids)) <= n <= max(2, 0.05 * len(ids))}

    def signature(t):
        held = sorted(signed(xxh(struct.pack("<i", murmur(w & (2**64 - 1))))) for w in split(t) & band)
        if not held:
            return [signed(xxh(struct.pack("<i", k), xxh(struct.pack("<q", signed(xxh(t.encode())))))) for k in range(len(imatch.SUBSETS))]
        out = []
        for bits, at, value in imatch.SUBSETS:
            own, h = [x for x in held if (x & (2**64 - 1)) >> at & ((1 << bits) - 1) == value], 42
            for x in own:
                h = xxh(struct.pack("<q", x), h)
            out.append(signed(h) if own else 0)
        return out

    def like(a, b):
        either = sum(x != 0 or y != 0 for x, y in zip(a, b))
        return sum(x == y != 0 for x, y in zip(a, b)) / either if either else 1.0

    text = lambda sig: "".join(f"{x & 0xFFFFFFFF:08x}" for x in sig)
    sigs = [signature(t) for _, t in ids]
    out = {}
    for k, (i, t) in enumerate(ids):
        after, half = ids[(k + 1) % len(ids)][1], len(t) // 2
        edit = signature(t[: len(t) - half] + after[:half])
        out[i] = (text(sigs[k]), text(edit), like(sigs[k], edit), like(sigs[k], sigs[(k + 1) % len(ids)]))
    return out


def test_query_by_hand(spark, sf):
    """Band, sorted terms, subsets, fingerprints and both likenesses, computed apart from Spark."""
    want = by_hand([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    got = {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in imatch.op3_imatch(spark, sf).collect()}
    assert set(got) == set(want)
    for i, (a, b, x, y) in want.items():
        assert got[i][:2] == (a, b)
        assert got[i][2:] == pytest.approx((x, y))
