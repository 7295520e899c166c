import hashlib
from collections import defaultdict

import numpy as np
import pytest

from factgate.llm import recompress, suffixes


def brute(rows, length):
    """Per row: words and which go, by comparing all stretches of words."""
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - length + 1):
                key = tuple(w[k : k + length])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = np.zeros(len(w), bool)
        if i is not None:
            for k in range(len(w) - length + 1):
                if first[tuple(w[k : k + length])] < i:
                    gone[k : k + length] = True
        out.append((i, w, gone))
    return out


@pytest.mark.parametrize("window", [1, 2, 13])
def test_recompression_is_exact(docs, rows, window):
    want = sorted((str(i), len(w), int(g.sum()), hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest()) for i, w, g in brute(rows, window))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in recompress.repeated(docs, window).collect())
    assert got == want


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_recompression_over_many_ranges(docs, rows, monkeypatch, levels):
    monkeypatch.setattr(recompress, "LEVELS", levels)
    monkeypatch.setattr(recompress, "RANGE_BYTES", 2000)
    monkeypatch.setattr(recompress, "GROUP_NAMES", 100)
    want = sorted((str(i), int(g.sum())) for i, w, g in brute(rows, 13))
    assert sorted((str(r.doc_id), r.n_removed) for r in recompress.repeated(docs).collect()) == want


def test_recompression_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: (len(w), int(g.sum())) for i, w, g in brute(rows, 13)}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in recompress.op8_recompression_dedup(spark, sf).collect()} == want


def test_names_tell_stretches_apart():
    draw = np.random.default_rng(3)
    for kinds in (1, 2, 3, 40):
        base = draw.integers(0, 2**63, kinds).astype(np.uint64)
        seq = draw.integers(0, kinds, 2000)
        seq[1000:1100] = seq[100:200]
        seen = defaultdict(set)
        for k, name in enumerate(recompress.window_names(base[seq], 13).tolist()):
            seen[tuple(seq[k : k + 13])].add(name)
        assert all(len(v) == 1 for v in seen.values())
        assert len(set.union(*seen.values())) == len(seen)


@pytest.mark.parametrize("length, gram, run", [(50, 8, 4096), (20, 5, 4096), (9, 8, 4096), (50, 8, 3), (20, 5, 0)])
def test_suffixes_find_all_passages(docs, rows, monkeypatch, length, gram, run):
    monkeypatch.setattr(suffixes, "RUN", run)
    want = sorted((str(i), len(w), int(g.sum())) for i, w, g in brute(rows, length))
    got = suffixes.without_repeats(docs, length, gram).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in got) == want
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert bool(r.sources) == bool(r.spans) and all(s < r.doc_id for s in r.sources)


def test_suffix_query_leaves_whole_texts_as_they_are(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: (len(w), int(g.sum())) for i, w, g in brute(rows, 50)}
    got = suffixes.op4_suffix_array_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got} == want
    texts = dict(rows)
    for r in got:
        if not r.n_removed:
            assert r.kept_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_extension_in_both_directions(spark):
    """Pieces of one passage that start and end anywhere, so that the longest match to the left is not the longest to the right."""
    draw = np.random.default_rng(4)
    say = lambda n: [f"w{k}" for k in draw.integers(0, 10**6, n)]
    passage, rows = say(200), []
    for i in range(150):
        a = int(draw.integers(0, 170))
        b = min(200, a + int(draw.integers(20, 120)))
        rows.append((i, " ".join([*say(int(draw.integers(0, 30))), *passage[a:b], *say(int(draw.integers(0, 30)))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((i, len(w), int(g.sum())) for i, w, g in brute(rows, 50))
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in suffixes.without_repeats(df).collect()) == want
    assert sum(n for _, _, n in want) > 3000


def test_empty_tables(none):
    assert recompress.repeated(none).count() == 0
    assert suffixes.without_repeats(none).count() == 0
    assert suffixes.cut_repeats(none).count() == 0


def test_cut_keeps_other_columns(docs, rows):
    got = suffixes.cut_repeats(docs)
    assert got.columns == docs.columns
    want = sum(1 for i, w, g in brute(rows, 50) if not (len(w) and g.all()))
    assert got.count() == want
