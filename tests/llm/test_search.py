import math
import random
import re
from collections import Counter

import pytest

from factgate.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    held = [(i, t) for i, x in docs if (t := terms(x))]
    total, length = len(held), sum(len(t) for _, t in held)
    df = Counter(w for _, t in held for w in set(t))
    counts = [(i, len(t), Counter(t)) for i, t in held if i is not None]
    out = []
    for item, text in {(i, x) for i, x in items if x is not None}:
        asked, found = Counter(terms(text)), []
        for i, n, tf in counts:
            m = 100 - 25 + (25 * n * total) // length
            score = sum(c * math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 12 * m)) for w, c in asked.items() if w in tf)
            if score > 0:
                found.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(rows):
    draw = random.Random(3)
    texts = [t for _, t in rows if t]
    cut = lambda t: " ".join(draw.sample(t.split(), min(len(t.split()), draw.choice([1, 3, 12])))) + " THE of of"
    out = [(i, cut(draw.choice(texts))) for i in range(40)]
    out += [(40, None), (41, ""), (42, " .-, "), (43, "nowhere"), (44, out[0][1]), (0, out[0][1]), (45, texts[0] + " " + texts[60]), (45, "kappa1 kappa2"), (None, "iota3"), (46, "NAÏVE naïve Naïve3 1234"), (47, " ".join(w for t in texts for w in t.split()))]
    return out


@pytest.mark.parametrize("block, first, cells, item_bytes", [(32_768, 128, 1 << 24, 1 << 20), (30, 2, 500, 200)])
def test_against_all_scores(spark, docs, rows, items, monkeypatch, block, first, cells, item_bytes):
    for name, value in (("BLOCK", block), ("FIRST", first), ("CELLS", cells), ("ITEM_BYTES", item_bytes)):
        monkeypatch.setattr(search, name, value)
    monkeypatch.setattr(search, "POSTINGS", 100 if block == 30 else 1 << 23)
    asked = items[:12] + items[-11:-1] if block == 30 else items  # the small blocks take a pass each
    table = spark.createDataFrame([(i, t, 0, "x") for i, t in asked], "item_id long, text string, rank int, terms string")
    got = search.search(docs, table, 7)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, asked, 7)


def test_stops_before_all_are_scored(spark, docs, rows, monkeypatch):
    """Masks are grouped and bounded so that few documents of a block are scored."""
    import pyarrow as pa

    table = pa.table({"doc_id": pa.array(range(4000), pa.int64()), "text": ["common " * 3 + ("rare " if i % 100 == 0 else "") + ("middling " if i % 3 else "") for i in range(4000)]})
    coded, at = search.terms(table["text"].combine_chunks())
    names = {t: k for k, t in enumerate(coded.dictionary.to_pylist())}
    lists = [Counter(coded.indices.to_numpy()[i:j].tolist()) for i, j in zip(at[:-1], at[1:])]
    batch = pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(at[1:] - at[:-1]), pa.array([sorted(c) for c in lists], pa.list_(pa.int32())), pa.array([[c[t] for t in sorted(c)] for c in lists], pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])
    df = Counter(t for c in lists for t in c)
    weight = search.np.array([math.floor(1000 * math.log(8002 / (2 * df[k] + 1))) for k in range(len(names))])
    block = search.Block([batch], weight, 4000, int(at[-1]))
    masks, group = search.grouped(block.masks([slice(block.start[t], block.start[t + 1]) for t in range(len(names))]))
    assert len(masks) == len({tuple(sorted(c)) for c in lists}) and len(group) == 4000
    seen, whole = [], search.np.lexsort
    monkeypatch.setattr(search.np, "lexsort", lambda keys: seen.append(len(keys[0])) or whole(keys))
    ids, _ = block.best(search.np.arange(len(names)), search.np.ones(len(names), int), 20)
    assert sorted(ids.tolist()) == [i for i in range(4000) if i % 100 == 0 and i % 3][:20] and sum(seen) < 400


def test_nothing(spark, docs, none):
    items = spark.createDataFrame([(1, "alpha1")], "item_id long, text string")
    assert search.search(none, items).count() == search.search(docs, items.limit(0)).count() == 0
    assert search.search(none, items).columns == search.search(docs, items).columns
    assert search.search(docs.where("text is null or text = ''"), items).count() == 0


def test_query_against_all_scores(spark, sf):
    read = lambda t, i: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(i, "text").collect()]
    got = search.op13_lexical_search(spark, sf)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(read("documents", "doc_id"), read("benchmark", "item_id"))
