import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factgate.llm import common, simhash

from test_documents import SPACE, fingerprint


def shingle_set(text, size=5):
    words = SPACE.findall((text or "").encode().lower())
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def kept(rows, bits=2):
    """Ids that stay, comparing all pairs."""
    seen = [(shingle_set(t), fingerprint(t, 5)) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, (s, f) in enumerate(seen):
        for j, (t, g) in enumerate(seen[:i]):
            if (f ^ g).bit_count() <= bits or 10 * len(s & t) >= 8 * len(s | t):
                comp[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return set(least.values())


def test_edited_copies_go(spark):
    """Copies with words replaced, at similarities from 0.8 to 0.95, most of them far over two bits apart."""
    draw = random.Random(3)
    say = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    rows, wanted = [], set()
    for i in range(0, 240, 2):
        words = say(300)
        other, edits = list(words), 1 + i // 2 % 6
        for k in range(edits):
            other[25 + 45 * k] = "edited"
        rows += [(i, " ".join(words)), (i + 1, " ".join(other))]
        s, t = shingle_set(rows[-2][1]), shingle_set(rows[-1][1])
        assert 0.8 <= len(s & t) / len(s | t) < 0.97
        wanted.add(i)
    far = sum((fingerprint(a[1], 5) ^ fingerprint(b[1], 5)).bit_count() > 2 for a, b in zip(rows[::2], rows[1::2]))
    assert far > 60
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    got = {r.doc_id for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()}
    assert got == wanted == kept(rows)


def test_against_all_pairs(docs, rows, none, spark, sf):
    got = simhash.keep_one_alike(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(kept(rows)) and ids.count(None) == 2
    assert simhash.keep_one_alike(none).count() == 0
    table = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r.doc_id for r in simhash.keep_one_alike(table).collect()} == kept([(r.doc_id, r.text) for r in table.collect()])


def test_a_long_list_gives_few_links(spark, monkeypatch):
    """What a round writes is links between components, however many pairs its tasks look at."""
    monkeypatch.setattr(simhash, "ALL_PAIRS", 4)
    base = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join([*base[: 3 * i], "edited", *base[3 * i + 1 :]])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = simhash.marks(docs, 5)
    held = simhash.shingle_sets(docs, sets.select("name"), 5)
    lists = simhash.rarest(sets.select("name"), held, 0.8)
    state = lists.where(F.col("m") > 4).select("key", "name", "n", "at", F.lit(1).cast("long").alias("component"))
    assert simhash.pivots(state, None, simhash.PIVOTS).isEmpty()
    state = state.withColumn("component", F.pmod("name", F.lit(2)))
    taken = simhash.pivots(state, None, simhash.PIVOTS)
    assert {tuple(sorted(r)) for r in simhash.pivot_links(state, taken, held, 0.8).collect()} == {(0, 1)}
    assert [r.doc_id for r in simhash.keep_one_alike(docs).collect()] == [0]


def test_links_of_blocks_are_those_of_all_pairs(monkeypatch):
    """Members and pivots of many sizes, in small blocks, against sets compared one by one."""
    draw = np.random.default_rng(4)
    base = np.sort(draw.choice(1 << 40, 90, replace=False).astype(np.uint64))
    own = lambda: np.unique(np.concatenate([draw.choice(base, int(draw.integers(40, 90)), replace=False), draw.integers(1 << 41, 1 << 42, int(draw.integers(0, 12))).astype(np.uint64)]))
    rows = [(len(s), 0, c, s) for c, s in enumerate(own() for _ in range(120))]
    want = {(a[2], b[2]) for a in rows[:90] for b in rows[60:] if a[2] != b[2] and 10 * len(np.intersect1d(a[3], b[3])) >= 8 * len(np.union1d(a[3], b[3]))}
    assert 20 < len(want)
    for shingles, cells in ((1 << 16, 1 << 23), (100, 1000), (1, 1)):
        monkeypatch.setattr(simhash, "SHINGLES", shingles)
        monkeypatch.setattr(simhash, "CELLS", cells)
        assert simhash.met(rows[:90], rows[60:], 0.8) == want


def test_recall_of_planted_pairs(spark):
    """1,200 pairs alike at 0.8 to 0.95: every one is found, and texts alike at less than 0.75 stay apart."""
    draw = random.Random(9)
    say = lambda n: [f"w{draw.randrange(20000)}" for _ in range(n)]
    rows, alike = [], 0
    while alike < 1200:
        words = say(draw.randrange(60, 160))
        other = list(words)
        for _ in range(draw.randrange(1, 4)):
            other[draw.randrange(len(words))] = "edited"
        s, t = shingle_set(" ".join(words)), shingle_set(" ".join(other))
        if 0.8 <= len(s & t) / len(s | t) <= 0.95:
            rows += [(2 * alike, " ".join(words)), (2 * alike + 1, " ".join(other))]
            alike += 1
    for k in range(100):
        words = say(60)
        rows += [(100_000 + 2 * k, " ".join(words)), (100_001 + 2 * k, " ".join(words[:45] + say(15)))]
    got = {r.doc_id for r in simhash.keep_one_alike(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {2 * k for k in range(1200)} | {100_000 + k for k in range(200)}


def test_long_lists_lose_no_link(spark, monkeypatch):
    """A chain of texts, each like its neighbours only, whose lists are all long, and many texts that share half of theirs."""
    monkeypatch.setattr(simhash, "ALL_PAIRS", 2)
    monkeypatch.setattr(simhash, "PIVOTS", 1)
    monkeypatch.setattr(simhash, "MEMBERS", 8)
    monkeypatch.setattr(simhash, "TAKEN", 3)
    draw = random.Random(5)
    say = lambda n: [f"w{draw.randrange(9000)}" for _ in range(n)]
    words, rows = say(300), []
    for i in range(25):
        rows.append((i, " ".join(words)))
        for k in range(5):
            words[(60 * k + 12 * i) % 300] = f"new{i}.{k}"
    half = say(150)
    rows += [(100 + i, " ".join([*half, *say(60)])) for i in range(25)]
    got = [r.doc_id for r in simhash.keep_one_alike(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got) == sorted(kept(rows)) and len(got) > 20


def test_different_texts_under_one_id(spark):
    """The copy goes, the other text under its doc_id stays; of repeated rows one stays."""
    t, u = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, t), (2, t), (2, u), (2, u)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for stage in (simhash.keep_one_alike, simhash.keep_one_each):
        assert sorted(tuple(r) for r in stage(df).collect()) == [(1, t), (2, u)]


def test_shared_bytes_are_counted(spark):
    draw = np.random.default_rng(2)
    rows = []
    for _ in range(50):
        a = draw.integers(0, 256, simhash.WIDE).astype(np.uint8)
        b = np.where(draw.random(simhash.WIDE) < 0.5, a, draw.integers(0, 256, simhash.WIDE)).astype(np.uint8)
        rows.append((a.view(np.int64).tolist(), b.view(np.int64).tolist(), int((a == b).sum())))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, n int")
    assert df.where(simhash.shared_bytes("a", "b") != F.col("n")).count() == 0
    assert 50 <= simhash.least_shared(0.8) <= 60


def test_columns_of_any_name(spark):
    rows = [(1, "a b c d e f g", "x", 5, "p", "q"), (2, "a b c d e f g", "y", 6, None, "q"), (3, "other words here that stand for themselves", "z", 7, "p", "q"), (None, "a b c d e f g", "w", 8, "p", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string, __h int, `k` string, `row` string").withColumnRenamed("row", "a.b")
    for keep in (simhash.keep_one_each, simhash.keep_one_alike):
        got = keep(docs)
        assert got.columns == docs.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[0], rows[2], rows[3]], key=repr)


# -- the pipeline's check: rounds over links


@pytest.mark.parametrize("most", [8, 1 << 18])
def test_links_that_one_task_can_unite_take_no_rounds(spark, monkeypatch, most):
    rng, written, keep = np.random.default_rng(3), [], common.durable
    monkeypatch.setattr(common, "durable", lambda df: (written.append(1), keep(df))[1])
    monkeypatch.setattr(common, "LINKS", most)
    ends = np.concatenate((np.column_stack((np.arange(300), np.arange(1, 301))), rng.integers(1000, 1300, (150, 2)))) - 700
    want = list(range(-700, 700))
    for a, b in ends.tolist():
        low, high = sorted((want[a + 700], want[b + 700]))
        want = [low if x == high else x for x in want]
    links = spark.createDataFrame([*ends.tolist(), (None, 5), (9, 9)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in common.components(links).collect()}
    assert got == {int(k): want[k + 700] for k in np.unique(ends[ends[:, 0] != ends[:, 1]])}
    assert most == 8 or len(written) <= 2
    assert common.components(links.where("a is null")).count() == 0
