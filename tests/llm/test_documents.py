import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from factgate.llm import langid, private, simhash, toxicity

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text, size=3):
    words = SPACE.findall((text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, bits=2):
    """Component of each (doc_id, fingerprint) row by comparing all pairs."""
    comp = list(range(len(prints)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= bits:
                comp[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [least.get(root(i)) for i in range(len(prints))]


def test_simhash_against_all_pairs(docs, rows):
    prints = [(i, fingerprint(t)) for i, t in rows]
    want = sorted((str(i), f"{f:016x}", str(c)) for (i, f), c in zip(prints, classes(prints)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect()) == want


def test_simhash_query(spark, sf):
    prints = [(r.doc_id, fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, f"{f:016x}", c) for (i, f), c in zip(prints, classes(prints)))
    assert sorted(tuple(r) for r in simhash.op5_simhash_near_dedup(spark, sf).collect()) == want


@pytest.mark.parametrize("most", [1024, 2])
def test_links_find_every_near_pair(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "LIST", most)
    draw = np.random.default_rng(9)
    base = draw.integers(0, 2**63, 6).astype(np.uint64)
    prints = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            x = int(b)
            for k in draw.choice(64, draw.integers(0, 6), replace=False):
                x ^= 1 << int(k)
            prints.add(x)
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    links = {(min(r.a & (2**64 - 1), r.b & (2**64 - 1)), max(r.a & (2**64 - 1), r.b & (2**64 - 1))) for r in simhash.near_fingerprints(df).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    want = classes([(x, x) for x in prints])
    comp = {x: x for x in prints}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        comp[max(a, b)] = min(a, b)
    assert [root(x) for x in prints] == want


def test_keep_one_each(docs, rows, none):
    got = simhash.keep_one_each(docs)
    assert got.columns == docs.columns
    prints = [(i, fingerprint(t, 5)) for i, t in rows]
    want = {c for (i, _), c in zip(prints, classes(prints)) if i is not None}
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) == sum(1 for i, _ in rows if i is None)
    assert simhash.keep_one_each(none).count() == simhash.near_duplicates(none).count() == 0


LANGS = {"en": "the and of to in is that it was for on are with as his they be at one have this from", "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch", "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se"}


@pytest.fixture(scope="module")
def spoken(spark):
    draw, out = np.random.default_rng(4), []
    for i in range(600):
        lang = list(LANGS)[i % 3]
        out.append((i, " ".join(draw.choice(LANGS[lang].split(), draw.integers(5, 80))), lang, "s"))
    out += [(1000, None, "en", "s"), (1001, "", None, "s"), (1002, "123 456 !!", "de", "s"), (1003, "die und der " * 30000, None, "s"), (None, "the and of to in is that it was", "en", "s")]
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string")


def test_languages(spoken):
    texts = langid.dictionaries(spoken)
    got = langid.identify(spoken, texts).join(spoken.select("doc_id", "lang"), "doc_id", "left").collect()
    assert len(got) == spoken.count()
    by = {r.doc_id: r for r in got}
    for k in (1000, 1001, 1002):
        assert (by[k].lang_pred, by[k].score, by[k].rejected) == ("und", 0.0, True)
    assert by[1003].lang_pred == "de" and by[None].lang_pred == "en"
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_are_not_learned_from_held_out_rows(spoken):
    from pyspark.sql import functions as F

    changed = spoken.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert langid.dictionaries(changed) == langid.dictionaries(spoken)


def test_identified_rows_stay_whole(spoken, none):
    kept = langid.keep_identified(spoken)
    assert kept.columns == spoken.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {1000, 1001, 1002} and len(ids) > 590
    assert langid.keep_identified(none).count() == 0


def test_language_query_accuracy(spark, sf):
    got = langid.op10_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)


def test_toxicity_finds_held_out_rows(spark):
    draw, rows, labels = np.random.default_rng(8), [], []
    calm = [f"word{k}" for k in range(300)]
    for i in range(1500):
        words = list(draw.choice(calm, 40))
        toxic = int(draw.random() < 0.15)
        if toxic:
            for k in draw.choice(40, 3, replace=False):
                words[k] = str(draw.choice(["zorbax", "zorbine", "idiot,", "flumpish", "flumper"]))
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 1, toxic))
        elif toxic:
            labels.append((i, 1, None))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, ""), (None, "idiot zorbax flumper")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (1, 1, labels[0][2])], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, marks).collect()}
    assert len(got) == 1503 and got[5000].score == got[5001].score < 0.3 and got[None].predicted == 1
    held = [(got[i], t) for i, _, t in labels if t is not None and zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(r.predicted == t for r, t in held) >= 0.97 * len(held)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    nothing = toxicity.score(docs, marks.limit(0)).collect()
    assert len(nothing) == 1503 and {r.score for r in nothing} == {0.0}
    assert toxicity.score(docs.limit(0), marks).count() == 0


def test_label_model_recovers_accuracies():
    draw = np.random.default_rng(6)
    y = (draw.random(20000) < 0.2).astype(int)
    right = [0.95, 0.9, 0.85, 0.8, 0.9]
    votes = np.stack([np.where(draw.random(len(y)) < a, y, 1 - y) for a in right], 1)
    votes = np.concatenate((votes, votes[:, -1:]), 1)  # the last repeats the one before
    made, n = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.LabelModel(made, n.astype(float), 0.2)
    assert np.allclose(model.table[1, :4, 1], right[:4], atol=0.06)
    assert model.correlation[4, 5] > 0.9 and model.weight[5] < 0.6


def entity_text(i):
    return f"mail bob.{i}@mail7.example.com, call +1 ({i % 900 + 100}) 555-{1000 + i % 9000}, card 45395787636{i % 100000:05d}, from 10.{i % 256}.3.{i % 199}. Dear Mr. David Smith{'abcdefghij'[i % 10]}"


def test_surrogates_hide_and_keep_apart(spark):
    rows = [(i, entity_text(i)) for i in range(60)] + [(100, None), (101, ""), (102, "nothing here to hide, 12 eggs"), (60, entity_text(3)), (3, entity_text(3)), (None, entity_text(4))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kinds string")
    got = private.surrogates(df, b"a key").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert by[100].text is None and by[101].text == "" and by[102].text == rows[62][1] and by[102].n_entities == 0
    for i in range(60):
        r, t = by[i], entity_text(i)
        for m in (re.search(r"\S+@\S+\.com", t)[0], re.search(r"\(\d+\) 555-\d+", t)[0], re.search(r"45395787636\d+", t)[0], re.search(r"10\.\d+\.3\.\d+", t)[0], "David", t.split()[-1]):
            assert m not in r.text
        assert re.sub(r"\d", "0", re.sub(r"[a-z]", "a", r.text.partition("Dear")[0])) == re.sub(r"\d", "0", re.sub(r"[a-z]", "a", t.partition("Dear")[0])) or "." in r.text
        assert set(r.kinds) == {"email", "phone", "card", "address", "name"}
    family = {entity_text(i).split()[-1]: by[i].text.split()[-1] for i in range(60)}
    assert len(set(family.values())) == len(family) == 10 and not set(family.values()) & set(family)
    assert private.surrogates(df.limit(0), b"a key").count() == 0


def test_replacements_are_bijections():
    key = b"k"
    cards = [f"45395787{i:08d}" for i in range(3000)]
    new = [private.surrogate("card", c, key) for c in cards]
    check = lambda c: private.luhn([int(x) for x in c[:-1]]) == int(c[-1])
    assert len(set(new)) == 3000 and [check(c) for c in cards] == [check(c) for c in new]
    for kind, values in (("address", [f"10.0.{i // 256}.{i % 256}" for i in range(2000)]), ("phone", [f"+1 (200) 555-{i:04d}" for i in range(2000)]), ("secret", [f"{i:016x}abcd" for i in range(2000)]), ("email", [f"u{i}@x.org" for i in range(2000)])):
        new = [private.surrogate(kind, v, key) for v in values]
        assert len(set(new)) == len(values) and not set(new) & {v for v, w in zip(values, new) if v == w}
        if kind != "address":
            assert Counter(map(len, new)) == Counter(map(len, values))


def test_names_stay_apart_when_draws_collide(spark, monkeypatch):
    monkeypatch.setattr(private, "invented", lambda part, gender, script, name, attempt, key: f"X{len(name) % 2}{attempt}")
    rows = spark.createDataFrame([(k, f"Mr. {a} Dr. {b}") for k, (a, b) in enumerate((("Ab", "Abc"), ("Abcd", "Abcde"), ("Xy", "Xyz")))], "row long, text string")
    got = {r.value: r.new for r in private.name_surrogates(private.entities(rows, b"k"), b"k").collect()}
    assert len(got) == 6 and len(set(got.values())) == 6


def test_voters_that_know_no_labels():
    import pyarrow as pa

    texts = ["a calm word", "you are such an idiot", "shut up now", "we hate them all", "what a moron!", "lost and found", None, "sjerk clownfish", "the pig is ugly"]
    column = pa.array(texts)
    counts, size = toxicity.Terms(["=zorb", *toxicity.SAID])(column)
    votes = toxicity.votes_of(counts, size, 1, column)
    kinds = 1 + len(toxicity.INSULTS)
    any_, by, phrases = votes[:, 0], votes[:, 1:kinds], votes[:, kinds : kinds + len(toxicity.PHRASES)]
    assert any_.tolist() == [0, 1, 0, 0, 1, 0, 0, 0, 1]
    assert by[1].tolist() == [1, 2, 2] and by[8].tolist() == [2, 2, 1]
    assert phrases.tolist() == [[2, 2, 2, 2], [2, 2, 1, 1], [1, 2, 2, 2], [2, 1, 2, 2], [2, 2, 2, 1], [2, 2, 2, 2], [2] * 4, [2] * 4, [2] * 4]
    assert set(votes[:, kinds + len(toxicity.PHRASES) :].ravel().tolist()) == {0}


def test_toxicity_query_against_one_text_at_a_time(spark, sf):
    """Scores made again by a plain loop from the fitted coefficients; labels of held-out rows change nothing."""
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    terms, w = toxicity.fit(docs, labels)
    turned = toxicity.fit(docs, labels.withColumn("toxic", F.when(langid.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert turned[0] == terms and np.allclose(turned[1], w)
    got = {r.doc_id: r for r in toxicity.op2_toxicity(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        n = [words.count(t[1:]) if t[0] == "=" else sum(x[: len(t)] == t for x in words) for t in terms]
        stretches = len(re.findall(r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+$", r.text or ""))
        x = [1.0, np.log1p(sum(n)), np.log1p(sum(k > 0 for k in n)), min(1.0, 10 * sum(n) / max(1, stretches)), *np.log1p(n)]
        score = 1 / (1 + np.exp(-np.clip(np.dot(x, w), -30, 30)))
        assert abs(got[r.doc_id].score - score) < 1e-9
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and got[r.doc_id].predicted == int(score >= 0.3)


def test_toxicity_reads_long_texts_and_no_other_column(spark):
    rows = [(i, "idiot zorbax " * 3 if i % 5 == 0 else "calm words here", "x", 1.0) for i in range(400)] + [(1001, "calm words " * 100_000 + "idiot zorbax " * 5000, "y", 2.0), (1001, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted double")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) and max(r.score for r in got if r.doc_id == 1001) > 0.5


def test_languages_against_one_text_at_a_time(spark, sf):
    """The query's rows by plain compression of one text after the other."""
    import zstandard

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {k: t.decode() for k, t in sorted(langid.dictionaries(docs).items())}

    def coder(text):
        held = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=6)
        return zstandard.ZstdCompressor(level=6, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(c, low):
        return sum(len(c.compress(low[k : k + 4096])) for k in range(0, len(low), 4096))

    common = {k: coder(t) for k, t in texts.items() if 2 * len(t) >= max(map(len, texts.values()))}
    rare = {k: (coder(t), {c: coder(texts[c][-len(t) :]) for c in common}) for k, t in texts.items() if k not in common}
    got = {r.doc_id: r for r in langid.op10_language_id(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        low = re.sub(r"[\W\d_]+", " ", (r.text or "").lower()).encode()
        if not low.strip():
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
            continue
        low += b" "
        n = -(-len(low) // 4096)
        low = (low * (n * 4096 // len(low) + 1))[: n * 4096]
        sizes = sorted((size(c, low), name) for name, c in common.items())
        want = sizes[0][1], 1 - sizes[0][0] / [*sizes, (float("inf"), "")][1][0]
        saved = sorted((1 - size(own, low) / size(cut[want[0]], low), name) for name, (own, cut) in rare.items())
        if saved and saved[-1][0] >= langid.MARGIN:
            want = saved[-1][1], saved[-1][0]
        assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == pytest.approx(want)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
