import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factgate.llm import fim


def brute(doc_id, text, rule=fim.Rule()):
    text = text or ""
    h = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n, (p, m, s) = len(text), rule.marks
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in rule.marks) or h3 % 100 >= rule.transformed:
        return n, "plain", None, None, text
    if h4 % 100 < rule.suffix_first:
        return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def table(spark, rows):
    more = [(500 + i, t) for i, t in enumerate(["a", "é", "<P>", "x<", "y <S> z", "<M", "ab<" * 900, "𝄞é" * 3000, "<", "<<P", "S>P>M>"] * 3)]
    more = [(i + 40 * k, t) for k, (i, t) in enumerate(more)]
    return rows + more, spark.createDataFrame([(i, t, "p", 1) for i, t in rows + more], "doc_id long, text string, piece string, row int").repartition(5)


@pytest.mark.parametrize("chunk, out", [(2048, 4 << 20), (7, 100)])
def test_against_strings(table, monkeypatch, chunk, out):
    monkeypatch.setattr(fim, "CHUNK", chunk)
    monkeypatch.setattr(fim, "OUT_BYTES", out)
    rows, df = table
    want = sorted(((i, n, f, p, m, sha(o), sha(t or "")) for i, t in rows for n, f, p, m, o in [brute(i, t)]), key=repr)
    assert sorted((tuple(r) for r in fim.digests(df).collect()), key=repr) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_texts_and_back(table):
    rows, df = table
    made = fim.outputs(df)
    assert sorted((tuple(r) for r in made.collect()), key=repr) == sorted(((i, *brute(i, t)) for i, t in rows), key=repr)
    back = fim.restored(made).select("doc_id", "text").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_other_rule(table):
    rows, df = table
    rule = fim.Rule("9", 100, 50, ("\u0001p", "\u0001m", "\u0001s"))
    got = fim.digests(df, rule).select("doc_id", "form", "output_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, f, sha(o)) for i, t in rows for _, f, _, _, o in [brute(i, t, rule)]), key=repr)
    for bad in (("a", "a", "b"), ("<P>", "<M>", "P>"), ("", "x", "y")):
        with pytest.raises(ValueError):
            fim.Rule(marks=bad)


def test_empty(none):
    assert fim.digests(none).count() == fim.outputs(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("<PSM>ab", max_size=30), st.integers(0, 50), st.lists(st.integers(1, 5), max_size=20))
def test_marks_are_found_at_any_cut(text, doc_id, cuts):
    n, form, a, m, out = brute(doc_id, text, fim.Rule(transformed=100))
    reader, parts, raw = fim.Reader(form, fim.Rule()), ["", "", ""], out.encode()
    while raw:
        k = cuts.pop() if cuts else len(raw)
        for part, found in reader.feed(raw[:k]):
            parts[part] += found.decode()
        raw = raw[k:]
    reader.close()
    assert "".join(parts) == text


def test_a_broken_output_is_an_error():
    reader = fim.Reader("psm", fim.Rule())
    list(reader.feed(b"<P>abc<S>"))
    with pytest.raises(ValueError):
        reader.close()
    with pytest.raises(ValueError):
        list(fim.Reader("psm", fim.Rule()).feed(b"abc<P>"))


def test_query_against_strings(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, fim.op12_fill_in_middle(spark, sf).collect()))
    assert got == sorted((i, n, f, p, m, sha(o), sha(t or "")) for i, t in docs for n, f, p, m, o in [brute(i, t)])
