import numpy as np
import pytest

from factgate.llm import langid

from test_documents import LANGS

ITALIAN = "il di che la e un per non sono mi si ho lo ma ti con cosa le da questo bene come ci se"


def spoken(draw, lang, n):
    return " ".join(draw.choice((LANGS | {"it": ITALIAN})[lang].split(), n))


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(11)
    return [(i, spoken(draw, list(LANGS)[i % 3], int(draw.integers(30, 200))), list(LANGS)[i % 3]) for i in range(900)]


def judged(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    return {r.doc_id: tuple(r) for r in langid.identify(df, langid.dictionaries(df)).collect()}, langid.dictionaries(df)


def test_one_rare_label_changes_no_other_prediction(spark, rows):
    (alone, texts), (got, more) = judged(spark, rows), judged(spark, [*rows, *[(k, "un testo breve con parole rare", "it") for k in range(5000, 5006)]])
    assert {k: got[k] for k in alone} == alone
    assert more == texts and min(map(len, texts.values())) > 20000


def test_a_rare_language_is_found_at_its_own_size(spark, rows):
    draw = np.random.default_rng(12)
    few = [(5000 + i, spoken(draw, "it", 300), "it") for i in range(20)]
    (alone, _), (got, texts) = judged(spark, rows), judged(spark, [*rows, *few])
    assert {k: got[k] for k in alone} == alone
    assert len(texts["it"]) < langid.COMMON * max(map(len, texts.values()))
    assert all(got[i][1] == "it" and not got[i][3] for i, _, _ in few)


def test_one_row_of_a_third_language_costs_the_others_nothing(spark, rows):
    few = [r for r in rows if r[2] != "fr"] + [(7001, "un testo breve con parole rare qui", "it")]
    df = spark.createDataFrame(few, "doc_id long, text string, lang string")
    texts = langid.dictionaries(df)
    assert set(texts) == {"en", "de"} and min(map(len, texts.values())) > 20000


def test_what_comes_late_in_a_text_is_learned_and_judged(spark):
    """Texts whose first 1,500 characters have no letters: only what follows tells their language."""
    draw = np.random.default_rng(13)
    rows = [(i, "12345 " * 260 + spoken(draw, list(LANGS)[i % 3], 150), list(LANGS)[i % 3]) for i in range(300)]
    got, texts = judged(spark, rows)
    assert set(texts) == set(LANGS)
    assert all(got[i][1] == lang and not got[i][3] for i, _, lang in rows)


def test_short_rows_are_learned_from(spark):
    draw = np.random.default_rng(14)
    rows = [(i, spoken(draw, list(LANGS)[i % 3], 3), list(LANGS)[i % 3]) for i in range(3000)]
    got, texts = judged(spark, rows)
    assert set(texts) == set(LANGS) and sum(got[i][1] == lang for i, _, lang in rows) > 2500


@pytest.mark.parametrize("count, words", [(40, 60), (8, 60), (200, 60)])
def test_every_language_is_predicted_however_rare(spark, count, words):
    """Few rows of a third language are found, and those of the others stay what they are."""
    draw = np.random.default_rng(5)
    rows = [(i, spoken(draw, ["en", "de"][i % 2], 60), ["en", "de"][i % 2]) for i in range(600)]
    rows += [(1000 + i, spoken(draw, "it", words), "it") for i in range(count)]
    got, texts = judged(spark, rows)
    assert set(texts) == {"en", "de", "it"}
    assert sum(got[i][1] == lang and not got[i][3] for i, _, lang in rows[600:]) >= 0.9 * count
    assert all(got[i][1] == lang and not got[i][3] for i, _, lang in rows[:600])


@pytest.mark.parametrize("count", [4, 40, 150])
def test_a_wrong_label_is_no_language(spark, count):
    """Rows of two languages under a third label, of clashing column names: nothing is predicted to be of it."""
    draw = np.random.default_rng(6)
    rows = [(i, spoken(draw, ["en", "de"][i % 2], 60), ["en", "de"][i % 2]) for i in range(600)]
    wrong = [(3000 + i, spoken(draw, ["en", "de"][i % 2], 60), "xx") for i in range(count)]
    got, texts = judged(spark, [*rows, *wrong])
    assert set(texts) == {"en", "de"}
    assert all(got[i][1] == lang for i, _, lang in rows)


def test_helper_names_may_be_columns(spark, rows):
    df = spark.createDataFrame([(*r, "a", 1.0, "b") for r in rows[:120]], "doc_id long, text string, lang string, __k string, rejected double, lang_pred string")
    assert langid.keep_identified(df).columns == df.columns
    got = langid.identify(df, langid.dictionaries(df))
    assert got.columns == ["doc_id", "lang_pred", "score", "rejected"] and got.count() == 120
