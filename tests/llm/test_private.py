import re

import pytest

from factgate.llm import private

KEY = b"a key of this test"


def one(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in private.surrogates(df, KEY).orderBy("doc_id").collect()]


def test_all_mentions_of_a_name_go_together(spark):
    got = one(spark, "Mr. David Smith met Smith. David left. Contact DAVID SMITH, not Smithson.")[0]
    assert not re.search(r"David|Smith\b|DAVID|SMITH", got) and "Smithson" in got
    given, family = got.split()[1:3]
    assert got == f"Mr. {given} {family} met {family}. {given} left. Contact {given.upper()} {family.upper()}, not Smithson."


def test_titles_do_not_part_a_person(spark):
    """The gender a title tells is used wherever the name occurs, with whatever title."""
    a, b, c, d, e = one(spark, "Mr Kwame Adjei came", "Dr Kwame Adjei came", "Prof Kwame Adjei came", "Frau Robin Weber came", "Herr Robin Weber came")
    names = {x.split(" ", 1)[1] for x in (a, b, c)}
    assert len(names) == 1 and a.split()[1].split("-")[0] in private.GIVEN["latin", "m"] and "Adjei" not in a
    assert d.split()[1:] == e.split()[1:] and "Robin" not in d


def test_family_names_keep_their_gender(spark):
    a, b, c = one(spark, "г-жа Анна Иванова пришла, Иванов ушёл", "г-н Иванов пришёл", "г-жа ДОСТОЕВСКАЯ и г-н Достоевский пришли")
    woman, man = a.split()[2].rstrip(","), a.split()[4]
    assert woman == man + "а" and man.endswith("ов") and man != "Иванов" and a.split()[1].split("-")[0] in private.GIVEN["cyrillic", "f"]
    assert b.split()[1] == man
    assert c.split()[1].isupper() and c.split()[1].endswith("СКАЯ") and c.split()[4] == c.split()[1][:-4].capitalize() + "ский"


@pytest.mark.parametrize("text, hidden", [("Anna Weber and Laura M. Weber wrote.", ["Laura", "Weber"]), ("I write to you.\n\nBest regards,\nKwame Adjei\n", ["Kwame", "Adjei"]), ("Bis bald\nViele Grüße\n\nÖzlem B. Yılmaz", ["Özlem", "Yılmaz"]), ("письмо: Ольга Петрова", ["Ольга", "Петрова"])])
def test_names_without_title(spark, text, hidden):
    got = one(spark, text)[0]
    assert not any(re.search(rf"(?<!\w){h}(?!\w)", got) for h in hidden) and len(got.split()) == len(text.split())


@pytest.mark.parametrize("text", ["Laura came to Berlin. Ines was there", "Best regards,\nthe whole team", "Best regards and see you. Laura, Weber", "Victor is the name", "Karlsruhe Weber"])
def test_what_is_no_name_stays(spark, text):
    assert one(spark, text) == [text]


def test_no_surrogate_name_is_a_real_one(spark):
    """Every surrogate of the first draw occurs as a name, in a man's form or a woman's: others are drawn, all different."""
    real = [f"{a}ов" for a in ("Иван", "Петр", "Смирн", "Козл")]
    first = [private.invented("family", "cyrillic", x.lower(), "n", 0, KEY) for x in real]
    people = real + [f + "а" for f in first]
    new = [t.split()[1] for t in one(spark, *[f"{'г-жа' if p.endswith('а') else 'г-н'} {p} тут" for p in people])]
    bases = {private.masculine("cyrillic", "family", x.lower()) for x in new}
    assert len(bases) == len(people) and not bases & {private.masculine("cyrillic", "family", x.lower()) for x in people}


def test_key_of_the_session(spark):
    assert private.key_of(spark) == private.KEY
    spark.conf.set(private.KEY_SETTING, "other")
    try:
        assert private.key_of(spark) == b"other"
    finally:
        spark.conf.unset(private.KEY_SETTING)


@pytest.mark.parametrize("text", ["Mr McDonald came", "Mr O'Brien came", "Mr. Łukasz Nowak came", "Mr Šimůnek came", "Mr John Paul Smith came", "Frau Müller-Lüdenscheidt came", "г-жа Анна Иванова came", "Mr. Νίκος Παππάς came", "Dr. J. Weber came"])
def test_names_of_many_forms(spark, text):
    got = one(spark, text)[0]
    hidden = [text[i:j] for i, j, *_ in private.names(text)]
    assert hidden and " ".join(hidden) in text and all(x not in got for x in hidden)
    assert got.startswith(text.split()[0]) and got.endswith(" came") and len(got.split()) == len(text.split())


def test_ways_to_write_one_number(spark):
    a, b, c = one(spark, "call +1 (794) 411-0786 now", "call +1 794-411-0786 now", "call 794-411-0786 now")
    digits = lambda t: re.sub(r"\D", "", t)[-10:]
    assert digits(a) == digits(b) == digits(c) != "7944110786" and a.startswith("call +1 (") and b.startswith("call +1 ")
    x, y = one(spark, "mail Bob@Xy.com", "mail bob@xy.com")
    assert x.lower() == y and x[5].isupper() and x.endswith(".com") and "bob" not in y


def test_check_digits_and_scripts():
    valid = "GB82WEST12345698765432"
    new = private.surrogate("iban", "GB82 WEST 1234 5698 7654 32", KEY)
    body = new.replace(" ", "")
    assert new[:2] == "GB" and new != valid and int(body[2:4]) == private.bank_check("GB", body[4:]) and private.bank_check("GB", valid[4:]) == 82
    local = private.surrogate("email", "почта.é@xy.com", KEY)
    assert not set("почта") & set(local.split(".")[0]) or local.split(".")[0] != "почта"
    assert local.split("@")[0] != "почта.é" and local[5] == "." and len(local) == len("почта.é@xy.com")


def test_no_surrogate_is_a_real_value(spark):
    """Texts that hold the first surrogates of others: those are drawn again, and stay apart."""
    phones = [f"794-411-{k:04d}" for k in range(40)]
    real = phones + [private.surrogate("phone", p, KEY) for p in phones]
    got = one(spark, *[f"call {p} now" for p in real])
    new = [t.split()[1] for t in got]
    assert len(set(new)) == len(set(real)) and not set(new) & set(real)
    assert all(re.fullmatch(r"\d{3}-\d{3}-\d{4}", p) for p in new)


@pytest.mark.parametrize("handed", [100_000, 0])
def test_against_one_text_at_a_time(spark, sf, monkeypatch, handed):
    """The query's rows, made again by a plain loop over the texts with its own search for what repeats."""
    monkeypatch.setattr(private, "HANDED", handed)
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in private.op7_pii_surrogates(spark, sf).collect()}
    assert set(got) == set(rows)
    pattern = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}")
    seen, people = {}, {}
    for i, text in rows.items():
        new = got[i].text
        if not text:
            assert new == text and got[i].n_entities == 0
            continue
        mails = pattern.findall(text)
        assert len(mails) == len(pattern.findall(new)) == got[i].kinds.count("email")
        for a, b in zip(mails, pattern.findall(new)):
            assert seen.setdefault(a.lower(), b.lower()) == b.lower() and a.lower() != b.lower()
        titled = [text[x:y] for x, y, *_ in private.names(text)]
        assert not any(re.search(rf"(?<!\w){re.escape(n)}(?!\w)", new) for n in titled)
        for (x, y, *who, _), (u, v, *_) in zip(private.names(text), private.names(new)):
            assert people.setdefault((*who, text[x:y].lower()), new[u:v].lower()) == new[u:v].lower()
        if not got[i].n_entities:
            assert new == text
    assert len(set(seen.values())) == len(seen) > 3 and not set(seen) & set(seen.values())
    assert len(set(people.values())) == len(people)


def test_rows_and_columns_stay(spark):
    long = "word " * 200_000 + "mail bob@xy.com"
    rows = [(1, "mail bob@xy.com", "a", 1, "x"), (1, "mail bob@xy.com", "a", 1, "x"), (2, None, "b", None, "y"), (3, "", "c", 2, "z"), (None, long, None, 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds string, row long, own string")
    got = private.replaced(df, KEY)
    assert got.columns == df.columns and got.count() == 5
    new = sorted((tuple(r) for r in got.collect()), key=str)
    mail = private.surrogate("email", "bob@xy.com", KEY)
    assert new == sorted([(1, f"mail {mail}", "a", 1, "x")] * 2 + [rows[2], rows[3], (None, "word " * 200_000 + f"mail {mail}", None, 3, None)], key=str)
    assert private.replaced(df.limit(0), KEY).count() == 0


def test_very_many_entities_in_one_text(spark):
    """Time grows with the text, not with its square."""
    text = " ".join(f"Mr Adjei{chr(97 + k % 26)} has u{k}@xy.com and 10.0.{k % 256}.7" for k in range(20_000))
    assert len(private.find(text)) == 40_000 and len(private.names(text)) == 20_000
    new = one(spark, text)[0]
    assert len(new.split()) == len(text.split()) and "Adjei" not in new
    mails = [set(re.findall(r"\S+@\S+", t)) for t in (text, new)]
    assert len(mails[1]) == len(mails[0]) == 20_000 and not mails[0] & mails[1]
    held = [(2, 5), (8, 9)]
    assert [private.apart(i, j, held) for i, j in ((0, 2), (0, 3), (5, 8), (4, 6), (8, 9), (9, 12), (1, 20))] == [True, False, True, False, False, True, False]
