import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta.", "eta", "theta", "iota", "kappa", "naïve", "straße", "1234", "|", "the", "of"]


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, blanks, a very long text, ties, repeated rows, copies, near copies and shared passages."""
    draw = random.Random(7)
    say = lambda n: " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(n))
    passage = say(70)
    out = [(i, say(draw.choice([1, 2, 3, 12, 13, 14, 60, 200]))) for i in range(0, 120, 2)]
    out += [(1, None), (3, ""), (5, " \t\n "), (7, say(4000)), (9, "x " * 3000)]
    for k, i in enumerate(range(201, 221)):
        out.append((i, f"{say(k)} {passage}\n{say(20 - k)}"))
    long = say(300)
    for i in range(301, 313):
        words = long.split()
        if i > 306:
            words[(i * 37) % 300] = "changed"
        out.append((i, " ".join(words)))
    out += [(401, out[3][1]), (401, out[4][1]), (402, out[4][1]), (402, out[4][1]), (None, out[4][1]), (None, None), (-5, say(30))]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The documents with a clashing and some extra columns."""
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, "s", len(t or ""), 1, "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp int, range string").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
