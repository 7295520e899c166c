"""Private data: detected entities get keyed surrogates of the same type, format, script and gender."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, durable, slices

#: Setting of the session with the key of the registered query and of the pipeline, and the key that they use over the
#: synthetic tables where it is not set. Operators take theirs as an argument.
KEY_SETTING, KEY = "factgate.surrogates.key", b"surrogate-key"
ROUNDS = 8
#: Names, and values whose surrogate had to be drawn again, that tasks are handed as they are; more are joined by row.
HANDED = 100_000

EMAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}")
SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|bearer)\b\s*[:=]?\s*[\"']?([A-Za-z0-9_\-+/]{16,})")
ADDRESS = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)")
CARD = re.compile(r"(?<![\d+])\d(?:[ -]?\d){12,18}(?!\d)")
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\d)")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
NATIONAL = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
DIGIT = re.compile(r"\d")

# Titles by the gender they tell (n: neither), and common given names by script and gender.
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Dr": "n", "Prof": "n", "г-н": "m", "г-жа": "f"}
GIVEN = {
    ("latin", "m"): ("Adam", "Carlos", "David", "Erik", "Felix", "Henri", "Jonas", "Karl", "Louis", "Marco", "Oscar", "Paul", "Robert", "Samuel", "Thomas", "Victor"),
    ("latin", "f"): ("Alice", "Beatriz", "Clara", "Diana", "Elena", "Greta", "Hanna", "Ines", "Julia", "Laura", "Marie", "Nora", "Olivia", "Rosa", "Sophie", "Vera"),
    ("cyrillic", "m"): ("Андрей", "Борис", "Виктор", "Дмитрий", "Иван", "Михаил", "Павел", "Сергей"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Светлана"),
}
#: Syllables that family names are made of.
SYLLABLES = {"latin": ("bar", "den", "fal", "gor", "hel", "kem", "lun", "mor", "nis", "pol", "ran", "sel", "tor", "vik", "wen", "zan"), "cyrillic": ("бар", "ден", "фал", "гор", "кем", "лун", "мор", "нис", "пол", "ран", "сел", "тор", "вик", "зан")}
# Endings of family names that tell a woman's, with the man's.
ENDINGS = {"cyrillic": {"ова": "ов", "ева": "ев", "ёва": "ёв", "ина": "ин", "ына": "ын", "ская": "ский", "цкая": "цкий"}}
# What stands in the line before a signature.
CLOSINGS = ("Best regards", "Kind regards", "Regards", "Sincerely", "Yours sincerely", "Best wishes", "Mit freundlichen Grüßen", "Viele Grüße", "Cordialement", "Bien à vous", "Atentamente", "Saludos", "С уважением")
# Country calling codes of two digits; those that begin with 1 or 7 have one, all others three.
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

#: A word of a name: capitals of any script, apostrophes and hyphens inside.
WORD = r"\p{Lu}(?:[\p{L}'’-]*\p{L})(?:\p{M}|(?![\p{L}\p{N}]))"
INITIALS = r"(?:\p{Lu}\. ?){0,2}"
LISTED = {name: (script, gender) for (script, gender), all_names in GIVEN.items() for name in all_names}
#: A title, initials perhaps, and up to three names.
NAMED = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(TITLE)\.? {INITIALS}(?:(?!(?:TITLE)(?!\p{{L}}))({WORD}) ?){{1,3}}".replace("TITLE", "|".join(TITLES)))
#: A common given name, initials perhaps, and a family name.
KNOWN = regex.compile(rf"(?<![\p{{L}}\p{{N}}])({'|'.join(LISTED)}) {INITIALS}({WORD})")
#: A line of two or three names after a closing formula.
SIGNED = regex.compile(rf"(?m)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(CLOSINGS)}),?[ \t]*\r?\n(?:[ \t]*\r?\n)?[ \t]*({WORD})(?: {INITIALS}({WORD})){{1,2}}[ \t]*\r?$")


def draw(key: bytes, *parts: object) -> bytes:
    return hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()


def permute(values: list[int], sizes: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed bijection of number lists whose k-th entry is below sizes[k]: a Feistel network over its two halves."""
    n = len(values)
    if n == 1:
        shift = 1 + int.from_bytes(draw(key, tweak)[:8], "big") % (sizes[0] - 1) if sizes[0] > 1 else 0
        return [(values[0] + shift) % sizes[0]]
    out, mid = list(values), n // 2
    halves = (range(mid), range(mid, n))
    for r in range(ROUNDS):
        to, by = halves[r % 2], halves[1 - r % 2]
        stream, said = b"", [out[i] for i in by]
        while len(stream) < 4 * len(to):
            stream += draw(key, tweak, r, said, len(stream))
        for k, i in enumerate(to):
            out[i] = (out[i] + int.from_bytes(stream[4 * k : 4 * k + 4], "big")) % sizes[i]
    return out


HEX = "0123456789abcdef"


@lru_cache(4096)
def alphabet(c: str) -> str:
    """What may stand for a character: digits for a digit, for a letter those of its kind in its 64 code points; nothing for others."""
    if "0" <= c <= "9":
        return "0123456789"
    if not c.isalpha():
        return ""
    kind, block = unicodedata.category(c), ord(c) // 64 * 64
    return "".join(x for x in map(chr, range(block, block + 64)) if unicodedata.category(x) == kind and len(x.lower()) == len(x.upper()) == 1)


def same_shape(text: str, key: bytes, kind: str) -> str:
    """Another text of the same shape: digits for digits, letters for letters of the same script and case, all else unchanged.

    Among texts of one shape this is a bijection, so different texts never get the same one, and a text always the same.
    """
    hexa = kind == "secret" and all(c in HEX for c in text)
    kinds = [HEX if hexa else a if c in (a := alphabet(c)) else "" for c in text]
    at = [i for i, k in enumerate(kinds) if len(k) > 1]
    if not at:
        return text
    tweak = kind + "|" + "".join(c if len(k) < 2 else "hex" if k is HEX else k[0] for c, k in zip(text, kinds))
    got = permute([kinds[i].index(text[i]) for i in at], [len(kinds[i]) for i in at], key, tweak)
    out = list(text)
    for i, v in zip(at, got):
        out[i] = kinds[i][v]
    return "".join(out)


def luhn(digits: list[int]) -> int:
    """The check digit that completes a number."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = 2 * d if k % 2 == 0 else d
        total += d - 9 if d > 9 else d
    return -total % 10


def bank_check(country: str, body: str) -> int:
    """The two check digits of a bank number, as a number."""
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def country_code(text: str, digits: str) -> int:
    """How many leading digits of a phone number are its country's."""
    return 0 if not text.startswith("+") else 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGITS else 3


def canonical(kind: str, text: str) -> str:
    """What all ways to write an entity have in common: digits, letters of one case. Surrogates are drawn for this."""
    if kind == "email":
        return low if len(low := text.lower()) == len(text) else text
    if kind in ("card", "national"):
        return "".join(c for c in text if c.isdigit())
    if kind == "phone":
        digits = "".join(c for c in text if c.isdigit())
        return digits[country_code(text, digits) :]
    if kind == "address":
        return ".".join(str(int(x)) for x in text.split("."))
    return text.replace(" ", "") if kind == "iban" else text


def renewed(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The surrogate of a canonical value: a keyed bijection, of its own for each attempt."""
    key = draw(key, "attempt", attempt) if attempt else key
    if kind == "address":
        return ".".join(map(str, permute([int(x) for x in value.split(".")], [256] * 4, key, kind)))
    if kind == "card":  # valid numbers stay valid: what the last digit is off the check digit is kept
        digits = [int(c) for c in value]
        new = permute(digits[:-1], [10] * (len(digits) - 1), key, f"card{len(digits)}")
        new.append((luhn(new) + digits[-1] - luhn(digits[:-1])) % 10)
        return "".join(map(str, new))
    if kind == "iban":  # the same for its check digits
        country, check, body = value[:2], int(value[2:4]), value[4:]
        new = same_shape(body, key, f"iban{country}")
        return f"{country}{(bank_check(country, new) + check - bank_check(country, body) - 2) % 97 + 2:02d}{new}"
    if kind == "email":
        stem, _, top = value.rpartition(".")
        return same_shape(stem, key, kind) + "." + top
    return same_shape(value, key, kind)


def dressed(kind: str, text: str, new: str) -> str:
    """A canonical surrogate written as the text was: the same separators, case and country code."""
    if kind in ("address", "secret"):
        return new
    if kind == "email":
        return "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n for c, n in zip(text, new))
    skip = country_code(text, "".join(c for c in text if c.isdigit())) if kind == "phone" else 0
    out, it = [], iter(new)
    for c in text:
        if c.isalnum() and skip:
            skip -= 1
        elif c.isalnum():
            c = next(it)
        out.append(c)
    return "".join(out)


def surrogate(kind: str, text: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of an entity: different entities of a kind get different ones, ways to write one entity the same."""
    return dressed(kind, text, renewed(kind, canonical(kind, text), key, attempt))


def apart(i: int, j: int, held: list[tuple]) -> bool:
    """Whether a span overlaps none of ``held``, which are in order and overlap none of each other."""
    k = bisect_left(held, (j,))
    return not k or held[k - 1][1] <= i


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans of entities other than names, in order and without overlaps; where two overlap, the earlier kind in this list wins."""
    found: list[tuple[int, int, str]] = []
    tries = []
    if "@" in text:
        tries.append(("email", EMAIL, 0))
    if DIGIT.search(text):
        tries += [("secret", SECRET, 1), ("address", ADDRESS, 0), ("iban", IBAN, 0), ("card", CARD, 0), ("phone", PHONE, 0), ("national", NATIONAL, 0)]
    elif ":" in text or "=" in text:
        tries.append(("secret", SECRET, 1))
    for kind, pattern, group in tries:
        spans = [m.span(group) for m in pattern.finditer(text)]
        new = [(i, j, kind) for i, j in spans if (kind != "secret" or DIGIT.search(text, i, j)) and apart(i, j, found)]
        found = sorted(found + new)
    return found


def masculine(script: str, part: str, low: str) -> str:
    """The form of a name, in small letters, that is the same for women and men."""
    if part == "family":
        for f, m in ENDINGS.get(script, {}).items():
            if low.endswith(f):
                return low[: -len(f)] + m
    return low


def forms(name: str, script: str, part: str, new: str) -> dict[str, str]:
    """A name, and its form of the other gender if it has one, with their surrogates; ``new`` is that of the masculine form."""
    up = str.upper if len(name) > 1 and name.isupper() else str
    if part == "family":
        for f, m in ENDINGS.get(script, {}).items():
            own = next((e for e in (f, m) if name.lower().endswith(e)), "")
            if own and new.endswith(m):
                return {name[: -len(own)] + up(e): up(new[: -len(m)] + e) for e in (f, m)}
    return {name: up(new)}


def names(text: str) -> list[tuple[int, int, str, str, str]]:
    """Spans of names, in order, as (start, end, part, script, gender); part is given or family, gender what title or name tell (n: nothing).

    Names stand after a title, or are a common given name with a family name, or sign a letter.
    """
    out: list[tuple[int, int, str, str, str]] = []

    def add(people: list[tuple[list[tuple[int, int]], str]]) -> None:
        new = []
        for spans, gender in people:
            if not all(apart(i, j, out) for i, j in spans):
                continue
            for k, (i, j) in enumerate(spans):
                script = unicodedata.name(text[i], "latin").split()[0].lower()
                listed = LISTED.get(text[i:j].capitalize(), ("", ""))
                part = "given" if k + 1 < len(spans) or listed[0] == script else "family"
                new.append((i, j, part, script, "" if part == "family" else listed[1] if listed[0] == script else gender))
        out[:] = sorted(out + new)

    if any(t in text for t in TITLES):
        add([(m.spans(2), TITLES[m[1]]) for m in NAMED.finditer(text)])
    if any(c in text for c in CLOSINGS):
        add([([m.span(1), *m.spans(2)], "n") for m in SIGNED.finditer(text)])
    if any(n in text for n in LISTED):
        add([([m.span(1), m.span(2)], "n") for m in KNOWN.finditer(text)])
    return out


def mentions(text: str, new: dict[str, str]) -> list[tuple[int, int, str]]:
    """Spans of all mentions of the names in a text, as they are or in capitals, and what replaces them."""
    said = {f: v for name, v in new.items() for f, v in ((name, v), (name.upper(), v.upper()))}
    found = regex.compile(r"(?<![\p{L}\p{N}])(?:" + "|".join(map(regex.escape, sorted(said, key=len, reverse=True))) + r")(?![\p{L}\p{M}\p{N}])")
    return [(*m.span(), said[m[0]]) for m in found.finditer(text)]


def invented(part: str, script: str, name: str, gender: str, attempt: int, key: bytes) -> str:
    """A made-up name of the same part, script, gender and ending; later attempts draw from ever larger sets."""
    seed = draw(key, part, script, name, attempt)
    if part == "given" and any(s == script for s, _ in GIVEN):
        lists = [v for (s, g), v in GIVEN.items() if s == script and gender in (g, "n", "")]
        pool = [x for v in lists for x in v]
        return "-".join(pool[seed[k] % len(pool)] for k in range(1 + min(attempt // 2, 8)))
    if script in SYLLABLES:
        pool = SYLLABLES[script]
        ending = next((m for m in ENDINGS.get(script, {}).values() if part == "family" and name.endswith(m)), "")
        return "".join(pool[seed[k] % len(pool)] for k in range(2 + min(attempt // 2, 8))).capitalize() + ending
    shape = name[0].upper() + name[1:] + name[-1:] * min(attempt // 4, 8)  # no lists for this script: letters for letters
    return same_shape(shape, seed, "name")


#: What tells a name from others: the gender that a title tells doesn't, so that all titles of a person lead to one surrogate.
NAME = ("part", "script", "value")


def name_surrogates(found: DataFrame, key: bytes) -> DataFrame:
    """(part, script, value, new): every different name of ``found``, in small letters and its masculine form, with a surrogate of its own that is no name there.

    A given name has the gender that all its titles in the table tell; where they disagree or tell none, either. Each
    round draws for those still without; a drawn name goes to the smallest of those that drew it, if no other has it and
    it does not occur itself. Rounds end when all have one, as the sets drawn from grow.
    """
    told = F.collect_set(F.when(F.col("gender").isin("m", "f"), F.col("gender")))
    left = durable(found.groupBy(*NAME).agg(told.alias("told")).select(*NAME, F.when(F.size("told") == 1, F.col("told")[0]).otherwise("n").alias("gender")))
    alone = F.col("value")
    for pairs in ENDINGS.values():
        for f, m in pairs.items():
            alone = F.regexp_replace(alone, f"{f}$", m)
    taken = left.select(F.explode(F.array("value", alone)).alias("low")).distinct()
    done, attempt = None, 0
    while not left.isEmpty():

        def propose(batches: Iterator[pa.RecordBatch], attempt: int = attempt) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = [invented(*(r[c] for c in NAME), r["gender"], attempt, key) for r in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], [*NAME, "gender", "new"])

        drawn = left.mapInArrow(propose, "part string, script string, value string, gender string, new string").withColumn("low", F.lower("new")).join(taken, "low", "left_anti")
        won = durable(drawn.groupBy("low").agg(F.min(F.struct(*NAME, "new")).alias("who")).select("who.*", "low"))
        done = won if done is None else done.unionByName(won)
        taken = durable(taken.unionByName(won.select("low")))
        left = durable(left.join(won, list(NAME), "left_anti"))
        attempt += 1
    return done.drop("low") if done is not None else left.select(*NAME, F.lit("").alias("new"))


def redrawn(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, new): the values whose first surrogate is a value that occurs, with one that neither occurs nor is another's.

    The first surrogates (column ``new``) are a bijection, so they can only clash with real values.
    """
    drawn = durable(found.select("kind", "value", "new").distinct())
    real = drawn.select("kind", F.col("value").alias("new"))
    left = durable(drawn.join(real, ["kind", "new"], "left_semi").select("kind", "value"))
    taken, done, attempt = real.unionByName(drawn.select("kind", "new")).distinct(), None, 1
    while not left.isEmpty():

        def propose(batches: Iterator[pa.RecordBatch], attempt: int = attempt) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = [renewed(k, v, key, attempt) for k, v in zip(*(c.to_pylist() for c in batch.columns))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], ["kind", "value", "new"])

        free = left.mapInArrow(propose, "kind string, value string, new string").join(taken, ["kind", "new"], "left_anti")
        won = durable(free.groupBy("kind", "new").agg(F.min("value").alias("value")).select("kind", "value", "new"))
        done = won if done is None else done.unionByName(won)
        taken = durable(taken.unionByName(won.select("kind", "new")))
        left = durable(left.join(won, ["kind", "value"], "left_anti"))
        attempt += 1
    return done if done is not None else left.withColumn("new", F.lit(""))


def replace(text: str, key: bytes, given: dict[tuple[str, ...], str]) -> tuple[str, list[str]]:
    """A text with its entities replaced, and their kinds. ``given`` has surrogates of names by NAME, and those drawn again by (kind, canonical value)."""
    spans = []
    for i, j, kind in find(text):
        again = given.get((kind, canonical(kind, text[i:j]))) if given else None
        spans.append((i, j, kind, dressed(kind, text[i:j], again) if again else surrogate(kind, text[i:j], key)))
    new: dict[str, str] = {}
    for i, j, part, script, _ in names(text) if given else ():
        if found := given.get((part, script, masculine(script, part, text[i:j].lower()))):
            for form, to in forms(text[i:j], script, part, found).items():
                new.setdefault(form, to)
    if new:
        held = sorted((i, j) for i, j, *_ in spans)
        spans += [(i, j, "name", to) for i, j, to in mentions(text, new) if apart(i, j, held)]
    if not spans:
        return text, []
    out, at = [], 0
    for i, j, _, to in sorted(spans):
        out += [text[at:i], to]
        at = j
    return "".join(out) + text[at:], [k for _, _, k, _ in sorted(spans)]


FOUND = ("row", "kind", *NAME, "gender", "new")


def entities(rows: DataFrame, key: bytes) -> DataFrame:
    """FOUND of the rows (row, text): every different entity of a row in canonical form, with its first surrogate; names without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            got = set()
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, j, kind in find(text or ""):
                    value = canonical(kind, text[i:j])
                    got.add((row, kind, "", "", value, "", renewed(kind, value, key)))
                for i, j, part, script, gender in names(text or ""):
                    got.add((row, "name", part, script, masculine(script, part, text[i:j].lower()), gender, ""))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*sorted(got)) if got else [[]] * 7, [pa.int64(), *[pa.string()] * 6])], list(FOUND))

    return rows.mapInArrow(run, "row long, kind string, part string, script string, value string, gender string, new string")


def with_surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """The rows with entities in ``text`` replaced, and as the last column, ``kinds``, the kinds of those, in order.

    The texts are read twice. First every task lists the different entities of its rows. E-mail and network addresses,
    card, bank, phone and national numbers and secrets get a keyed bijection of their canonical form, so that two ways to
    write one number keep saying the same; what clashes with a value of the table is drawn again. Names (after a title,
    of a common given name with a family name, or signing a letter) draw surrogates in rounds over the whole table's
    different names, whatever title they have and, of family names that differ by gender, in either form. Then every task replaces what it finds, a name at
    all its mentions in the text. Up to HANDED names and values drawn again are handed to the tasks; if there are more,
    each row is joined with its own.

    Null and empty texts, other columns, whatever their names, and row count stay; texts of any length are read whole;
    repeated rows get equal replacements; an empty table stays empty.
    """
    where, width = docs.columns.index("text"), len(docs.columns)
    inner = docs.toDF(*[f"c{k}" for k in range(width)]).withColumn("row", F.xxhash64(f"c{where}"))
    fields = T.StructType([*(T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)), T.StructField("kinds", T.ArrayType(T.StringType()))])
    found = durable(entities(inner.select("row", F.col(f"c{where}").alias("text")), key))
    named, others = found.where("kind = 'name'"), found.where("kind != 'name'")
    people, again = durable(name_surrogates(named, key)), redrawn(others, key)
    handed: dict[tuple[str, ...], str] | None = None
    if people.count() + again.count() <= HANDED:
        handed = {tuple(r[c] for c in NAME): r["new"] for r in people.collect()} | {(r["kind"], r["value"]): r["new"] for r in again.collect()}
    else:
        own = named.drop("new").join(people, list(NAME)).select(*FOUND).unionByName(others.drop("new").join(again, ["kind", "value"]).select(*FOUND))
        inner = inner.join(own.groupBy("row").agg(F.collect_set(F.struct(*FOUND[1:])).alias("own")), "row", "left").select(*inner.columns, "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, where):
            texts, kinds = [], []
            lists = batch.column(width + 1).to_pylist() if handed is None else [None] * batch.num_rows
            for t, own in zip(batch.column(where).to_pylist(), lists):
                given = handed if handed is not None else {tuple(g[c] for c in NAME) if g["kind"] == "name" else (g["kind"], g["value"]): g["new"] for g in own or ()}
                new, said = replace(t, key, given) if t else (t, [])
                texts.append(new), kinds.append(said)
            columns = [pa.array(texts, batch.schema.field(where).type) if k == where else batch.column(k) for k in range(width)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kinds, pa.list_(pa.string()))], [*(f"c{k}" for k in range(width)), "kinds"])

    return inner.mapInArrow(run, fields)


def replaced(docs: DataFrame, key: bytes) -> DataFrame:
    """Documents with entities in ``text`` replaced by surrogates; all else as in ``with_surrogates``."""
    return with_surrogates(docs, key).drop("kinds").toDF(*docs.columns)


def surrogates(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_entities, kinds, text): every document with what was replaced in it; all else as in ``with_surrogates``."""
    found = with_surrogates(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), key)
    return found.toDF("doc_id", "text", "kinds").select("doc_id", F.size("kinds").cast("long").alias("n_entities"), "kinds", "text")


def key_of(spark: SparkSession) -> bytes:
    """The key that the session sets; over the synthetic tables a known one."""
    return said.encode() if (said := spark.conf.get(KEY_SETTING, None)) else KEY


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates(documents(spark, sf_dir), key_of(spark))
