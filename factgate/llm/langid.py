"""Language identification by compression with per-language raw-content dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, documents, slices

#: Characters of each language that the dictionaries are filled from (about), and of the passages that texts are cut into for that.
SAMPLE_CHARS, PASSAGE = 225_000, 1500
#: Bytes that are compressed at once: every block of a text meets the whole dictionary. The last block is filled up by
#: repeating the text, as a block that hardly compresses is stored as it is and tells nothing.
BLOCK = 4096
#: A prediction is rejected if the best language saves less than this share of the second best's size.
MARGIN = 0.01
LEVEL = 6
#: Dictionaries of at least this share of the longest text are cut to one size; rarer languages keep what they have.
COMMON = 0.5
#: A rarer language is learned if one half of its passages saves this share of the other half's size against every common language.
VOUCHED = 0.05
NOT_LETTERS = re.compile(r"[\W\d_]+")
NAMES = "doc_id long, lang_pred string, score double, rejected boolean"


def held_out(doc_id: str = "doc_id"):
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def dictionaries(docs: DataFrame, chars: int = SAMPLE_CHARS, passage: int = PASSAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Text of each language to compress with, from a bounded sample of the passages that may be learned from.

    Characters are counted over all rows; then about ``chars`` of each language are drawn, passage by passage, by a hash
    of the id and the passage's number. Every passage of every text, short ones and the ends of long ones too, is as
    likely to be drawn. The driver holds languages x chars characters however many documents there are.

    Common languages, those with at least COMMON of the longest text, get as many characters each. What rarer ones have
    doesn't change those: it is kept whole, for ``Judge`` to compare at its own size, however little it is, if its passages
    vouch for each other (``vouched``); a label given to texts of other languages by mistake does not pass, nor one that has a
    single passage. No rows to learn from, an empty table among them, give no dictionaries.
    """
    learn = docs.where(~held_out(doc_id) & (F.length(text) > 0) & F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    total = {r[lang]: r["n"] for r in learn.groupBy(lang).agg(F.sum(F.length(text)).alias("n")).collect()}
    if not total:
        return {}
    number = F.explode(F.sequence(F.lit(0), F.ceil(F.length(text) / passage).cast("int") - 1)).alias("__k")
    mark = F.xxhash64(F.col(doc_id), F.col("__k"), F.lit("language"))
    share = F.create_map(*[F.lit(x) for k, n in total.items() for x in (k, min(1.0, chars / n))])
    drawn = learn.select(doc_id, lang, text, number).where(F.pmod(mark, F.lit(1 << 30)) / (1 << 30) < share[F.col(lang)])
    picked = drawn.select(F.col(lang).alias("lang"), F.substring(text, F.col("__k") * passage + 1, F.lit(passage)).alias("t"), mark.alias("h")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r["h"], r["t"])):
        out.setdefault(r["lang"], []).append(NOT_LETTERS.sub(" ", r["t"].lower()))
    texts = {k: " ".join(v) for k, v in sorted(out.items())}
    most = max(map(len, texts.values()), default=0)
    common = [k for k, t in texts.items() if len(t) >= COMMON * most]
    size = min((len(texts[k]) for k in common), default=0)
    held = {k: last_chars(t, size if k in common else len(t)) for k, t in texts.items()}
    return {k: t.encode() for k, t in held.items() if k in common or vouched(out[k], [held[c] for c in common])}


def vouched(passages: list[str], others: list[str], least: float = VOUCHED) -> bool:
    """Whether different passages are more like each other than like any of the other texts.

    Every second passage fills a dictionary, with which each of the rest is compressed; together they must save the share
    ``least`` against what each is with the best dictionary of as many characters of another text. So texts of several
    languages under one label, each of which has a dictionary of its own, don't vouch for each other.
    """
    passages = list(dict.fromkeys(" ".join(p.split()) for p in passages))
    held, rest = " ".join(passages[::2]), [p.encode() for p in passages[1::2]]
    if not rest:
        return False
    own, *cut = [Judge.coder(t.encode()) for t in (held, *[last_chars(t, len(held)) for t in others])]
    return sum(len(own.compress(p)) for p in rest) <= (1 - least) * sum(min(len(c.compress(p)) for c in cut) for p in rest)


def last_chars(text: str, n: int) -> str:
    return text[-n:] if n else ""


class Judge:
    """Compresses texts with each language's dictionary; gives (language, score, rejected) for each.

    Common languages are compared with each other. A rarer one, whose dictionary is shorter, is compared with the best
    of them cut to the same size, and takes the text only if it saves the margin against that (of several, the one that
    saves most): other texts keep their language and score.
    """

    def __init__(self, texts: dict[str, bytes], margin: float):
        chars = {k: len(t.decode()) for k, t in texts.items()}
        self.names, self.margin = [k for k in texts if chars[k] >= COMMON * max(chars.values())], margin
        self.coders = [self.coder(texts[k]) for k in self.names]
        short = lambda c, k: last_chars(texts[c].decode(), chars[k]).encode()
        self.rare = [(k, self.coder(t), [self.coder(short(c, k)) for c in self.names]) for k, t in texts.items() if k not in self.names]

    @staticmethod
    def coder(text: bytes) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, column: pa.Array) -> list[tuple[str, float, bool]]:
        data, offsets = buffers(column)
        out = []
        for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            letters = NOT_LETTERS.sub(" ", str(data[i:j].tobytes(), "utf-8").lower()).encode()
            if not self.names or not letters.strip():
                out.append(("und", 0.0, True))
                continue
            letters += b" "
            whole = -(-len(letters) // BLOCK) * BLOCK
            letters = (letters * -(-whole // len(letters)))[:whole]
            parts = [letters[k : k + BLOCK] for k in range(0, whole, BLOCK)]
            sizes = [sum(len(c.compress(p)) for p in parts) for c in self.coders]
            best = sizes.index(min(sizes))
            second = min(sizes[:best] + sizes[best + 1 :], default=float("inf"))
            score = 1.0 - sizes[best] / second
            saved = [(1.0 - sum(len(own.compress(p)) for p in parts) / sum(len(cut[best].compress(p)) for p in parts), k) for k, own, cut in self.rare]
            found, score = max([(x, k) for x, k in saved if x >= self.margin and x > 0], key=lambda x: x[0], default=(score, self.names[best]))[::-1]
            out.append((found, score, score < self.margin))
        return out


def identify(docs: DataFrame, texts: dict[str, bytes], margin: float = MARGIN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every whole text.

    Letters of the lower-cased text are compressed block by block with each language's dictionary; the smallest sum
    wins (ties: the first by name; rare languages: see ``Judge``). ``score`` is the share that the best saves against
    the second best. Null texts and texts without a letter are ``und`` with score 0 and are rejected; so are margins
    under ``margin``. With no language to learn from everything is ``und``; with one, its score is 1. Texts of any
    length count whole. Repeated rows get a row each; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(texts, margin)
        for batch in slices(batches, 1):
            found, scores, no = zip(*judge(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(no, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, NAMES)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, dictionaries(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Documents whose language is told with a margin; the columns stay as they are.

    A document goes if its text is null, has no letter, or is as likely in another language. Decisions are made in the
    task that holds the row, which passes the row on, so nothing is joined or shuffled. Repeated rows fare alike, texts
    of any length count whole, an empty table stays empty, and no column but ``text`` is read once learning is done.
    """
    texts = dictionaries(docs)
    key = docs.schema
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(texts, margin)
        for batch in slices(batches, where):
            keep = pa.array([not r for _, _, r in judge(batch.column(where))], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(run, key)
