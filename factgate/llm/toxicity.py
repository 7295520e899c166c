"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, chunks, documents, durable, slices
from .langid import held_out

# Common English insults, by what they are about, and phrases; INSULT stands for any of the insults.
INSULTS = {
    "mind": ("clown", "dumb", "fool", "idiot", "imbecile", "moron", "stupid"),
    "worth": ("garbage", "loser", "pathetic", "scum", "trash", "useless", "vermin", "worthless"),
    "person": ("creep", "disgusting", "filthy", "freak", "jerk", "pig", "ugly"),
}
PHRASES = {
    "order": r"\b(?:shut up|get lost|go away|drop dead|go to hell|go die|kill yourself)\b",
    "hate": r"\b(?:(?:i|we|they|all) hate|hates? (?:you|them|him|her)|nobody (?:likes|wants) you)\b",
    "addressed": r"\b(?:you|your|you're|u)\b(?:\W+\w+){0,3}?\W+(?:INSULT)",
    "stressed": r"\b(?:such|what|total|complete|utter|absolute)\W+(?:an?\W+)?(?:INSULT)|\b(?:INSULT)s?\s*!",
}
#: Words without which no phrase is there, besides the insults.
ANCHORS = ("away", "dead", "die", "hate", "hates", "hell", "lost", "nobody", "up", "yourself")

#: Labelled rows, of each label, that lexicons and classifier are fitted on (about).
SAMPLE = {1: 6000, 0: 12000}
#: Terms: whole words and word beginnings of so many letters.
STEMS = (3, 4, 5, 6, 7, 8)
TERMS, LEXICONS = 384, 6
#: A mined term is at least so many times as frequent among toxic rows, and in this share of them.
LIFT, SUPPORT = 10.0, 0.002
CUT = 0.3
RUNS = re.compile(r"[^\W\d_]+")


def keys(text: str) -> Iterator[str]:
    """Terms of a stretch without white space: each run of letters whole (marked by =) and its beginnings."""
    for run in RUNS.findall(text.lower()):
        yield "=" + run
        for n in STEMS:
            if len(run) >= n:
                yield run[:n]


class Terms:
    """Counts of given terms in texts; a term given twice has two columns."""

    def __init__(self, terms: list[str]):
        self.width, self.at = len(terms), {}
        for k, t in enumerate(terms):
            self.at[t] = (*self.at.get(t, ()), k)
        self.seen: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows x terms counts, and the stretches in each row."""
        data, offsets = buffers(column)
        coded, at = chunks(data, offsets)
        if len(self.seen) > 400_000:
            self.seen = {}
        found = []
        for b in coded.dictionary.to_pylist():
            hit = self.seen.get(b)
            if hit is None:
                hit = self.seen[b] = tuple(k for t in keys(b.decode()) for k in self.at.get(t, ()))
            found.append(hit)
        sizes = np.array([len(h) for h in found], np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.array([k for h in found for k in h], np.int64)
        codes = coded.indices.to_numpy()
        codes_at = np.flatnonzero(sizes[codes]) if len(codes) else np.zeros(0, np.int64)
        doc = np.searchsorted(at, codes_at, "right") - 1
        codes = codes[codes_at] if len(codes_at) else codes_at
        n = sizes[codes]
        inner = np.concatenate(([0], np.cumsum(n)))
        term = flat[np.repeat(ends[codes] - inner[:-1], n) + np.arange(inner[-1])]
        counts = np.bincount(np.repeat(doc, n) * self.width + term, minlength=len(column) * self.width)
        return counts.reshape(len(column), self.width), np.diff(at)


def train_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic): a bounded sample of the labelled rows that may be learned from, drawn by a hash of the id.

    The sample of labels has about ``SAMPLE`` rows of each kind however many there are, which bounds what is broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for kind, n in counts.items():
        share = F.when(F.col("toxic") == kind, F.lit(min(1.0, SAMPLE[kind] / n))).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30)) / (1 << 30) < share)
    return durable(docs.join(F.broadcast(drawn), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic"))


def mine(rows: DataFrame) -> list[str]:
    """The terms that tell toxic rows best: document frequencies by label are counted in the tasks and added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[toxic].update({k for w in set(text.split()) for k in keys(w)})
        both = list(seen[1]) + [t for t in seen[0] if t not in seen[1]]
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([seen[1][t] for t in both], pa.int64()), pa.array([seen[0][t] for t in both], pa.int64())], ["term", "bad", "good"])

    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = max(1, n.get(1, 0)), max(1, n.get(0, 0))
    found = rows.select("text", "toxic").mapInArrow(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    lift = (F.col("bad") / bad) / ((F.col("good") + 1) / good)
    found = found.where((F.col("bad") >= max(3, SUPPORT * bad)) & (lift >= LIFT)).withColumn("gain", F.col("bad") * F.log(lift))
    return [r["term"] for r in found.orderBy(F.desc("gain"), "term").limit(TERMS).collect()]


ALL_INSULTS = [w for words in INSULTS.values() for w in words]
#: Terms that the voters look for besides the mined ones: whole words.
SAID = ["=" + w for w in [*ALL_INSULTS, *ANCHORS]]
FOUND = [re.compile(p.replace("INSULT", "|".join(ALL_INSULTS))) for p in PHRASES.values()]


def votes_of(counts: np.ndarray, size: np.ndarray, mined: int, column: pa.Array) -> np.ndarray:
    """Rows x voters: 1 toxic, 0 clean, 2 abstains. ``counts`` are of the mined terms, then of SAID.

    Voters that know no labels: all insults (clean if there is none), those about each thing, and each kind of phrase,
    which abstain where they find nothing. Voters from the mined terms: LEXICONS lexicons that these are dealt to, two
    of density and one of repetition, each of which says clean if nothing of its own occurs.
    """
    own, said = counts[:, :mined], counts[:, mined : mined + len(ALL_INSULTS)]
    out, at = [np.where(said.sum(1) > 0, 1, 0)], 0
    for words in INSULTS.values():
        out.append(np.where(said[:, at : at + len(words)].sum(1) > 0, 1, 2))
        at += len(words)
    phrases = np.full((len(counts), len(FOUND)), 2)
    for row in np.flatnonzero(counts[:, mined:].sum(1)).tolist():
        text = (column[row].as_py() or "").lower()
        phrases[row] = [1 if p.search(text) else 2 for p in FOUND]
    out += list(phrases.T)
    group = np.arange(mined) % LEXICONS
    for g in range(LEXICONS):
        hit = (own[:, group == g] > 0).sum(1)
        out.append(np.where(hit >= 2, 1, np.where(hit == 1, 2, 0)))
    share = own.sum(1) / np.maximum(1, size)
    out += [np.where(share >= 0.02, 1, np.where(share == 0, 0, 2)), np.where(share >= 0.08, 1, np.where(share < 0.01, 0, 2))]
    most = own.max(1, initial=0)
    out.append(np.where(most >= 3, 1, np.where(most == 0, 0, 2)))
    return np.stack(out, 1).astype(np.int64)


class LabelModel:
    """P(vote | class) of each voter and correlations between voters, learned from vote patterns alone, without labels.

    If voters agreed only through the class, the correlation of two would be the product of each one's with the class,
    so any two others tell a voter's; the median over all such pairs isn't misled by a few that copy each other. What
    two voters agree more than that is their own correlation. A voter counts for 1 / (1 + the sum of these), so voters
    that repeat each other count once. With these weights, expectation maximisation fits the tables of votes by class.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, prior: float):
        self.prior = prior
        voters = patterns.shape[1]
        self.correlation = self._correlations(np.where(patterns == 2, 0, 2 * patterns - 1).astype(float), counts)
        self.weight = 1 / (1 + self.correlation.sum(1))
        hot = (patterns[:, :, None] == np.arange(3)).astype(float)
        self.table = np.tile(np.array([[0.85, 0.05, 0.10], [0.15, 0.6, 0.25]])[:, None], (1, voters, 1))
        for _ in range(50):
            p = self._posterior(hot)
            for y, w in ((0, (1 - p) * counts), (1, p * counts)):
                mass = np.einsum("n,nvk->vk", w, hot) + 0.5
                self.table[y] = mass / mass.sum(1, keepdims=True)
            self.prior = float(np.clip((p @ counts + 1) / (counts.sum() + 2), 1e-4, 0.5))

    @staticmethod
    def _correlations(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        d = x - (counts @ x) / counts.sum()
        c = (d * counts[:, None]).T @ d / counts.sum()
        s = np.sqrt(np.maximum(np.diag(c), 1e-12))
        r = c / np.outer(s, s)
        voters = len(r)
        own = np.zeros(voters)
        for i in range(voters):
            found = [abs(r[i, j] * r[i, k] / r[j, k]) for j in range(voters) for k in range(j) if i not in (j, k) and abs(r[j, k]) > 0.02]
            own[i] = np.sqrt(min(1.0, float(np.median(found)))) if found else 0.0
        spare = np.sqrt(np.maximum(1 - own**2, 0.05))
        out = np.clip((r - np.outer(own, own)) / np.outer(spare, spare), 0, 1)
        np.fill_diagonal(out, 0)
        return out

    def _posterior(self, hot: np.ndarray) -> np.ndarray:
        ratio = np.einsum("nvk,vk,v->n", hot, np.log(self.table[1]) - np.log(self.table[0]), self.weight)
        return 1 / (1 + np.exp(-(ratio + np.log(self.prior / (1 - self.prior)))))

    def __call__(self, votes: np.ndarray) -> np.ndarray:
        return self._posterior((votes[:, :, None] == np.arange(3)).astype(float))


def features(counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What the linear classifier sees: a constant, density of hits, different hits, and how often each term occurs."""
    hits = counts.sum(1)
    extra = [np.ones(len(counts)), np.log1p(hits), np.log1p((counts > 0).sum(1)), np.minimum(1.0, 10 * hits / np.maximum(1, size))]
    return np.concatenate((np.stack(extra, 1), np.log1p(counts)), 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression on soft labels by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray] | None:
    """(terms, coefficients), or None where there is nothing to learn from.

    1. Lexicons are mined from the sample of labelled rows. 2. All voters vote on every row that may be learned from,
    labelled or not; the different patterns of votes, of which only few occur, and their counts reach the driver. 3. The label model is
    fitted on them. 4. The classifier learns the posteriors on the sample; its scale and offset are set on the
    sample's labels, weighted back to the shares they have among all labelled rows.
    """
    rows = train_rows(docs, labels)
    terms = mine(rows)
    if not terms:
        return None

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = Terms(terms + SAID), Counter()
        for batch in slices(batches, 0):
            made, n = np.unique(votes_of(*count(batch.column(0)), len(terms), batch.column(0)), axis=0, return_counts=True)
            for v, k in zip(made.tolist(), n.tolist()):
                seen[bytes(v)] += k
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["votes", "n"])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Terms(terms + SAID)
        for batch in slices(batches, 0):
            made, size = count(batch.column(0))
            said = votes_of(made, size, len(terms), batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([r.astype("<u2").tobytes() for r in np.minimum(made[:, : len(terms)], 65535)], pa.binary()), pa.array(size), batch.column(1), pa.array([bytes(v) for v in said.tolist()], pa.binary())], ["counts", "size", "toxic", "votes"])

    kinds = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).agg(F.avg("toxic")).first()[0] or 0.1
    found = docs.where(~held_out()).select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(patterns, "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    model = LabelModel(np.array([list(r["votes"]) for r in found]), np.array([r["n"] for r in found], float), float(np.clip(kinds, 0.01, 0.5)))
    got = rows.select("text", "toxic").mapInArrow(sample, "counts binary, size long, toxic int, votes binary").collect()
    counts = np.stack([np.frombuffer(r["counts"], "<u2") for r in got]).astype(np.int64)
    size, y = np.array([r["size"] for r in got]), np.array([r["toxic"] for r in got], float)
    weight = np.where(y == 1, kinds / max(y.mean(), 1e-9), (1 - kinds) / max(1 - y.mean(), 1e-9))
    x = features(counts, size)
    w = logistic(x, model(np.array([list(r["votes"]) for r in got])), weight)
    line = np.stack((np.ones(len(x)), x @ w), 1)
    a, b = logistic(line, y, weight, 1e-3)
    w = w * b
    w[0] += a
    return terms, w


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every whole text; a higher score means toxic is likelier.

    Null and empty texts get the score of a text without any hit. Without labels, or if nothing tells them apart, every
    score is 0. Repeated rows get a row each, texts of any length count whole, an empty table gives no rows; other
    columns aren't read.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Terms(model[0]) if model else None
        for batch in slices(batches, 1):
            s = 1 / (1 + np.exp(-np.clip(features(*count(batch.column(1))) @ model[1], -30, 30))) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, score double, predicted int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
