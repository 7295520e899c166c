"""SimHash near-duplicates: a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, components, documents, durable, join_labels, slices

SEED = 42


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words. Fewer words: one shingle of all; none: no shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], SEED) for i, j in zip(at[: -size].tolist(), (at[size:] - 1).tolist())], np.uint64)


def simhash(words: list[bytes], size: int) -> int:
    """64 bits; a bit is set if over half of the word shingles' XXH64 have it. Fewer words than ``size``: one shingle of all; none: 0."""
    return majority(shingles(words, size))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        total += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp): the SimHash of every whole text as a signed 64-bit number.

    Letters A-Z are lower-cased, words are runs of non-white ASCII, shingles have ``size`` words and count as often as
    they occur. Null and blank texts have fingerprint 0. A text of any length is read whole, 8,192 shingles at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            data, offsets = buffers(batch.column(1))
            low = bytes(data).lower()
            out = np.array([simhash(low[i:j].split(), size) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


#: Positional bytes of a fingerprint; posting lists are kept by two pairs of neighbouring positions.
BYTES = 8
LISTS = [(*p, *q) for p, q in combinations([(0, 1), (2, 3), (4, 5), (6, 7)], 2)]
#: Fingerprints of a posting list whose pairs are tallied where it is; a longer list is split by two more positional bytes.
LIST = 1024


def positions(at: tuple[int, ...]) -> Column:
    """The bytes of ``fp`` at the given positions, all others zero."""
    mask = sum(0xFF << (8 * p) for p in at)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def near_fingerprints(fps: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): links between different fingerprints of the column ``fp`` that connect all those at ``bits`` or fewer.

    1. Inverted index: a fingerprint is eight positional bytes. Two at most 2 bits apart differ in at most two of them,
       so they share at least six, the guaranteed minimum, and at least two of the four pairs of neighbouring positions
       whole. A posting list holds the fingerprints that share the bytes at two such pairs.
    2. Count filter: for every pair of a list the positional bytes that both share are tallied; pairs that reach the
       minimum are verified by their differing bits. A pair in several lists is returned once.
    3. A list of over LIST fingerprints is split, none dropped: of its other four positions two that are near share two,
       so its members are posted again by each two of these. In such a list all pairs share six bytes. It has at most
       65,536 members, and is verified without listing pairs: values at distance 1 or 2 meet in one at distance 0 or 1
       of both, so what meets there is linked to its least. All that meet in one such hub are within 2 bits of each
       other, so each link is direct.

    List sizes are counted before anything is gathered, so no task holds a long list; the counts stand on storage, so
    that AQE can split the join with them.
    """
    if bits != 2:
        raise ValueError("two neighbouring pairs of four stay whole for two bits")
    nodes = fps.select("fp").distinct()
    posted = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("list"), positions(at).alias("shared")) for k, at in enumerate(LISTS)])).alias("e")).select("fp", "e.*")
    sizes = durable(posted.groupBy("list", "shared").agg(F.count("*").alias("n")).where("n > 1"))
    met = posted.join(sizes, ["list", "shared"])
    short = met.where(F.col("n") <= LIST).groupBy("list", "shared").agg(F.collect_list("fp").alias("members")).select("members")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            for a, b in pairs_within(members.flatten().to_numpy().view(np.uint64), np.diff(members.offsets.to_numpy())):
                differ = a ^ b
                shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
                on = np.flatnonzero(shared >= BYTES - bits)
                on = on[np.bitwise_count(differ[on]) <= bits]
                yield pa.RecordBatch.from_arrays([pa.array(a[on].view(np.int64)), pa.array(b[on].view(np.int64))], ["a", "b"])

    more = [at + two for at in LISTS for two in combinations([p for p in range(BYTES) if p not in at], 2)]
    six = sorted({tuple(sorted(at)) for at in more})
    again = [F.struct(F.lit(k).alias("list"), F.lit(six.index(tuple(sorted(at)))).alias("six"), positions(at).alias("shared")) for k, own in enumerate(LISTS) for at in more if at[:4] == own]
    split = met.where(F.col("n") > LIST).select("fp", F.col("list").alias("own"), F.explode(F.array(*again)).alias("e")).where("own = e.list").select("fp", "e.six", "e.shared").distinct()
    split = split.groupBy("six", "shared").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1).select("six", "members")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(1)
            fp, sizes_ = members.flatten().to_numpy(), np.diff(members.offsets.to_numpy())
            rest = np.array([[p for p in range(BYTES) if p not in at] for at in six])[np.repeat(batch.column(0).to_numpy(), sizes_)]
            byte = fp.view(np.uint8).reshape(-1, BYTES).astype(np.int64)
            row = np.arange(len(fp))
            a, b = meeting(np.repeat(np.arange(len(members)), sizes_), byte[row, rest[:, 0]] | byte[row, rest[:, 1]] << 8, fp)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return short.mapInArrow(tally, "a long, b long").unionByName(split.mapInArrow(verify, "a long, b long")).distinct()


def pairs_within(members: np.ndarray, sizes: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of each list, of a flattened column of lists, some at a time."""
    start = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    for m in np.unique(sizes[sizes > 1]).tolist():
        lists = start[sizes == m]
        i, j = np.triu_indices(m, 1)
        per = max(1, most // len(i))
        for k in range(0, len(lists), per):
            block = members[lists[k : k + per, None] + np.arange(m)]
            yield block[:, i].ravel(), block[:, j].ravel()


def meeting(list_: np.ndarray, rest: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between fingerprints of one list whose 16 remaining bits differ in one or two."""
    flips = np.concatenate(([0], 1 << np.arange(16)))
    hub = (list_[:, None] << 16) | (rest[:, None] ^ flips)
    order = np.argsort(fp, kind="stable")
    hubs, first = np.unique(hub[order].ravel(), return_index=True)
    least = order[first // len(flips)]  # the smallest fingerprint at each hub
    labels, found = np.arange(len(fp)), []
    for k in range(len(flips)):
        other = least[np.searchsorted(hubs, hub[:, k])]
        new = np.flatnonzero(labels != labels[other])
        found.append((fp[other[new]], fp[new]))
        join_labels(labels, new, other[new])
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents whose fingerprints reach each other over links of ``bits`` bits or fewer.

    Equal fingerprints are handled as one, so a large group of copies is a single node. ``component_id`` is the
    smallest doc_id reached, itself included; a row without doc_id keeps its row and can be in a component but is never
    its name. Repeated rows each keep their row. An empty table gives no rows; texts of any length are read whole; other
    columns are not read.
    """
    marked = durable(fingerprints(docs, doc_id, text, size))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    names = components(near_fingerprints(nodes, bits))
    classes = nodes.join(names.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    ids = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = classes.join(ids, "component").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows that ``found`` (doc_id, h) names, h being the hash of the text; of equal ones one, and all without doc_id."""
    found = found.select(F.struct(F.col("doc_id").cast("long").alias("id"), "h").alias("k")).distinct()
    # the columns of documents, whatever their names, travel in one of their own, so that helper columns clash with none
    rows = docs.where("doc_id is not null").select(F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).alias("k"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(found, "k", "left_semi").dropDuplicates(["k"]).select("row.*").unionByName(docs.where("doc_id is null"))


def keep_one_each(docs: DataFrame, size: int = 5, bits: int = 2) -> DataFrame:
    """Documents with one row left of each near-duplicate component: that with the smallest doc_id, then hash of text.

    Rows are told apart by doc_id and text, so different texts under one doc_id are judged each on its own; of repeated
    rows one stays. Rows with null doc_id all stay. An empty table stays empty; other columns are not read.
    """
    marked = durable(marks(docs, size).select("doc_id", "h", "fp"))
    nodes = marked.groupBy("fp").agg(least_row().alias("rep"))
    names = components(near_fingerprints(nodes, bits)).withColumnRenamed("node", "fp")
    classes = nodes.join(names, "fp", "left").select("rep", F.coalesce("component", "fp").alias("component"))
    return one_of_each(docs, classes.groupBy("component").agg(F.min("rep").alias("rep")).where("rep is not null").select("rep.*"))


# -- similarity of shingle sets --------------------------------------------------------------------------------------

#: Least hashes of a text's shingles, of which every four are a band. Texts of similarity J share no band with probability (1 - J ** ROWS) ** BANDS: 3 in a million at 0.8.
BANDS, ROWS = 24, 4
WIDE = BANDS * ROWS
LEAST_SIMILARITY = 0.8
#: Chance that a pair of the least similarity shares fewer positional bytes than the count filter asks for.
MISSED = 1e-6
#: In lists of up to so many different shingle sets all pairs are compared; in longer ones each with chosen members, round by round.
ALL_PAIRS = 16
#: Members of a longer list that all its others are compared with in the first round, and how many times more in each later one.
PIVOTS, MORE = 8, 4
#: Members, and pivots, of a list that one task compares; shingles of pivots, and cells of a 0-1 matrix, that it holds at once.
MEMBERS, TAKEN = 1024, 512
SHINGLES, CELLS = 1 << 16, 1 << 23
#: Buckets of the filter for sets that stand in a list.
FILTER = 1 << 22
_draw = np.random.default_rng(SEED)
FLIP = _draw.integers(0, 1 << 64, WIDE, np.uint64)
ODD = _draw.integers(0, 1 << 64, WIDE, np.uint64) | np.uint64(1)


def least_row() -> Column:
    """The smallest (doc_id, h) of the rows that have a doc_id."""
    return F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h")))


def least_shared(similarity: float) -> int:
    """Positional bytes that two texts of this similarity share at least, but for a chance of MISSED."""
    chance, n = 0.0, 0
    while (chance := chance + comb(WIDE, n) * similarity**n * (1 - similarity) ** (WIDE - n)) <= MISSED:
        n += 1
    return n


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least of each of WIDE hash functions over a set of shingles."""
    least = np.full(WIDE, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[k : k + 512, None] ^ FLIP) * ODD).min(0), out=least)
    return least


def set_name(hashes: np.ndarray) -> int:
    """64 bits that name a sorted set of hashes."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def marks(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, h, fp, name, n, wide, bands): hash and SimHash of every text, the name and size of its shingle set, its wide fingerprint and its bands.

    The wide fingerprint is one byte of each of the least hashes, WIDE positional bytes in all; a band is the name of
    four whole least hashes. A text without words has no bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            data, offsets = buffers(batch.column(1))
            low, fp, name, n, wide, bands = bytes(data).lower(), [], [], [], [], []
            for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                hashes = shingles(low[i:j].split(), size)
                different = np.unique(hashes)
                least = least_hashes(different)
                fp.append(majority(hashes)), name.append(set_name(different)), n.append(len(different))
                wide.append((least >> np.uint64(32)).astype(np.uint8).view(np.int64))
                bands.append([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))] if len(different) else [])
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            ragged_ = lambda x, values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(b) for b in x]))), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), signed(fp), signed(name), pa.array(n, pa.int64()), ragged_(wide, pa.array(np.concatenate(wide))), ragged_(bands, signed([k for b in bands for k in b]))], ["doc_id", "h", "fp", "name", "n", "wide", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    return rows.mapInArrow(run, "doc_id long, h long, fp long, name long, n long, wide array<long>, bands array<long>")


def shared_bytes(a: str, b: str) -> Column:
    """How many positional bytes two wide fingerprints share: eight at once, a byte that differs folded into its lowest bit."""
    total = F.lit(WIDE)
    for k in range(WIDE // 8):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def lists_of(sets: DataFrame) -> DataFrame:
    """(key, name, n, m): the sets that share a band with others, and how many do."""
    posted = sets.select("name", "n", F.explode("bands").alias("key"))
    return durable(posted.join(durable(posted.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")), "key"))


def short_pairs(lists: DataFrame) -> DataFrame:
    """(a, na, b, nb): all pairs of each list of up to ALL_PAIRS sets, with their sizes."""
    short = lists.where(F.col("m") <= ALL_PAIRS).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("name", "n"))).alias("x"))
    pairs = short.select("x", F.explode("x").alias("p")).select("p", F.explode(F.filter("x", lambda q: q["name"] > F.col("p.name"))).alias("q"))
    return pairs.select(F.col("p.name").alias("a"), F.col("p.n").alias("na"), F.col("q.name").alias("b"), F.col("q.n").alias("nb"))


def candidates(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs whose sizes allow the similarity and whose wide fingerprints share enough positional bytes."""
    allowed = pairs.where((F.col("a") != F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity)))
    of = lambda c: sets.select(F.col("name").alias(c), F.col("wide").alias(f"w{c}"))
    both = allowed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(of("b"), "b").join(of("a"), "a")
    return both.where(shared_bytes("wa", "wb") >= least_shared(similarity)).select("a", "b")


def shingle_sets(docs: DataFrame, names: DataFrame, size: int) -> DataFrame:
    """(name, shingles): the sets that ``names`` lists (a filter of FILTER buckets lets few others pass), made again from the texts."""
    wanted = np.zeros(FILTER, bool)
    wanted[names.select(F.pmod("name", F.lit(FILTER)).cast("int").alias("k")).distinct().toArrow().column(0).to_numpy()] = True
    held = np.packbits(wanted).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = np.unpackbits(np.frombuffer(held, np.uint8)).view(bool), set()
        for batch in slices(batches, 0):
            data, offsets = buffers(batch.column(0))
            low, name, sets = bytes(data).lower(), [], []
            for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                different = np.unique(shingles(low[i:j].split(), size))
                k = set_name(different)
                if wanted[k % FILTER] and k not in seen:
                    seen.add(k), name.append(k), sets.append(different.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(name, np.uint64).view(np.int64)), pa.array(sets, pa.binary())], ["name", "shingles"])

    return durable(docs.select("text").mapInArrow(run, "name long, shingles binary").groupBy("name").agg(F.first("shingles").alias("shingles")))


def rarest(names: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(key, name, n, at, m): the sets that ``names`` lists by those of their rarest shingles of which two alike share one.

    Sets of similarity J or more differ in so few shingles that, whatever the order of shingles, they share one of the
    first n - J * n + 1 of each; the smaller of the two has it among its first n - 2J / (1 + J) * n + 1. Rarest first,
    what very many texts share comes last and is left out, and texts that are not alike have enough of their own to
    share none. ``at`` is the shingle's place, m the length of its list; lists in which nothing stands early enough are
    left out, as is what is too late or too large for all that do. Counts are combined before the shuffle.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            data, offsets = buffers(batch.column(1))
            rows = np.repeat(batch.column(0).to_numpy(), np.diff(offsets) // 8)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.frombuffer(data.tobytes(), np.int64))], ["name", "shingle"])

    n, share = F.col("n"), similarity / (1 + similarity)
    each = sets.join(names.select("name").distinct(), "name", "left_semi").select("name", "shingles").mapInArrow(spread, "name long, shingle long")
    many = durable(each.groupBy("shingle").agg(F.count("*").alias("f")))
    held = each.join(many, "shingle").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("x")).withColumn("n", F.size("x").cast("long"))
    first = held.select("name", "n", F.posexplode(F.slice("x", F.lit(1), (n - F.ceil(n * similarity - 1e-9) + 1).cast("int"))).alias("at", "e")).where("e.f > 1")
    posted = durable(first.select(F.col("e.shingle").alias("key"), "name", "n", "at", (F.col("at") <= n - F.ceil(2 * share * n - 1e-9)).alias("early")))
    size = lambda f: f(F.when(F.col("early"), n))
    lists = posted.groupBy("key").agg(F.count("*").alias("m"), size(F.min).alias("lo"), size(F.max).alias("hi")).where("m > 1 and lo is not null")
    able = F.col("early") | ((n * similarity <= F.col("hi") + 1e-9) & (n - F.col("at") >= share * (n + F.col("lo")) - 1e-9))
    return durable(posted.join(lists, "key").where(able).select("key", "name", "n", "at", "m"))


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs of set names whose shingle sets have a Jaccard similarity of at least ``similarity``."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    of = lambda c: sets.select(F.col("name").alias(c), F.col("shingles").alias(f"s{c}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long")


def pivots(state: DataFrame, used: DataFrame | None, many: int) -> DataFrame:
    """(key, parts, piece, name, n, at, component): members of long lists (key, name, n, at, component) to compare in a round.

    Only lists of several components have work left: up to ``many`` members outside of the list's largest component
    that were not taken before. A list's members are compared in ``parts``, its pivots in pieces of TAKEN at most.
    """
    sizes = state.groupBy("key", "component").agg(F.count("*").alias("c"))
    open_ = sizes.groupBy("key").agg(F.count("*").alias("k"), F.sum("c").alias("m"), F.max(F.struct("c", "component")).alias("most")).where("k > 1")
    open_ = durable(open_.select("key", F.ceil(F.col("m") / MEMBERS).cast("int").alias("parts"), F.col("most.component").alias("most")))
    rest = state.join(open_, "key").where("component != most")
    rest = rest.join(used, ["key", "name"], "left_anti") if used is not None else rest
    taken = rest.groupBy("key", "parts", F.pmod(F.xxhash64("name"), F.lit(many)).alias("deal")).agg(F.min(F.struct("name", "n", "at", "component")).alias("p"))
    return durable(taken.select("key", "parts", F.floor(F.col("deal") / TAKEN).cast("int").alias("piece"), "p.*"))


def pivot_links(state: DataFrame, taken: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): components of which a pivot and a member of one list are alike.

    No pair is written: a task gets the shingles of a piece of a list's pivots, then streams a part of the list's members past
    them, so what is shuffled is every member once a piece, not once a pair. Pairs in one component, or whose sizes or
    places in the list rule the similarity out, are not looked at; those left are verified on whole sets, many at once, by a
    product of 0-1 matrices.
    """
    rows = ["name", "n", "at", "component"]
    pivot = taken.select("key", "piece", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), *rows)
    member = state.join(taken.select("key", "parts", "piece").distinct(), "key").select("key", "piece", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), *rows)
    both = pivot.unionByName(member).join(sets, "name").select(F.xxhash64("key", "piece", "part").alias("group"), "kind", "n", "at", "component", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in slices(batches, 5):
            number = batch.column(0).to_numpy()
            kind, n, at, of = (batch.column(k).to_numpy() for k in (1, 2, 3, 4))
            shingle = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(5)]
            links = set()
            for k in np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))).tolist():
                if number[k] != group:
                    group, held = number[k], []
                end = k + int(np.searchsorted(number[k:], number[k], "right"))
                split = k + int(np.searchsorted(kind[k:end], 1))
                held += [(n[i], at[i], of[i], shingle[i]) for i in range(k, split)]
                if held and split < end:
                    links |= met([(n[i], at[i], of[i], shingle[i]) for i in range(split, end)], held, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])

    return both.repartition("group").sortWithinPartitions("group", "kind").mapInArrow(run, "a long, b long").distinct()


Member = tuple[int, int, int, np.ndarray]


def met(members: list[Member], others: list[Member], similarity: float) -> set[tuple[int, int]]:
    """Pairs of components that a member and another of one list link; each is (size, place in the list, component, shingles)."""
    n, at, of = (np.array([x[k] for x in members], np.int64) for k in range(3))
    m, to, at_ = (np.array([x[k] for x in others], np.int64) for k in (0, 2, 1))
    least = np.ceil(similarity / (1 + similarity) * (n[:, None] + m) - 1e-9)
    able = (of[:, None] != to) & (np.minimum(n[:, None], m) >= similarity * np.maximum(n[:, None], m) - 1e-9) & (np.minimum((n - at)[:, None], m - at_) >= least)
    out, k = set(), 0
    while k < len(others):  # so many others at once that their shingles stay within bounds
        end = k + max(1, int(np.searchsorted(np.cumsum(m[k:]), SHINGLES, "right")))
        rows = np.flatnonzero(able[:, k:end].any(1))
        if len(rows):
            tokens, place = np.unique(np.concatenate([x[3] for x in others[k:end]]), return_inverse=True)
            theirs = np.zeros((len(tokens), end - k), np.float32)
            theirs[place, np.repeat(np.arange(end - k), m[k:end])] = 1
            step = max(1, CELLS // len(tokens))
            for r in range(0, len(rows), step):
                some = rows[r : r + step]
                flat = np.concatenate([members[i][3] for i in some])
                where = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
                hit = tokens[where] == flat
                own = np.zeros((len(some), len(tokens)), np.float32)
                own[np.repeat(np.arange(len(some)), n[some])[hit], where[hit]] = 1
                shared = (own @ theirs).astype(np.float64)
                i, j = np.nonzero(able[some, k:end] & (shared >= similarity * (n[some][:, None] + m[k:end] - shared)))
                out |= set(zip(of[some][i].tolist(), to[k:end][j].tolist()))
        k = end
    return out


def keep_one_alike(docs: DataFrame, size: int = 5, similarity: float = LEAST_SIMILARITY, bits: int = 2) -> DataFrame:
    """Documents with one row left of each component of near-duplicates: that with the smallest doc_id, then hash of text.

    Two texts are linked if the Jaccard similarity of their sets of ``size``-word shingles is at least ``similarity``,
    or if their SimHashes differ in at most ``bits`` bits. For the first, the index is that of a wider fingerprint,
    WIDE positional bytes of least hashes: texts that share four neighbouring least hashes share a list; the positional
    bytes that a pair shares are tallied, pairs that reach the least for the similarity are verified on whole sets. A
    list of over ALL_PAIRS different sets is not paired up. Its members are listed again by their rarest shingles
    (``rarest``), which loses no pair; where such a list is long, too, members that its largest component has not
    reached are compared with all others by blocks (``pivot_links``), ever more of them in each round, until every two
    are in one component or were compared; only links between components are written. So what can be missed is a pair that shares no band or too few bytes (chances at BANDS and MISSED), no more.

    Rows as in ``keep_one_each``: different texts under one doc_id are judged each on its own, of repeated rows one
    stays, rows with null doc_id all stay; an empty table stays empty. Long texts count whole.
    """
    if similarity < LEAST_SIMILARITY:
        raise ValueError(f"bands are for similarities of {LEAST_SIMILARITY} or more")
    marked = durable(marks(docs, size))
    first = [F.first(c).alias(c) for c in ("fp", "n", "wide", "bands")]
    sets = durable(marked.groupBy("name").agg(*first, least_row().alias("rep")))
    lists = lists_of(sets)
    pairs = durable(candidates(short_pairs(lists), sets, similarity))
    long_ = lists.where(F.col("m") > ALL_PAIRS).select("name").distinct()
    held = shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("name")).unionByName(long_), size)
    lists = rarest(long_, held, similarity)
    pairs = pairs.unionByName(candidates(short_pairs(lists), sets, similarity)).distinct()
    # what repeats shingles may share a set and no fingerprint, or the other way round: documents link the two
    heads = marked.groupBy("fp").agg(F.min("name").alias("head"))
    same = marked.select("fp", "name").distinct().join(heads, "fp").select(F.col("head").alias("a"), F.col("name").alias("b"))
    near = near_fingerprints(heads, bits).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    names = components(alike(pairs, held, similarity).unionByName(same).unionByName(near)).withColumnRenamed("node", "name")
    first = durable(lists.where(F.col("m") > ALL_PAIRS).join(names, "name", "left").select("key", "name", "n", "at", F.coalesce("component", "name").alias("component")))
    state, used, roots, many = first, None, None, PIVOTS
    while not (taken := pivots(state, used, many)).isEmpty():
        new = pivot_links(state, taken, held, similarity)
        roots = components(new if roots is None else new.unionByName(roots.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        state = durable(renamed(first, roots))
        used = taken.select("key", "name") if used is None else used.unionByName(taken.select("key", "name"))
        many *= MORE
    classes = sets.select("name", "rep").join(names, "name", "left").withColumn("component", F.coalesce("component", "name"))
    classes = classes if roots is None else renamed(classes, roots)
    return one_of_each(docs, classes.groupBy("component").agg(F.min("rep").alias("rep")).where("rep is not null").select("rep.*"))


def renamed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows with their ``component`` as what ``roots`` (node, component) makes of it."""
    to = roots.select(F.col("node").alias("component"), F.col("component").alias("root"))
    return rows.join(to, "component", "left").withColumn("component", F.coalesce("root", "component")).drop("root")
