"""I-Match fingerprints with randomised lexicon subsets, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, durable, ordered_ranges

#: The band: a term is in at least this share of all documents (and in two), and at most that share.
LEAST, MOST = 2e-4, 0.05
#: At most this many terms are broadcast; a larger lexicon is joined by shuffling.
BROADCAST_TERMS = 1_000_000
#: First documents of ranges are broadcast if there are at most about so many ranges, else joined by shuffling.
BROADCAST_RANGES = 1_000_000
#: Subsets as (bits, from, value): terms of which so many bits of the hash, from that one on, have the value. So 4 subsets
#: hold a 16th of the lexicon each, 8 a 64th, 16 a 256th and 8 a 1024th: for texts of any length some hold a few terms.
SUBSETS = [(bits, 15 * k, value) for k, (bits, many) in enumerate(((4, 4), (6, 8), (8, 16), (10, 8))) for value in range(many)]
#: Documents in each range of doc_id that is sorted at once.
RANGE_ROWS = 500


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-case terms (letters and digits) of a text."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, text: str = "text", least: float = LEAST, most: float = MOST) -> DataFrame:
    """(term, id): hashes of the terms, and shorter ones to send, whose inverse document frequency lies in the band, counted over all documents.

    As each term is in at least ``least`` of the documents, there are at most (distinct terms of a document, on
    average) / ``least`` of them, whatever the number of documents. Counts are combined before the shuffle.
    """
    total = docs.count()
    found = docs.select(F.explode(terms(F.coalesce(text, F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return durable(found.where((F.col("df") >= max(2, least * total)) & (F.col("df") <= max(2, most * total))).select("term", F.hash("term").alias("id")))


def signatures(texts: DataFrame, words: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key..., sig): for each subset of the lexicon the hash of the sorted distinct terms of a text in it; 0 if there are none.

    ``key`` must be unique. A text without any term of the lexicon isn't returned. If the texts are dealt by the first
    column of the key, as ``with_next`` leaves them, their terms are grouped where they are, without a shuffle.
    """
    if words.count() <= BROADCAST_TERMS:
        words = F.broadcast(words)
    held = texts.select(*key, F.explode(terms(F.col(text))).alias("term")).join(words, "term")
    held = held.groupBy(*key).agg(F.sort_array(F.transform(F.collect_list("id"), lambda t: F.xxhash64(t))).alias("held"))

    def drawn(bits: int, at: int, value: int):
        return lambda t: F.shiftrightunsigned(t, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) == value

    subsets = []
    for subset in SUBSETS:
        own = F.filter("held", drawn(*subset))
        subsets.append(F.when(F.size(own) > 0, F.xxhash64(own)).otherwise(F.lit(0).cast("long")))
    return held.select(*key, F.array(*subsets).alias("sig"))


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets held by either text on which both agree; 1 if neither holds any."""
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) | (y != 0)), lambda v: v))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != 0)), lambda v: v))
    return F.when(either == 0, F.lit(1.0)).otherwise(same / either)


def with_next(docs: DataFrame) -> DataFrame:
    """(range, rid, doc_id, text, next_id, next_text): every document and the one after it by doc_id; the first follows the last.

    Documents are sorted in many ranges of doc_id at once, and the first document of each range is lent to the range
    before it, so no task sorts all. Rows that repeat a doc_id are ordered by text. ``range`` and
    ``rid`` name a row.
    """
    count = docs.count()
    parts = -(-count // RANGE_ROWS)
    rows, per = ordered_ranges(docs, "doc_id", parts)
    firsts = rows.groupBy("range").agg(F.min("doc_id").alias("doc_id")).withColumn("coarse", F.floor(F.col("range") / per))
    edge = firsts.groupBy("coarse").agg(F.max("range").alias("last"))
    edge = edge.select("coarse", F.coalesce(F.lag("last").over(Window.orderBy("coarse")), F.max("last").over(Window.orderBy("coarse").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("last"))
    lent = firsts.join(F.broadcast(edge), "coarse").select("doc_id", F.coalesce(F.lag("range").over(Window.partitionBy("coarse").orderBy("range")), "last").alias("range"))
    lent = durable(lent)
    if parts <= BROADCAST_RANGES:
        lent = F.broadcast(lent)  # a row for each range
    borrowed = docs.join(lent, "doc_id").select("doc_id", "text", F.coalesce("range", F.lit(0)).alias("range"), F.lit(1).alias("lent"))
    both = rows.select("doc_id", "text", "range", F.lit(0).alias("lent")).unionByName(borrowed)
    order = Window.partitionBy("range").orderBy("lent", "doc_id", "text")
    both = both.select("*", F.row_number().over(order).alias("n"), F.lead("doc_id").over(order).alias("next_id"), F.lead("text").over(order).alias("next_text"))
    return both.where("lent = 0").select("range", F.col("n").cast("long").alias("rid"), "doc_id", "text", "next_id", "next_text")


def both_fingerprints(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, next_id, hashes, n_chars, edited_sha256, own, edit): fingerprints of each row's text and edited text.

    All steps keep the rows where the sort by range has put them.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), "text"), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text"))))
    sig = signatures(rows.select("range", "rid", sides.alias("v")).select("range", "rid", "v.*"), words, ["range", "rid", "side"], "text")
    sig = sig.groupBy("range", "rid").agg(F.max(F.when(F.col("side") == 0, F.col("sig"))).alias("own"), F.max(F.when(F.col("side") == 1, F.col("sig"))).alias("edit"))
    spine = rows.select("range", "rid", "doc_id", "next_id", F.xxhash64("text").alias("h"), F.xxhash64("edited").alias("edited_h"), F.xxhash64("next_text").alias("next_h"), n.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    alone = lambda h: F.array(*[F.xxhash64(h, F.lit(k)) for k in range(len(SUBSETS))])
    both = spine.join(sig, ["range", "rid"], "left")
    return both.select("doc_id", "next_id", "h", "next_h", "n_chars", "edited_sha256", F.coalesce("own", alone("h")).alias("own"), F.coalesce("edit", alone("edited_h")).alias("edit"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how alike they and the next document's are.

    The edited text has the last floor(n/2) of n code points replaced by as many from the start of the next document.
    Null texts count as empty. A text without a term in the band (an empty one, say) has a fingerprint of its hash
    alone, alike only to equal texts. Rows that repeat a doc_id keep a row each; rows without doc_id have no next
    document and are edited with nothing. An empty table gives no rows; texts of any length count whole; other columns,
    whatever their names, are not read.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    words = lexicon(docs)
    part = F.pmod(F.xxhash64("text"), F.lit(4096))
    number = F.row_number().over(Window.partitionBy("range").orderBy("text")).cast("long")
    loose = docs.where("doc_id is null").withColumn("range", part).select("range", number.alias("rid"), "doc_id", "text", F.lit(None).cast("long").alias("next_id"), F.lit("").alias("next_text"))
    full = durable(both_fingerprints(with_next(docs.where("doc_id is not null")), words).unionByName(both_fingerprints(loose, words)))
    following = full.where("doc_id is not null").groupBy(F.col("doc_id").alias("next_id"), F.col("h").alias("next_h")).agg(F.first("own").alias("after"))
    full = full.join(following, ["next_id", "next_h"], "left")
    text_of = lambda c: F.concat_ws("", F.transform(c, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))), 8, "0")))
    return full.select("doc_id", "n_chars", "edited_sha256", text_of("own").alias("fingerprint"), text_of("edit").alias("edited_fingerprint"), likeness(F.col("own"), F.col("edit")).alias("near_edited"), F.coalesce(likeness(F.col("own"), F.col("after")), F.lit(0.0)).alias("near_next"))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
