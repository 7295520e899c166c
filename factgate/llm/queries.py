"""Queries of the corpus operators and, where SQL can express them over whole tables, the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fim, imatch, langid, pack, partitions, private, recompress, search, simhash, suffixes, toxicity, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (pack.op1_packing, pack.packing_conversations, toxicity.op2_toxicity, imatch.op3_imatch, suffixes.op4_suffix_array_dedup, simhash.op5_simhash_near_dedup, vectors.op6_embedding_near_dedup, private.op7_pii_surrogates, recompress.op8_recompression_dedup, bpe.op9_byte_bpe, langid.op10_language_id, partitions.op11_learned_partitions, fim.op12_fill_in_middle, search.op13_lexical_search)}


#: Words of every document and what follows each, by place; then the windows of so many words that a smaller document has.
WORDS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS t FROM documents),
     win AS (SELECT doc_id, i, array_to_string(w[i : i + {last}], ' ') AS s
             FROM (SELECT doc_id, w, unnest(range(1, len(w) - {last} + 1)) AS i FROM d)),
     lo AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s),
     gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {last} + 1)) AS p FROM win JOIN lo USING (s) WHERE lo < doc_id),
     word AS (SELECT doc_id, unnest(w) AS w, unnest(t) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
     kept AS (SELECT word.* FROM word ANTI JOIN gone USING (doc_id, p)),
     lost AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE p - 1 NOT IN (SELECT p FROM gone g WHERE g.doc_id = gone.doc_id)) AS spans FROM gone GROUP BY doc_id)
"""
OP4 = WORDS.format(last=49) + r"""
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(CASE WHEN n IS NULL THEN text ELSE coalesce(rest, '') END) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN (
  SELECT doc_id, string_agg(s, chr(10) ORDER BY k) AS rest FROM (
    SELECT doc_id, p - r AS k, rtrim(string_agg(t, '' ORDER BY p), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM kept) GROUP BY doc_id, p - r) GROUP BY doc_id) USING (doc_id)
"""
OP8 = WORDS.format(last=12) + r"""
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS rest FROM kept GROUP BY doc_id) USING (doc_id)
"""
OP6 = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pair AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
many AS (SELECT a AS vec_id, count(*) AS n FROM pair GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN low USING (vec_id) LEFT JOIN many USING (vec_id)
"""
TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13 = rf"""
WITH has AS (SELECT * FROM (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS t FROM documents) WHERE len(t) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS length FROM has),
post AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM has) GROUP BY r, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, total GROUP BY term),
item AS (SELECT row_number() OVER () AS i, item_id, {TERMS} AS t FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
asked AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(t) AS term FROM item) GROUP BY i, item_id, term),
scored AS (SELECT i, item_id, doc_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(t) * docs) // length)))) AS BIGINT) AS score
           FROM asked JOIN weight USING (term) JOIN post USING (term) JOIN has USING (r), total WHERE doc_id IS NOT NULL GROUP BY i, item_id, doc_id, r),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    """SQL for those that it can express; the others hash with XXH64, compress, tokenise, learn, cut by hashes of ids or draw by keys."""
    return {"op4_suffix_array_dedup": OP4, "op6_embedding_near_dedup": OP6, "op8_recompression_dedup": OP8, "op13_lexical_search": OP13}
