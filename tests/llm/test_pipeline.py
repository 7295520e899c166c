import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from factgate.llm import langid, private

from test_alike import kept
from test_repeats import brute


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert seen[-1].columns == docs.columns
    rows = [{r.doc_id: r.asDict() for r in df.collect()} for df in seen[:-1]]

    judge = langid.Judge(langid.dictionaries(docs), langid.MARGIN)
    import pyarrow as pa

    ids = sorted(rows[0])
    verdict = judge(pa.array([rows[0][i]["text"] for i in ids]))
    assert set(rows[1]) == {i for i, (_, _, no) in zip(ids, verdict) if not no}

    assert set(rows[2]) == kept([(i, r["text"]) for i, r in sorted(rows[1].items())])

    left = {i: (w, g) for i, w, g in brute([(i, r["text"]) for i, r in sorted(rows[2].items())], 50)}
    assert set(rows[3]) == {i for i, (w, g) in left.items() if not len(w) or not g.all()}
    for i, r in rows[3].items():
        w, g = left[i]
        assert r["text"].encode().split() == [x for x, y in zip(w, g) if not y]
        assert {k: v for k, v in r.items() if k != "text"} == {k: v for k, v in rows[2][i].items() if k != "text"}

    assert set(rows[4]) == set(rows[3])
    named = private.entities(spark.createDataFrame([(i, r["text"]) for i, r in rows[3].items()], "row long, text string"), private.KEY).where("kind = 'name'")
    given = {tuple(r[c] for c in private.NAME): r.new for r in private.name_surrogates(named, private.KEY).collect()}
    hidden = 0
    for i, r in rows[4].items():
        before = rows[3][i]["text"]
        assert r["text"] == private.replace(before, private.KEY, given)[0]
        titled = {before[a:b] for a, b, *_ in private.names(before)}
        assert not any(re.search(rf"(?<!\w){re.escape(n)}(?!\w)", r["text"]) for n in titled)
        hidden += r["text"] != before
    assert hidden > 5

    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words.encode_special_tokens = True
    ids = {i: np.array([*words.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for i, r in rows[4].items()}
    at, ends = {i: 0 for i in ids}, {}
    for r in sorted(seen[-1].collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {i: len(x) for i, x in ids.items()}
    for pieces in ends.values():
        total = 0
        for offset, length in sorted(pieces):
            assert offset == total
            total += length
        assert total <= 2048


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "sequence_id" in out.columns
