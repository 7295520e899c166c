import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factgate.llm import bpe, pack

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a" * 3000, "x y  \n z q  ", "\n\n  hi 's don't  ", "日本語テキスト 🙂🙂 ééé", "\x00\x01 <|endoftext|> ab", "   ", "İstanbul ΑΣ ΣΑΣ ﬁ é", "word\x1cother \x85 x", "١٢٣ ²³ ½", "a\xa0 b\xa0\n c"]


@pytest.fixture(scope="module")
def library():
    with open(BYTES, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


def lists(flat, at):
    return [flat[i:j].tolist() for i, j in zip(at[:-1], at[1:])]


def test_byte_level_ids_are_the_librarys(library):
    v = bpe.vocabulary(BYTES, public_tokenizers.PATTERN)
    for texts in (ODD, ODD[:8], [t for t in ODD if t.isascii()]):
        ids, at = v.encode(pa.array(texts))
        assert lists(ids, at) == [library.encode_ordinary(t) for t in texts]
        data, ends = v.decode(ids, at)
        assert [data[i:j].tobytes().decode() for i, j in zip(ends[:-1], ends[1:])] == texts


def test_word_level_ids_are_the_librarys(words):
    v = bpe.vocabulary(WORDS)
    ids, at = v.encode(pa.array(ODD))
    assert lists(ids, at) == [e.ids for e in words.encode_batch(ODD, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text(texts):
    v = bpe.vocabulary(BYTES, public_tokenizers.PATTERN)
    ids, at = v.encode(pa.array(texts, pa.string()))
    with open(BYTES, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)} if not hasattr(test_any_text, "enc") else None
    if ranks:
        test_any_text.enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert lists(ids, at) == [test_any_text.enc.encode_ordinary(t) for t in texts]
    data, ends = v.decode(ids, at)
    assert data.tobytes().decode() == "".join(texts)


def test_long_pieces_merge_alike():
    v = bpe.vocabulary(BYTES, public_tokenizers.PATTERN)
    draw = random.Random(2)
    for n in (255, 256, 257, 400):
        piece = bytes(draw.choice(b"abcthe ion") for _ in range(n)).replace(b" ", b"x")
        whole = v.merge([piece])[0].tolist()
        assert whole == v._heap(piece).tolist()
        assert sum(len(v.token_bytes[v.token_offsets[i] : v.token_offsets[i + 1]]) for i in whole) == n


def test_encoding_query(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op9_byte_bpe(spark, sf).collect():
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_encode_keeps_every_row(docs, rows, none):
    got = bpe.encode(docs, BYTES, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in got) == sorted((str(i), t or "") for i, t in rows)
    assert bpe.encode(none, BYTES, public_tokenizers.PATTERN).count() == 0


def check_packed(got, texts, words, tokens):
    ids = {i: np.array([*words.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(ids[i][r.start : r.start + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    waste = total = 0
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= tokens
        total += at
        waste += 0 if at & (at - 1) == 0 else tokens - at
    assert waste <= 0.01 * total


def test_packing_query(spark, sf, words):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_packed(pack.op1_packing(spark, sf).collect(), texts, words, 2048)


def test_packing_of_odd_rows(spark, words, none):
    texts = dict(enumerate([*ODD, None, "one two three " * 3000]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_packed(pack.pack(df, WORDS).collect(), {i: t or "" for i, t in texts.items()}, words, 2048)
    assert pack.pack(none, WORDS).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 90)), max_size=60), st.integers(1, 6), st.integers(1, 40))
def test_all_limits_hold(items, segments, loss):
    packer, out = pack.Packer(32, segments, loss, pool=7), []
    for k, (n, prompt) in enumerate(items):
        out += packer.add(k, n, prompt)
    out += packer.flush()
    seen = {}
    for pieces in out:
        assert sum(n for _, _, n in pieces) <= 32 and len(pieces) <= max(segments, 1)
        assert sum(max(0, s + n - max(s, items[k][1])) for k, s, n in pieces) <= loss
        for k, s, n in pieces:
            seen.setdefault(k, []).append((s, n))
    for k, (n, _) in enumerate(items):
        at = 0
        for s, m in sorted(seen[k]):
            assert s == at
            at += m
        assert at == n


def test_prompts_bear_no_loss(spark, words):
    """Examples of a prompt and an answer: pieces make them up whole, and no sequence passes any limit."""
    draw = random.Random(8)
    say = lambda n: " ".join(draw.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    rows = [(i, say(draw.randrange(80)), say(draw.randrange(120)), "x") for i in range(200)] + [(500, None, None, "x")] + [(501, say(9000), "", "x")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt string, offset string").repartition(2)
    got = pack.pack(df, WORDS, tokens=256, segments=6, loss=100, prompt="prompt").collect()
    ids = {}
    for i, text, prompt, _ in rows:
        asked = words.encode(prompt or "", add_special_tokens=False).ids
        ids[i] = (len(asked), asked + words.encode(text or "", add_special_tokens=False).ids + [1])
    sequences, seen = {}, {}
    for r in got:
        asked, own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.length, max(0, r.start + r.length - max(r.start, asked))))
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {i: len(own) * (2 if i == 501 else 1) for i, (_, own) in ids.items()}
    for pieces in sequences.values():
        assert sum(n for n, _ in pieces) <= 256 and sum(loss for _, loss in pieces) <= 100 and len(pieces) <= 6
    assert max(sum(loss for _, loss in p) for p in sequences.values()) == 100
    assert pack.pack(df.limit(0), WORDS, prompt="prompt").count() == 0


def test_conversations_are_packed_whole(spark, sf, words):
    """Every answer is an example of all that was said before it; pieces of an example are told by conversation, turn and repeat."""
    said = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    count = lambda t: len(words.encode(t, add_special_tokens=False).ids)
    want = {}
    for (conv, turn), r in said.items():
        if r.role == "assistant":
            asked = "".join(said[conv, k].text + "\n" for k in range(turn) if (conv, k) in said)
            want[conv, turn, 0] = (count(asked), count(asked) + count(r.text) + 1)
    got, sequences = {}, {}
    for r in pack.packing_conversations(spark, sf).collect():
        key = r.doc_id, r.turn, r.repeat
        got.setdefault(key, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.length, max(0, r.start + r.length - max(r.start, want[key][0]))))
    assert set(got) == set(want) and len(want) > 10 and max(n for n, _ in want.values()) > 0
    for key, pieces in got.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == want[key][1]
    for pieces in sequences.values():
        assert sum(n for n, _ in pieces) <= 2048 and sum(loss for _, loss in pieces) <= pack.ANSWERED


def test_odd_conversations(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", None), (1, 4, "assistant", None),
        (2, 0, "assistant", "first"), (2, 0, "assistant", "first"), (2, 1, "assistant", "then"),
        (None, 0, "user", "lost"), (None, 1, "assistant", "who"), (None, 1, "assistant", "who"), (3, None, "user", "early"), (3, 0, "assistant", "late"), (4, 0, None, "x"),
    ]
    df = spark.createDataFrame([(*r, 9, "z") for r in rows], "conv_id long, turn int, role string, text string, prompt int, repeat string")
    out = pack.answers(df)
    got = sorted((tuple(r) for r in out.where("conv_id is not null").collect()), key=str)
    assert got == sorted([(1, 2, 0, "be kind\nhi\n", "hello"), (1, 4, 0, "be kind\nhi\nhello\n", ""), (2, 0, 0, "", "first"), (2, 0, 1, "first\n", "first"), (2, 1, 0, "first\nfirst\n", "then"), (3, 0, 0, "early\n", "late")], key=str)
    lost = out.where("conv_id is null").collect()
    assert [(r.turn, r.prompt, r.text) for r in lost] == [(1, "", "who")] * 2 and len({r.repeat for r in lost}) == 2
    assert pack.answers(df.limit(0)).count() == 0
