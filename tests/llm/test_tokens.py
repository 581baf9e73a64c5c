"""BPE and token files against the tokenizers library, and the packed coding's round trip."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, queries, simple8b


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.vocabulary())


@pytest.fixture(scope="module")
def codecs():
    spec = bpe.read_vocabulary(queries.vocabulary())
    return bpe.codec_of(spec), simple8b.LibraryCodec(spec)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, codecs, text):
    want = library.encode(text, add_special_tokens=False).ids
    for codec in codecs:
        assert codec.encode(text) == want
    assert codecs[0].decode(want) == library.decode(want, skip_special_tokens=False)


PART = st.sampled_from([*"abDE'stremvdl \n\t.,!019ÀàéÉßñ×÷ÿŠİΣς²½Ⅷ中😀", "'s", "'RE", "'ll", "n't", "\x1c", "\x85", "\u00a0", "\u0301", "<|endoftext|>"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.lists(PART, max_size=40).map("".join)), max_size=6))
def test_texts_together(library, codecs, texts):
    """All texts of a batch at once, in parts so small that words are cut off at their ends."""
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    whole = bpe.AT_ONCE
    try:
        for bpe.AT_ONCE in (7, whole):
            for codec in codecs:
                flat, counts = codec.encode_all(texts)
                assert flat.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
    finally:
        bpe.AT_ONCE = whole


@pytest.mark.parametrize("text", ["", "it's we'LL they've", "<|endoftext|>a<|startoftext|> <|end", "a\x1cb\x85c d e​f", "½²³ 123 ٣", "ΑΣ ΣΑΣ İK", "é ́x 각", "日本語 ###$$$", "ß" * 300])
def test_odd_texts(library, codecs, text):
    for codec in codecs:
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_forgetting_changes_nothing(codecs):
    small = bpe.Remembered(codecs[0].word, 3)
    words = [f"w{n % 11}ord" for n in range(100)]
    assert [small[w] for w in words] == [codecs[0].word(w) for w in words]


def test_op10(spark, data, library, docs_of, odd):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op10_bpe(spark, data).collect()}
    for r in rows:
        ids = library.encode(r.text, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and got[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    out = bpe.encode(docs_of(odd).withColumnRenamed("source", "ids"), queries.vocabulary()).collect()
    assert len(out) == len(odd) and (out[0].ids, out[0].decoded) == ([], "")
    assert bpe.encode(docs_of([]), queries.vocabulary()).count() == 0


def test_op6(spark, data, library):
    rows = sorted(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in queries.op6_token_files(spark, data).collect()}
    start = 0
    for r in rows:
        ids = library.encode(r.text, add_special_tokens=False).ids + [2]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op6_odd_rows(docs_of, odd, library):
    ids = [9, 3, None, 5, 5, 1, 0, 2, 4, 6, 7]
    got = simple8b.round_trip(docs_of(odd, ids).withColumnRenamed("lang", "shard"), queries.vocabulary()).collect()
    assert len(got) == len(odd) and sorted(r.start for r in got)[0] == 0
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [None, 0, 1, 2, 3, 4, 5, 5, 6, 7, 9]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(by_start, by_start[1:], strict=False))
    null = next(r for r in got if r.doc_id == 9)
    assert list(null.ids) == [2]
    assert simple8b.round_trip(docs_of([]), queries.vocabulary()).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, (1 << 64) - 1), st.sampled_from([15 << 60, (1 << 60) - 1, 1 << 60])), max_size=300))
def test_packing(values):
    ids = np.array(values, np.uint64)
    words, runs = simple8b.pack(ids)
    assert (simple8b.unpack(words, runs, len(ids)) == ids).all()


def test_runs_start_words():
    ids = np.arange(simple8b.RUN * 3 + 5, dtype=np.uint64)
    words, runs = simple8b.pack(ids)
    assert len(runs) == 4
    for k in range(4):
        end = runs[k + 1] if k < 3 else len(words)
        own = ids[k * simple8b.RUN : (k + 1) * simple8b.RUN]
        assert (simple8b.unpack(words[runs[k] : end], runs[:1], len(own)) == own).all()
    doc_ids, lengths, back = simple8b.parse(simple8b.chunk([1, None, -3], np.array([0, 2, 1]), np.r_[ids[:2], 1].astype("<u4")))
    assert (doc_ids, lengths.tolist(), back.tolist()) == ([1, None, -3], [0, 2, 1], [0, 1, 1])
