"""Tokenizers, token output and counts against the libraries."""

import base64
import hashlib
import json
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftstone.llm import bpe, huffman, queries, tokencount

BPE = P.path("byte_bpe_multi_50k.tiktoken")
WORD = P.path("word_bpe_49k.json")
PIECE = P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
PARTS = st.sampled_from([" ", "  ", "\n", "\t", "\r\n", "the", "Abab", "aaaa", "é", "É", "漢字", "😀", "'s", "don't", "12", "!!", "　", "▁", "\x1c", "\x85", "<s>", "<|endoftext|>", "<|startoftext|>", "é", "İ", "ß", "x" * 40])
TEXT = st.lists(PARTS, max_size=40).map("".join)


@pytest.fixture(scope="module")
def libraries():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(WORD), sentencepiece.SentencePieceProcessor(model_file=PIECE)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encoders_equal_the_libraries(libraries, text):
    tik, word, piece = libraries
    (_, ids), = bpe.SegmentTreeBPE.shared(BPE, P.PATTERN).encode_batch([text])
    assert ids.tolist() == tik.encode_ordinary(text)
    assert bpe.SegmentTreeBPE.shared(BPE, P.PATTERN).decode(ids) == text.encode()
    (packed,) = huffman.ChunkEncoder.shared(WORD).encode_batch([text.encode()])
    assert np.frombuffer(packed, "<u2").tolist() == word.encode(text, add_special_tokens=False).ids
    assert tokencount.RankSynchronousCounter.shared(PIECE).count_batch([text]) == [len(piece.encode(text))]


def test_long_runs(libraries):
    tik, _, piece = libraries
    for text in ("a" * 3000, " " * 700, "ab" * 1500, "▁" * 65, "xyz" * 900 + " end"):
        assert bpe.SegmentTreeBPE.shared(BPE, P.PATTERN).encode_batch([text])[0][1].tolist() == tik.encode_ordinary(text)
        assert tokencount.RankSynchronousCounter.shared(PIECE).count_batch([text]) == [len(piece.encode(text))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=200), min_size=1, max_size=4), st.sampled_from(["abcdefgh", "aab", "thean", "é漢a"]), st.integers(0, 2**32 - 1))
def test_trees_on_lists_equal_trees_on_arrays(libraries, raw, letters, seed):
    coder = bpe.SegmentTreeBPE.shared(BPE, P.PATTERN)
    rng = np.random.default_rng(seed)
    words = [*raw, *("".join(rng.choice(list(letters), rng.integers(1, 300))).encode() for _ in range(3))]
    for w in words:
        width = 1 << max(1, (len(w) - 1).bit_length())
        (one,) = coder._merge_class([w], np.array([len(w)]), width)
        assert coder._merge_one(w, width).tolist() == one.tolist()


def test_one_very_long_word(libraries):
    tik, word, piece = libraries
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("etaoinshrdlu"), 40_000))
    began = time.time()
    assert bpe.SegmentTreeBPE.shared(BPE, P.PATTERN).encode_batch([text])[0][1].tolist() == tik.encode_ordinary(text)
    assert time.time() - began < 20
    coder = bpe.SegmentTreeBPE.shared(BPE, P.PATTERN)
    counter = tokencount.RankSynchronousCounter.shared(PIECE)
    assert counter.count_batch([text]) == [len(piece.encode(text))]
    (packed,) = huffman.ChunkEncoder.shared(WORD).encode_batch([text.encode()])
    assert np.frombuffer(packed, "<u2").tolist() == word.encode(text, add_special_tokens=False).ids
    # workers keep no such word
    chunks = huffman.ChunkEncoder.shared(WORD)
    assert max(map(len, [*coder.seen, *counter.seen, *chunks.seen, *chunks.words])) <= 128


def test_another_tokenizer_goes_through_its_library(tmp_path, libraries):
    made = json.loads(libraries[1].to_str())
    made["normalizer"] = None  # keeps upper case
    path = tmp_path / "other.json"
    path.write_text(json.dumps(made))
    texts = ["Hello World it's", "don't ABC 12", ""]
    other = Tokenizer.from_file(str(path))
    got = huffman.ChunkEncoder(str(path)).encode_batch([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [other.encode(t, add_special_tokens=False).ids for t in texts]
    assert huffman.ChunkEncoder.shared(WORD).known


def test_rows_of_one_id_are_dealt_and_keep_together(spark):
    rows = [(3 if k % 2 else None, f"text number {k % 7}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    out = huffman.write_and_read(df, WORD).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None] * 200 + [3] * 200
    assert all(b.start == a.start + a.n_tokens for a, b in zip(out, out[1:], strict=False))


def test_caches_turn_over(libraries, monkeypatch):
    tik = libraries[0]
    monkeypatch.setattr(bpe, "KEPT", 3)
    b = bpe.SegmentTreeBPE(bpe.load_ranks(BPE), P.PATTERN)
    for k in range(6):
        text = f"some words again {k} and more{k}"
        assert b.encode_batch([text, text])[1][1].tolist() == tik.encode_ordinary(text)


EDGE = "doc_id long, text string, n_tokens int, ids string"
ROWS = [(5, None, 1, "x"), (1, "", 1, "x"), (3, "Hello world, hello", 1, "x"), (3, "Hello world, hello", 1, "x"), (None, "w " * 5000, 1, "x")]


def test_edge_rows(spark, libraries):
    df = spark.createDataFrame(ROWS, EDGE)
    empty = hashlib.sha256(b"").hexdigest()
    got = {(r.doc_id, r.n_tokens) for r in bpe.encode_and_decode(df, BPE, P.PATTERN).collect()}
    assert {(5, 0), (1, 0), (3, len(libraries[0].encode_ordinary("Hello world, hello")))} <= got and len(got) == 4
    assert {r.ids_sha256 for r in bpe.encode_and_decode(df.filter("doc_id in (1, 5)"), BPE, P.PATTERN).collect()} == {empty}
    assert [r.n_tokens for r in tokencount.token_counts(df.filter("doc_id = 5"), PIECE).collect()] == [0]
    rows = huffman.write_and_read(df, WORD).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 3, 3, 5] and rows[1].n_tokens == rows[4].n_tokens == 1
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False))
    for made in (bpe.encode_and_decode(df.limit(0), BPE, P.PATTERN), tokencount.token_counts(df.limit(0), PIECE), huffman.write_and_read(df.limit(0), WORD)):
        assert made.count() == 0


def test_queries_equal_the_libraries(spark, libraries):
    tik, word, piece = libraries
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op3_byte_bpe(spark, SF).collect():
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    start = 0
    for r in queries.op4_huffman_ids(spark, SF).orderBy("doc_id").collect():
        ids = np.array(word.encode(texts[r.doc_id], add_special_tokens=False).ids + [1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for r in queries.op7_token_counts(spark, SF).collect():
        n = len(piece.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=2, max_size=400), st.integers(0, 2**32 - 1))
def test_huffman_round_trip_and_kraft(counts, seed):
    counts = np.array(counts + [1, 1])
    lengths = huffman.code_lengths(counts)
    assert lengths.max() <= huffman.LIMIT and sum(2.0 ** -int(x) for x in lengths if x) == 1.0
    used = np.flatnonzero(counts)
    ids = np.random.default_rng(seed).choice(used, 1000).astype(np.uint16)
    code = huffman.Codebook(lengths)
    a, b = code.decode([code.encode(ids), code.encode(ids[:1])])
    assert (a == ids).all() and (b == ids[:1]).all()


def test_lengths_stop_at_the_limit_and_are_optimal():
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    assert huffman.code_lengths(np.array(fib)).max() == huffman.LIMIT
    assert huffman.code_lengths(np.array([5, 0, 9, 12, 13, 16, 45])).tolist() == [4, 0, 4, 3, 3, 3, 1]
    assert huffman.code_lengths(np.array([0, 7])).tolist() == [0, 1]
