"""Byte-level BPE against the tiktoken library, and token counts against a plain greedy match."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quillstone.llm import bpe, word_pieces
from quillstone.llm.queries import tokenizer
from tests.llm import brute

SCHEMA = "doc_id long, text string, ids string, key long"


@pytest.fixture(scope="module")
def own():
    ranks = bpe.read_ranks(tokenizer()[0])
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(4)
    letters = "ab Z'\t\n\r\x0b\x1c\x85\xa0é漢字🙂👩‍👩‍👧ﬀ​ ٣²ſ"
    return [None, "", " ", "  two  spaces ", "it's we'LL I'd <|endoftext|>", "a" * 5000, "x" * 70 + " " + "x" * 70, "\x00﻿", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(60))]


def frame(spark, values):
    return spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(values)] + [(None, "no id", None, 1)], SCHEMA).repartition(3)


def expected(own, t):
    ids = own.encode_ordinary(t or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()


def test_round_trip_like_tiktoken(spark, own):
    got = {r[0]: tuple(r)[1:] for r in bpe.round_trip(frame(spark, texts()), *tokenizer()).collect()}
    assert got == {**{i: expected(own, t) for i, t in enumerate(texts())}, None: expected(own, "no id")}


def test_forgetting_changes_nothing(spark, own, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    monkeypatch.setattr(bpe, "CALL_CHARS", 50)
    test_round_trip_like_tiktoken(spark, own)


def test_documents_like_tiktoken(spark, own):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in bpe.round_trip(docs, *tokenizer()).collect()}
    assert got == {r["doc_id"]: expected(own, r["text"]) for r in docs.collect()}


def test_offsets_and_decoding(spark, own):
    path, pattern = tokenizer()
    encoded = bpe.encode(frame(spark, texts()), path, pattern)
    data = {r[0]: bytes(r[1]) for r in bpe.decode(encoded, path).collect()}
    for r in encoded.filter("doc_id IS NOT NULL").collect():
        t = texts()[r["doc_id"]] or ""
        assert list(r["ids"]) == own.encode_ordinary(t)
        assert data[r["doc_id"]] == t.encode()
        ends = [0, *r["byte_ends"]]
        for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            part = t[r["char_starts"][k] : r["char_ends"][k]].encode()
            assert t.encode()[a:b] in part and len(part) < b - a + 7  # whole characters around the token's bytes


def test_empty_table(spark):
    assert bpe.round_trip(frame(spark, []).limit(0), *tokenizer()).count() == 0
    assert word_pieces.token_counts(frame(spark, []).limit(0), [b"a"]).count() == 0


def test_lengths_like_greedy_match():
    rng = random.Random(2)
    for _ in range(60):
        vocabulary = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 12))}
        automaton = word_pieces.Automaton(sorted(vocabulary))
        words = [bytes(rng.choice(b"abcd" if rng.random() < 0.1 else b"abc") for _ in range(rng.randint(0, 14))) for _ in range(50)]
        assert automaton.lengths(words).tolist() == [brute.pieces(w, vocabulary) for w in words]


def test_counts_of_documents(spark):
    vocabulary = set(bpe.read_ranks(tokenizer()[0]))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).unionByName(frame(spark, [None, "", " ", "é" * 400]).select("doc_id", "text"), allowMissingColumns=True)
    got = sorted(map(tuple, word_pieces.token_counts(docs, list(vocabulary)).collect()), key=str)
    want = [(r["doc_id"], len(w := brute.words(r["text"])), sum(brute.pieces(b" " + x, vocabulary) for x in w)) for r in docs.select("doc_id", F.col("text")).collect()]
    assert got == sorted(want, key=str)
