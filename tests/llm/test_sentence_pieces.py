"""Encoding against the library: ids, spans and texts, with normalisers of other kinds put into the model."""

import hashlib
import random

import pytest
import sentencepiece
from public_tokenizers import path

from quillstone.llm import sentence_pieces as sp

MODEL = path("piece_bpe_32k.model")
ALPHABET = "ab ▁\t\n　 é漢字🙂ÅＡﬁ¨À\u0001\x00<unk></s>0½…  "


def varint(x):
    out = b""
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def remade(rule=None, prefix=1, trim=1, fallback=True):
    """The model with the compiled map of a rule, or without bytes for what the vocabulary lacks."""
    out = b""
    for number, value, raw in sp.fields(sp.read_model(MODEL)):
        if rule and number == sp.NORMALIZER:
            own = next(v for n, v, _ in sp.fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()) if n == sp.NORMALIZER)
            compiled = {n: v for n, v, _ in sp.fields(own)}[2]
            body = b"\x12" + varint(len(compiled)) + compiled + bytes([0x18, prefix, 0x20, trim, 0x28, 1])
            raw = b"\x1a" + varint(len(body)) + body
        if not fallback and number == sp.TRAINER:
            body = b"".join(r for n, _, r in sp.fields(value) if n != 35)
            raw = b"\x12" + varint(len(body)) + body
        if not fallback and number == sp.PIECE and raw.endswith(b"\x18\x06"):
            raw = raw[:-1] + bytes([sp.UNUSED])
        out += raw
    return out


def cases(n=600):
    rnd = random.Random(5)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(14))) for _ in range(n)] + ["", " ", "  ", "▁", "a" * 3000, "漢字かな" * 500, "x y " * 300]


@pytest.mark.parametrize("kind", [{}, {"rule": "nfkc"}, {"rule": "nmt_nfkc"}, {"rule": "nmt_nfkc", "trim": 0}, {"rule": "nfkc_cf", "prefix": 0}, {"fallback": False}])
def test_ids_and_spans_like_the_library(kind):
    data = remade(**kind)
    coder, rows = sp.Encoder(data), cases()
    for text, (ids, starts, ends) in zip(rows, coder.of([t.encode() for t in rows]), strict=True):
        want = coder.own.encode(text, return_type="proto").pieces
        assert [(p.id, p.begin, p.end) for p in want] == list(zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True)), repr(text)


def test_longest_entry_of_the_map():
    compiled = {n: v for n, v, _ in sp.fields(next(v for n, v, _ in sp.fields(remade("nfkc")) if n == sp.NORMALIZER))}[2]
    own = sp.CharMap(compiled)
    assert own.longest("ﬁx".encode()) == (3, b"fi") and own.longest(b"x") == (0, b"")
    assert own.longest("A\u030ab".encode()) == (3, "\u00c5".encode())  # two characters as one
    assert sp.CharMap(b"").longest(b"a") == (0, b"")


def test_segments_and_their_memory_change_nothing():
    text = "The quick brown fox, " * 40 + "x" * 5000 + "…" * 20
    small, large = sp.Encoder(sp.read_model(MODEL), remember=1), sp.Encoder(sp.read_model(MODEL))
    rows = [text.encode()] * 3 + [b"again the fox"]
    for a, b in zip(small.of(rows), large.of(rows), strict=True):
        assert a[0].tolist() == b[0].tolist()
    assert next(large.of([text.encode()]))[0].tolist() == large.own.encode(text)


def test_bytes_that_are_not_utf8():
    ids, starts, ends = next(sp.Encoder(sp.read_model(MODEL)).of([b"a\xff\xfeb"]))
    assert ids.tolist() == sp.Encoder(sp.read_model(MODEL)).own.encode("a��b")
    assert starts[0] == 0 and ends[-1] == 4 and (starts <= ends).all()


def test_round_trip_of_a_table(spark):
    rows = [(1, "Größe  of\nthings", "x"), (2, None, "x"), (None, "null id", "x"), (3, "", "x"), (1, "Größe  of\nthings", "x"), (4, "word " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coder = sp.Encoder(sp.read_model(MODEL))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = coder.own.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(coder.own.decode(ids)), len((t or "").encode())))
    assert sorted(map(str, map(tuple, sp.round_trip(docs, MODEL).collect()))) == sorted(map(str, want))
    encoded = sp.encode(docs, MODEL)
    back = {(r["doc_id"], r["text"]) for r in sp.decode(encoded, MODEL).collect()}
    assert back == {(i, t or "") for i, t, _ in rows}
    assert all(r["starts"][0] == 0 and r["ends"][-1] == len("Größe  of\nthings".encode()) for r in encoded.filter("doc_id = 1").collect())
    assert sp.round_trip(docs.limit(0), MODEL).count() == 0
