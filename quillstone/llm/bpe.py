"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is split by the pattern, and every match is encoded by itself. The library encodes each different piece of a part
once; what it made of short pieces is remembered, up to a bound. (The regex library splits as the pattern's origin does,
for every code point, and several times faster than the library's own splitter.) The merges come from a rank file: a token's merge is the pair that lower ranks leave of its bytes. A rank file's bytes
are written with the usual byte-to-character table, so every byte is one character of the vocabulary. Offsets follow
from the ids: a token covers as many bytes as it has, and a byte belongs to the character in which it lies; characters
that are split between tokens are counted for every token that holds a byte of them. Decoding reverses the table, so
bytes come back as they were, split characters included.

Nulls: a null text is encoded as an empty one. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Texts that are split at a time hold about so many characters.
CALL_CHARS = 1 << 20
#: Pieces that a task remembers, and how long they may be.
REMEMBER, SHORT = 300_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def byte_characters() -> list[str]:
    """One printable character for each byte: printable ones of Latin-1 stand for themselves, others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        if b not in out:
            out[b] = chr(0x100 + len(out) - len(own))
    return [out[b] for b in range(256)]


def _pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The last two parts when the token's bytes are merged by ranks below its own."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: r if (r := ranks.get(parts[i] + parts[i + 1], own)) < own else own)
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


@lru_cache(maxsize=4)
def tokenizer_json(path: str) -> str:
    """The tokenizer for a rank file as the library's JSON; its size is bounded by the vocabulary."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks, to = read_ranks(path), byte_characters()
    spelt = lambda token: "".join(map(to.__getitem__, token))
    vocab = {spelt(t): r for t, r in ranks.items()}
    merges = [tuple(map(spelt, _pair(t, ranks))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    t = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return t.to_str()


def token_bytes(spec: str) -> list[bytes]:
    """The bytes of each id, by the reversed byte table."""
    back = {c: b for b, c in enumerate(byte_characters())}
    vocab = json.loads(spec)["model"]["vocab"]
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(map(back.__getitem__, token))
    return out


def char_offsets(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last character of each token, given the tokens' numbers of bytes."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(lengths):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character of each byte
    ends = np.cumsum(lengths)
    return char[ends - lengths], char[ends - 1] + 1


def calls(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CALL_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


class Pieces(dict):
    """The ids of pieces of text, in whatever form make(ids) gives them."""

    def __init__(self, spec: str, pattern: str, make: Callable[[list[int]], object]):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.make, found = Tokenizer.from_str(spec), make, regex.compile(pattern)
        self.split = (lambda t: [m.group() for m in found.finditer(t)]) if found.groups else found.findall

    def of(self, texts: list[str]) -> Iterator[list[object]]:
        """What each text's pieces were made, in their order."""
        split = list(map(self.split, texts))
        new = list(set(chain.from_iterable(split)) - self.keys())
        for part in calls(new):
            self.update(zip(part, (self.make(e.ids) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        for pieces_ in split:
            yield list(map(self.__getitem__, pieces_))
        if len(self) > REMEMBER:
            self.clear()
        for p in new:
            if len(p) > SHORT:
                self.pop(p, None)


def _column(batch: pa.RecordBatch, name: str) -> list[str]:
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """doc_id, ids array<int>, and with offsets: byte_ends, char_starts and char_ends array<int>."""
    spec = tokenizer_json(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, length = Pieces(spec, pattern, list), np.array(list(map(len, token_bytes(spec))), np.int64)
        for batch in pieces(batches):
            at = 0
            for part in calls(_column(batch, "text")):
                found = [np.fromiter(chain.from_iterable(own), np.int32) for own in known.of(part)]
                cols = [batch.column("doc_id").slice(at, len(part)), pa.array(found, pa.list_(pa.int32()))]
                if offsets:
                    spans = [char_offsets(s, length[ids]) for s, ids in zip(part, found, strict=True)]
                    cols += [pa.array([np.cumsum(length[ids]) for ids in found], pa.list_(pa.int32())), pa.array([s for s, _ in spans], pa.list_(pa.int32())), pa.array([e for _, e in spans], pa.list_(pa.int32()))]
                at += len(part)
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "byte_ends", "char_starts", "char_ends"][: len(cols)])

    more = ", byte_ends array<int>, char_starts array<int>, char_ends array<int>" if offsets else ""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + more)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, data binary: the bytes of the ids; null ids give no bytes, ids outside the vocabulary fail."""
    spec = tokenizer_json(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = token_bytes(spec)
        for batch in pieces(batches):
            data = [b"".join(map(own.__getitem__, ids or [])) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode the ids, in one pass over the texts."""
    spec = tokenizer_json(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = token_bytes(spec)
        known = Pieces(spec, pattern, lambda ids: (len(ids), " ".join(map(str, ids)), b"".join(map(own.__getitem__, ids))))
        for batch in pieces(batches):
            n, sha, back = [], [], []
            for part in calls(_column(batch, "text")):
                for made in known.of(part):
                    counts, written, data = zip(*made, strict=True) if made else ((), (), ())
                    n.append(sum(counts))
                    sha.append(hashlib.sha256(" ".join(written).encode()).hexdigest())
                    back.append(hashlib.sha256(b"".join(data)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
