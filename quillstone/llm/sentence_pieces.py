"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised here, as a model's file says: at each character the longest key of the compiled character map gives
way to its replacement (or the character stays), white space is trimmed, escaped and prefixed, and every normalised
byte records where in the source its unit began. The library's own BPE then encodes the normalised text, and the pieces'
lengths, laid over that record, project every piece to the bytes of the source that it came from.

Pieces never span two neighbouring characters that no entry of the vocabulary holds side by side, so a normalised text is
encoded in segments cut between such characters: the result is that of the whole text, short segments are remembered up
to a bound, and a long text without blanks isn't one call. Decoding is the library's, on the model as it is.

Defined results. Null text: as an empty one, without tokens. Texts of white space only: as the model has it (blanks are tokens, or
trimmed to nothing). Bytes that aren't UTF-8: U+FFFD each. Very long texts: one at a time, in memory that
follows the text. Repeated rows and null ids: a row each. Empty table: no rows. Only doc_id and the text are read, so
extra columns of any name stay behind.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts

BLANK = "▁"
#: A task forgets its segments when they have so many pieces; and how long a segment between blanks is before it is cut again.
REMEMBER, LONG = 2_000_000, 256
#: Texts normalised before the library is called hold about so many bytes.
CALL_BYTES = 1 << 20
#: Kinds of entries in a model file, and its fields (fixed values of the public format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECE, TRAINER, NORMALIZER = 1, 2, 3


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(number, value, the field as it stands) of a message in protocol buffers' wire format."""
    at = 0
    while at < len(data):
        begin = at
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value = data[at : at + size]
            at += size
        yield key >> 3, value, data[begin:at]


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 bytes whose values are offsets into replacements."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if compiled else []
        self.values = compiled[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, key: bytes) -> tuple[int, bytes]:
        """(length of the longest entry that key begins with, its replacement); length 0 without any."""
        if not self.units:
            return 0, b""
        at, found, value = self._offset(self.units[0]), 0, 0
        for n, b in enumerate(key, 1):
            at ^= b
            if at >= len(self.units) or self.units[at] & 0x800000FF != b:
                break
            unit = self.units[at]
            at ^= self._offset(unit)
            if unit >> 8 & 1:
                found, value = n, self.units[at] & 0x7FFFFFFF
        return found, self.values[value : self.values.index(b"\0", value)] if found else b""

    def keys(self) -> Iterator[bytes]:
        """All entries, by walking the trie."""
        units, labels = np.array(self.units, np.int64), np.arange(1, 256)
        todo = [(self._offset(self.units[0]), b"")] if self.units else []
        while todo:
            base, prefix = todo.pop()
            at = base ^ labels
            inside = at < len(units)
            for b in labels[inside][(units[at[inside]] & 0x800000FF) == labels[inside]].tolist():
                unit = self.units[base ^ b]
                if unit >> 8 & 1:
                    yield prefix + bytes([b])
                todo.append((base ^ b ^ self._offset(unit), prefix + bytes([b])))

    @cached_property
    def places(self) -> tuple[re.Pattern | None, int]:
        """Where an entry may begin: characters that are one, or that begin one and stand before one's second; and the most characters of an entry."""
        known = [k.decode() for k in self.keys()]
        one, first, second = ({k for k in known if len(k) == 1}, {k[0] for k in known if len(k) > 1}, {k[1] for k in known if len(k) > 1})
        some = lambda cs: "[" + "".join(map(re.escape, sorted(cs))) + "]"
        ways = ([some(one)] if one else []) + ([f"{some(first)}(?={some(second)})"] if first else [])
        return (re.compile("|".join(ways)) if ways else None), max(map(len, known), default=0)


class Model:
    """What a model file says of pieces and of normalisation."""

    def __init__(self, data: bytes):
        self.data, self.pieces, self.kinds = data, [], []
        norm, self.suffix, self.byte_fallback = {}, False, False
        for number, value, _ in fields(data):
            if number == PIECE:
                own = {n: v for n, v, _ in fields(value)}
                self.pieces.append(own.get(1, b""))
                self.kinds.append(own.get(3, NORMAL))
            elif number == TRAINER:
                own = {n: v for n, v, _ in fields(value)}
                self.suffix, self.byte_fallback = bool(own.get(24, 0)), bool(own.get(35, 0))
            elif number == NORMALIZER:
                norm = {n: v for n, v, _ in fields(value)}
        self.map = CharMap(norm.get(2, b""))
        self.prefix, self.trim, self.escape = (bool(norm.get(n, 1)) for n in (3, 4, 5))
        own = sorted((p.decode() for p, k in zip(self.pieces, self.kinds, strict=True) if k == USER and p), key=len, reverse=True)
        self.user = re.compile("|".join(map(re.escape, own))) if own else None

    def core(self) -> bytes:
        """The model with a normaliser that leaves texts as they are."""
        plain = b"\x0a\x08identity" + b"\x18\x00\x20\x00\x28\x00"  # name, no prefix, no trimming, no escaping
        kept = b"".join(raw for number, _, raw in fields(self.data) if number != NORMALIZER)
        return kept + bytes([NORMALIZER << 3 | 2, len(plain)]) + plain

    # normalisation

    @staticmethod
    def _characters(raw: bytes) -> tuple[str, np.ndarray]:
        """The text, and where each character begins; a byte that isn't UTF-8 is one U+FFFD."""
        try:
            text, bad = raw.decode(), []
        except UnicodeDecodeError:
            text, at, bad = "", 0, []
            while at < len(raw):
                try:
                    text += raw[at:].decode()
                    break
                except UnicodeDecodeError as e:
                    text += raw[at : at + e.start].decode() + "�"
                    bad.append(len(text) - 1)
                    at += e.start + 1
        width = _widths(_points(text))
        width[bad] = 1
        return text, np.concatenate((np.zeros(1, np.int64), np.cumsum(width)))

    def _units(self, text: str) -> tuple[str, np.ndarray, np.ndarray, int]:
        """Longest-prefix normalisation: the string, and for each of its characters the source's character at which its unit
        begins, and whether it goes on with the unit before it; and the first character that gives way to nothing."""
        find, longest = self.map.places
        places = iter(()) if find is None else find.finditer(text)
        ends = {} if self.user is None else {m.start(): m.end() for m in self.user.finditer(text)}
        out, source, inner, at, gone = [], [], [], 0, len(text)
        for i in sorted({m.start() for m in places} | ends.keys()):
            if i < at:
                continue
            if i in ends:
                size, new = ends[i] - i, text[i : ends[i]]
            else:
                found, value = self.map.longest(text[i : i + longest].encode())
                if not found:
                    continue
                size, new = len(text[i : i + longest].encode()[:found].decode()), value.decode()
            gone = gone if new else min(gone, i)
            out += [text[at:i], new]
            source += [np.arange(at, i), np.full(len(new), i)]
            inner += [np.zeros(i - at, bool), np.arange(len(new)) > 0]
            at = i + size
        if not out:
            return text, np.arange(len(text)), np.zeros(len(text), bool), gone
        return "".join([*out, text[at:]]), np.concatenate([*source, np.arange(at, len(text))]), np.concatenate([*inner, np.zeros(len(text) - at, bool)]), gone

    def _unchanged(self, raw: bytes) -> tuple[str, np.ndarray] | None:
        """normalised() where the map has no entries that a text could hold, blanks are escaped at most and all bytes are UTF-8."""
        if self.map.units or self.user is not None:
            return None
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return None
        data = np.frombuffer(raw, np.uint8)
        starts = np.arange(len(raw), dtype=np.int32)
        if not text.isascii():
            starts = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, starts, 0))
        blank = BLANK if self.escape else " "
        if self.escape:
            text, starts = text.replace(" ", BLANK), np.repeat(starts, np.where(data == 32, len(BLANK.encode()), 1))
        if self.prefix:
            text, starts = blank + text, np.concatenate((np.zeros(len(blank.encode()), np.int32), starts))
        return text, np.append(starts, np.int32(len(raw)))

    def normalised(self, raw: bytes) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and for its end, where in the source its unit begins."""
        if not raw:
            return "", np.zeros(1, np.int64)
        if not self.trim and not self.suffix and (plain := self._unchanged(raw)) is not None:
            return plain
        text, starts = self._characters(raw)
        new, source, inner, gone = self._units(text)
        heading = 0
        if self.trim:
            space = _points(new) == 32
            drop = space & np.concatenate((np.ones(1, bool), space[:-1])) & ~inner
            for j in np.flatnonzero(space & inner):  # blanks within a replacement go as the ones before them in it go
                drop[j] = drop[j - 1]
            first = np.flatnonzero(~(space & ~inner))
            heading = min(gone, int(source[first[0]]) if len(first) else len(text))
            if heading == len(text):
                return "", np.zeros(1, np.int64)
            new, source = _points(new)[~drop].tobytes().decode("utf-32-le"), source[~drop]
        if self.escape:
            new = new.replace(" ", BLANK)
        blank, end = BLANK if self.escape else " ", len(raw)
        if self.prefix:
            new, source = (new + blank, np.append(source, len(text))) if self.suffix else (blank + new, np.insert(source, 0, heading))
        if self.trim and new.endswith(blank) and not self.suffix:
            short = len(new.rstrip(blank))
            end, new, source = int(starts[source[short]]), new[:short], source[:short]
        return new, np.append(np.repeat(starts[source], _widths(_points(new))), end)

    # segments

    @cached_property
    def pairs(self) -> np.ndarray:
        """Sorted pairs of characters that stand side by side in an entry."""
        own = {p[i : i + 2] for p, k in zip((x.decode() for x in self.pieces), self.kinds, strict=True) if k in (NORMAL, USER, UNUSED) for i in range(len(p) - 1)}
        return np.unique(np.array([ord(a) << 21 | ord(b) for a, b in own], np.int64))

    @cached_property
    def blanks_begin(self) -> bool:
        """Whether a blank after another character always begins a piece."""
        seconds = self.pairs[(self.pairs & (1 << 21) - 1) == ord(BLANK)] >> 21
        return self.escape and not set(seconds.tolist()) - {ord(BLANK)} and BLANK.encode() in self.pieces

    def cut(self, text: str) -> list[str]:
        """The text between neighbours that no entry holds."""
        if len(text) < 2:
            return [text]
        points = _points(text).astype(np.int64)
        both = points[:-1] << 21 | points[1:]
        if not len(self.pairs):
            return list(text)
        near = self.pairs[np.minimum(np.searchsorted(self.pairs, both), len(self.pairs) - 1)] == both
        at = [0, *(np.flatnonzero(~near) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip(at, at[1:], strict=False)]

    def segments(self, text: str) -> list[str]:
        if not self.blanks_begin:
            return self.cut(text)
        words = _WORDS(text)
        if max(map(len, words), default=0) <= LONG:
            return words
        return list(chain.from_iterable(self.cut(w) if len(w) > LONG else (w,) for w in words))


_WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+").findall


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _widths(points: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each code point."""
    return 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)


class Remembered(dict):
    """Numbers of segments, given out as they come; new ones wait to be encoded. What they became stands end to end in one array."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.ids, self.width = (np.empty(1 << 12, np.int32) for _ in range(2))
        self.ends = np.zeros(1 << 12, np.int64)  # of number n at n + 1

    def __missing__(self, segment: str) -> int:
        n = self[segment] = len(self)
        self.new.append(segment)
        return n

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        return array if size <= len(array) else np.concatenate((array, np.empty(max(size - len(array), len(array)), array.dtype)))

    def add(self, lengths: np.ndarray, ids: np.ndarray, width: np.ndarray) -> None:
        """What the waiting segments became: numbers of pieces, and the pieces' ids and bytes."""
        first = len(self) - len(self.new)
        begin = int(self.ends[first])
        self.ends = self._room(self.ends, len(self) + 1)
        self.ends[first + 1 : len(self) + 1] = begin + np.cumsum(lengths)
        self.ids, self.width = (self._room(x, begin + len(ids)) for x in (self.ids, self.width))
        self.ids[begin : begin + len(ids)], self.width[begin : begin + len(ids)] = ids, width
        self.new = []

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and bytes of the pieces of segments, one after the other."""
        starts, ends = self.ends[numbers], self.ends[numbers + 1]
        counts = ends - starts
        before = np.cumsum(counts)
        at = np.arange(before[-1] if len(before) else 0) + np.repeat(starts - before + counts, counts)
        return self.ids[at], self.width[at]

    @property
    def held(self) -> int:
        return int(self.ends[len(self)])


class Encoder:
    """Encodes and decodes with one model; lives in a task."""

    def __init__(self, data: bytes, remember: int = REMEMBER):
        from sentencepiece import SentencePieceProcessor

        self.model, self.remember, self.known = Model(data), remember, Remembered()
        self.own, self.core = SentencePieceProcessor(model_proto=data), SentencePieceProcessor(model_proto=self.model.core())
        self.decode = self.own.decode
        kinds = np.array(self.model.kinds)
        self.width = np.where(kinds == BYTE, 1, np.array(list(map(len, self.model.pieces)), np.int32))
        self.unknown = -1 if self.model.byte_fallback else self.core.unk_id()

    def _learn(self) -> None:
        """Encode the segments that wait."""
        found, widths = self.core.encode(self.known.new, num_threads=1), []
        for i, ids in enumerate(found):
            if self.unknown in ids:  # the library joins unknown characters that stand together
                own = self.core.encode(self.known.new[i], return_type="proto").pieces
                found[i] = [p.id for p in own]
                widths.append((i, [p.end - p.begin for p in own]))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))
        width, ends = self.width[ids], np.cumsum(lengths)
        for i, own in widths:
            width[ends[i] - lengths[i] : ends[i]] = own
        self.known.add(lengths, ids, width)

    def _pieces(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and piece lengths of a text; neighbouring unknown pieces are one."""
        ids, width = self.known.joined(numbers)
        if self.unknown < 0 or not len(ids):
            return ids, width
        unknown = ids == self.unknown
        first = np.flatnonzero(~(unknown & np.concatenate((np.zeros(1, bool), unknown[:-1]))))
        return ids[first], np.add.reduceat(width, first)

    def of(self, rows: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, and the first and past-the-last source byte of each piece, for each text."""
        at = 0
        while at < len(rows):
            part, size = [], 0
            while at < len(rows) and (not part or size < CALL_BYTES):
                text, origin = self.model.normalised(rows[at])
                cut = self.model.segments(text)
                part.append((np.fromiter(map(self.known.__getitem__, cut), np.int64, len(cut)), origin))
                size += len(rows[at])
                at += 1
            if self.known.new:
                self._learn()
            for numbers, origin in part:
                ids, width = self._pieces(numbers)
                ends = np.cumsum(width)
                yield ids, origin[ends - width], origin[ends]
            if self.known.held > self.remember:
                self.known = Remembered()


def read_model(path: str) -> bytes:
    """A model file, read where the job is declared; tasks get its bytes, so executors need no such file."""
    with open(path, "rb") as f:
        return f.read()


def _rows(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, text: str = "text", remember: int = REMEMBER) -> DataFrame:
    """doc_id, ids array<int>, starts and ends array<int>: the source's bytes of each piece. Pieces of one replaced character,
    and the bytes of a character that the vocabulary lacks, share its span or leave it to the last of them."""
    data = read_model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(data, remember)
        for batch in pieces(batches, 64):
            found = list(coder.of(texts(batch.column("text"))))
            lists = [pa.array([f[i].astype(np.int32) for f in found], pa.list_(pa.int32())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], names=["doc_id", "ids", "starts", "ends"])

    return _rows(docs, text).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: what the library's decode gives; null ids give an empty text."""
    data = read_model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(data)
        for batch in pieces(batches, 64):
            back = [coder.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(back, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes (of the source, that the pieces' spans hold), in one pass over the texts."""
    data = read_model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(data)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        names = list(map(str, range(len(coder.model.pieces))))
        for batch in pieces(batches, 64):
            n, own, back, covered = [], [], [], []
            for ids, starts, ends in coder.of(texts(batch.column("text"))):
                listed = ids.tolist()
                n.append(len(listed))
                own.append(sha(",".join(map(names.__getitem__, listed))))
                back.append(sha(coder.decode(listed)))
                covered.append(int((ends - starts).sum()))
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string()), pa.array(covered, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])

    return _rows(docs, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")
