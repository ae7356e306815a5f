"""Substring dedup over bytes with suffix arrays, built by linear grouping.

Every byte covered by a WINDOW-byte string that also starts elsewhere is found. Anchors and contexts narrow the texts to
places where such strings can be (see seeds): a context that occurs more than once is a repeat as it is. The different
contexts of an anchor are cut to what can be repeated at all and written one after the other; the suffix array of that string
brings equal windows together, and so tells which are repeated.

The suffix array is built in two linear phases. First suffixes are put into groups by their longest Lyndon prefix: groups
are taken in descending order; pointers to the previous smaller suffix tell which suffixes a group extends, and those
move, by how often they are met, into new groups right after their own. Then the order within groups is emitted: going
up the suffix array, each suffix places the suffixes whose Lyndon prefix ends where it starts. Nothing is renamed and
nothing recurses.

Nulls: a null text is an empty one. Rows that repeat both id and text count as one document; texts shorter than WINDOW
bytes stay as they are. Removing bytes may part a character; what is kept is bytes. Extra columns stay behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seeds
from .common import BASE, Scratch, mixed, pieces, texts

WINDOW, GRAM_DOUBLINGS = 200, 6
GRAM = 1 << GRAM_DOUBLINGS
#: Segments of one suffix array hold about so many bytes; an anchor's segments stay together.
ARRAY_BYTES = 1 << 16

_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def _make():
    def split(t: bytes):
        raw = np.frombuffer(t, np.uint8)
        n = len(raw) - GRAM + 1
        raw_of = lambda s, e: t[s:e]
        digests = lambda s, e, left: np.array([xxhash.xxh3_64_intdigest(t[a:b], k) for a, b, k in zip(s.tolist(), e.tolist(), left.tolist(), strict=True)], np.uint64)
        if n <= 0:
            return np.empty(0, np.uint64), raw_of, digests
        h, factor = _BYTE[raw], BASE
        with np.errstate(over="ignore"):
            for i in range(GRAM_DOUBLINGS):
                w = 1 << i
                h = h[:-w] * factor + h[w:]
                factor = factor * factor
        return mixed(h), raw_of, digests

    return split


UNIT = seeds.Unit(WINDOW, GRAM, _make)
REACH = UNIT.reach


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of a string of symbols in lexicographic order (a shorter one before its extensions)."""
    n = len(text)
    first: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        first.setdefault(c, []).append(i)
    # Groups of equal Lyndon prefixes so far, members in text order, linked in ascending order.
    members = [first[c] for c in sorted(first)]
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    lower = list(range(-1, len(members) - 1))
    upper = [*range(1, len(members)), -1]
    size = [len(own) for own in members]
    done, prev, final = bytearray(n), [-1] * n, []

    def after(old: int) -> int:
        """A new group right after the old one."""
        new, above = len(members), upper[old]
        members.append([])
        size.append(0)
        lower.append(old)
        upper.append(above)
        upper[old] = new
        if above >= 0:
            lower[above] = new
        return new

    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]  # others have moved to greater groups since
        if own:
            final.append(own)
            for i in own:
                done[i] = 1
            if len(own) == 1:  # most groups: what follows, for one suffix
                p = own[0] - 1
                while p >= 0 and done[p]:
                    p = prev[p]
                prev[own[0]] = p
                if p >= 0 and size[old := group[p]] > 1:
                    size[old] -= 1
                    group[p] = new = after(old)
                    members[new].append(p)
                    size[new] = 1
                g = lower[g]
                continue
            # The previous smaller suffixes, none before the last: equal ones follow one another.
            met: dict[int, int] = {}
            for i in own:
                p = i - 1
                while p >= 0 and done[p]:
                    p = prev[p]
                prev[i] = p
                if p >= 0:
                    met[p] = met.get(p, 0) + 1
            by_count: dict[int, list[int]] = {}
            for p, c in met.items():
                by_count.setdefault(c, []).append(p)
            for c in sorted(by_count, reverse=True) if len(by_count) > 1 else by_count:
                moved: dict[int, int] = {}
                for p in by_count[c]:
                    old = group[p]
                    if size[old] == 1 and old not in moved:  # alone in its group, which stands for the new one
                        continue
                    new = moved.get(old)
                    if new is None:  # right after the old group: those met less often come in between later
                        new = moved[old] = after(old)
                    size[old] -= 1
                    size[new] += 1
                    group[p] = new
                    members[new].append(p)
        g = lower[g]
    # Ascending groups, each with its first free place.
    free, at = [0] * n, 0
    for own in reversed(final):
        for i in own:
            group[i] = at
        free[at] = at
        at += len(own)
    order, placed = [n] * n, bytearray(n + 1)
    for rank in range(-1, n):
        s = (n if rank < 0 else order[rank]) - 1
        while s >= 0 and not placed[s]:
            placed[s] = 1
            g = group[s]
            order[free[g]] = s
            free[g] += 1
            s = prev[s]
    return order


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _reaches(sides: list[bytes]) -> list[int]:
    """How far each side agrees with the one that agrees with it the longest."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    out = [0] * len(sides)
    for i, j in zip(order, order[1:], strict=False):
        n = _common(sides[i], sides[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def narrowed(contexts: list[tuple]) -> list[tuple]:
    """(members, left, segment) of one anchor's contexts (n, did, uid, pos, segment), no two of them equal.

    What lies farther from the anchor than a context agrees with any other can't be in a repeated window: segments are cut
    there, and those that are left too short for a window are put aside. Equal remains are one segment with several members
    (n, did, uid, pos); left is how much of it lies before the anchor.
    """
    lefts = [min(x[3], REACH) for x in contexts]
    most_left = _reaches([x[4][:a][::-1] for x, a in zip(contexts, lefts, strict=True)])
    most_right = _reaches([x[4][a + GRAM :] for x, a in zip(contexts, lefts, strict=True)])
    same: dict[tuple[int, bytes], list[tuple]] = {}
    for x, a, l, r in zip(contexts, lefts, most_left, most_right, strict=True):
        if l + r >= REACH:
            same.setdefault((l, x[4][a - l : a + GRAM + r]), []).append(x[:4])
    return [(own, l, segment) for (l, segment), own in same.items()]


def repeats(groups: list[list[tuple]]) -> list[tuple]:
    """(did, uid, pos, windows) of places that occur once, by the windows around them that are found elsewhere.

    groups: the segments (members, left, segment) of anchors, as narrowed gives them. Windows of a segment with several
    members, or with one that occurs several times, are repeated; others if the suffix array brings a window of another
    place next to them. No window starts inside an anchor or after it, so what all segments of a group have around it is one
    symbol of the string, the group's own. Suffixes that start with that symbol stand for all windows that start inside it:
    how far neighbours agree after the anchor tells which of these are repeated.
    """
    segments, text, owner, starts = [], [], [], []
    masks: dict[int, np.ndarray] = {}
    none = lambda: np.zeros(REACH + 1, bool)
    for g, own in enumerate(groups):
        for x in own:
            if len(x[0]) > 1 or x[0][0][0] > 1:
                masks[len(segments)] = mask = none()
                mask[max(0, WINDOW - len(x[2]) + x[1]) : x[1] + 1] = True
            starts.append(len(text))
            if len(own) > 1:
                if x is own[0]:
                    rights = [segment[left + GRAM :] for _, left, segment in own]
                    lefts = [segment[:left][::-1] for _, left, segment in own]
                    after, before = GRAM + _common(min(rights), max(rights)), _common(min(lefts), max(lefts))
                _, left, segment = x
                text += segment[: left - before]
                text.append(256 + g)
                text += segment[left + after :]
                text.append(-1)  # before all bytes, so that a segment that ends is next to those that go on from there
                fit = max(0, min(len(segment) - WINDOW, left - before - 1) + 1)
                owner += [len(segments)] * fit + [-1] * (left - before - fit) + [len(segments)] + [-1] * (len(segment) - left - after + 1)
            segments.append((*x, before if len(own) > 1 else 0, g))

    def mark(run: list[tuple[int, int]]) -> None:
        places = {(*segments[j][0][0][1:3], segments[j][0][0][3] - segments[j][1] + at) for j, at in run}
        if len(places) > 1 or any(len(segments[j][0]) > 1 or segments[j][0][0][0] > 1 for j, _ in run):
            for j, at in run:
                if len(run) > 1:
                    masks.setdefault(j, none())[segments[j][1] - at] = True

    def mark_around(i: int, j: int) -> None:
        """Neighbours that start with their group's symbol: windows that start inside it, as far as their right sides agree."""
        (xi, li, si, before, _), (xj, lj, sj, *_) = segments[i], segments[j]
        if xi[0][1:] != xj[0][1:] or len(xi) > 1 or len(xj) > 1:
            least = REACH - _common(si[li + GRAM :], sj[lj + GRAM :])
            for k in (i, j):
                masks.setdefault(k, none())[max(0, least) : before + 1] = True

    run: list[tuple[int, int]] = []
    window, inner = b"", -1
    for p in suffix_array(text):
        if (j := owner[p]) < 0:
            continue
        if text[p] > 255:
            if inner >= 0 and segments[inner][4] == segments[j][4]:
                mark_around(inner, j)
            inner = j
            continue
        at = p - starts[j]
        last, window = window, segments[j][2][at : at + WINDOW]
        if run and window != last:
            mark(run)
            run = []
        run.append((j, at))
    mark(run)
    return [(*x[1:], bits) for j, mask in masks.items() if mask.any() for bits in (seeds.packed(mask),) for x in segments[j][0] if x[0] == 1]


HITS = "did long, uid long, pos int, windows binary"


def _batch(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    cols = list(zip(*out, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["did", "uid", "pos", "windows"])


def _sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments come by anchor. They are narrowed, then several anchors share a suffix array, in which one place can be met by several anchors."""
    held: list[list[tuple]] = []
    group: list[tuple] = []
    out: list[tuple] = []
    size, last = 0, (None, None)

    def close() -> None:
        nonlocal size
        if rest := narrowed(group):
            held.append(rest)
            size += sum(len(x[2]) for x in rest)
        group.clear()
        if size >= ARRAY_BYTES:
            sort()

    def sort() -> None:
        nonlocal size
        out.extend(repeats(held))
        held.clear()
        size = 0

    for b in batches:
        for x in zip(*(b.column(c).to_pylist() for c in ("anchor", "digest", "n", "did", "uid", "pos", "segment")), strict=True):
            if x[0] != last[0]:
                close()
            if x[:2] != last:  # else a repeated row has brought a context again
                group.append(x[2:])
            last = x[:2]
        if len(out) > 4096:
            yield _batch(out)
            out.clear()
    close()
    sort()
    yield _batch(out)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 64):
        out = []
        for n, did, uid, pos, segment in zip(*(b.column(c).to_pylist() for c in ("n", "did", "uid", "pos", "segment")), strict=True):
            left = min(pos, REACH)
            out += [(n, did, uid, pos, before, xxhash.xxh3_128_digest(segment[left - before : left - before + WINDOW])) for before in range(left + 1) if left - before + WINDOW <= len(segment)]
        types = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]
        cols = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["n", "did", "uid", "pos", "before", "content"])


def _hot(found: DataFrame) -> DataFrame:
    """Anchors with many contexts: each window that another place holds too, by its hash."""
    rows = found.select("anchor", "n", "did", "uid", "pos", "segment")
    rows = rows.mapInArrow(_windows, "n long, did long, uid long, pos int, before int, content binary")
    place = F.struct("did", "uid", (F.col("pos") - F.col("before")).alias("start"))
    again = rows.groupBy("content").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.max("n").alias("most")).filter("lo != hi OR most > 1").select("content")
    return rows.join(again, "content", "left_semi").select("did", "uid", "pos", seeds.one_window(UNIT, F.col("before")).alias("windows"))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 128):
        size, removed, spans, sha = [], [], [], []
        for t, hits in zip(texts(b.column("text")), b.column("hits").to_pylist(), strict=True):
            starts, ends = seeds.covers(hits or [], UNIT, len(t))
            kept, at = hashlib.sha256(), 0
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                kept.update(t[at:s])
                at = e
            kept.update(t[at:])
            size.append(len(t))
            removed.append(int((ends - starts).sum()))
            spans.append(len(starts))
            sha.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def marked(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, did, uid, text and hits: which windows of a document also start elsewhere."""
    rows = seeds.documents(docs)
    places, contexts = seeds.repeated(rows, UNIT, scratch)
    found = scratch.save(seeds.segments(rows, contexts.filter("contexts > 1 AND least_n = 1"), UNIT))
    cold = found.filter("NOT hot").repartition("anchor").sortWithinPartitions("anchor", "digest")
    single = scratch.save(cold.mapInArrow(_sort_suffixes, HITS).unionByName(_hot(found.filter("hot"))))
    copied = contexts.filter("n > 1").select("anchor", "digest")
    every = places.join(copied, ["anchor", "digest"], "left_semi").select("did", "uid", "pos", F.lit(seeds.all_windows(UNIT)).alias("windows"))
    return seeds.with_hits(rows, single.unionByName(every))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = marked(docs, Scratch(docs.sparkSession)).select("doc_id", "text", "hits")
    return rows.mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
