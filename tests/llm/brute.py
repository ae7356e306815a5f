"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def words(t: str | None) -> list[bytes]:
    return (t or "").encode().split()


def exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[SPACE.sub(b" ", (t or "").encode())].append(i)
    out = []
    for i, t in docs:
        own = groups[SPACE.sub(b" ", (t or "").encode())]
        keep = min((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, sha(SPACE.sub(b" ", (t or "").encode()))))
    return out


def shingles(t):
    w = (t or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def near(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and docs[i][0] is not None and docs[j][0] is not None and 100 * len(a & b) >= 75 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i in range(len(docs)):
        least[find(i)].append(docs[i][0])
    return [(d, len(s), c := (min(x for x in least[find(i)]) if len(least[find(i)]) > 1 else d), d == c) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def suffix(docs, window=200):
    at = defaultdict(set)
    for k, (_, t) in enumerate(docs):
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            at[b[i : i + window]].add((k, i))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if len(at[b[i : i + window]]) > 1:
                gone[i : i + window] = b"\x01" * window
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def substring(docs, window=20):
    first = {}
    order = sorted(range(len(docs)), key=lambda k: docs[k][0] if docs[k][0] is not None else -1)
    for k in order:
        w = words(docs[k][1])
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (k, i))
    out = []
    for k, (d, t) in enumerate(docs):
        w = words(t)
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (k, i):
                gone[i : i + window] = b"\x01" * window
        out.append((d, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def pieces(word: bytes, vocabulary: set[bytes]) -> int:
    """Greedy longest match; 1 for what can't be spelt."""
    n, at = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n
