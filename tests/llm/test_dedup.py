"""Exact dedup, near dedup, suffix-array and substring dedup against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import exact_dedup, near_dup, seeds, substring_dedup, suffix_dedup
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, cid string, rank int"


def frame(spark, docs, parts=3):
    """Documents with nulls elsewhere and columns whose names operators use themselves."""
    return spark.createDataFrame([(d, t, None, None, None, None, None, 7) for d, t in docs], SCHEMA).repartition(parts)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def corpus(seed, n=60, vocabulary=40):
    """Texts that share passages, copies with other spacing, near copies, long, short, empty and null ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    lexicon = [word() for _ in range(vocabulary)] + ["THE", "The", "a, b", "x" * 60]
    text = lambda k: " ".join(rng.choice(lexicon) for _ in range(k))
    shared = [text(rng.randint(20, 90)) for _ in range(5)]
    docs = [(0, ""), (1, None), (2, " \t\n "), (3, "one"), (4, "one two three"), (5, "ONE two\tthree")]
    for i in range(6, n):
        kind = rng.randrange(6)
        if kind == 0 and len(docs) > 8:
            t = rng.choice(docs[6:])[1]
            docs.append((i, t if rng.random() < 0.5 else t.replace(" ", "  ", 2)))
        elif kind == 1 and len(docs) > 8:
            w = rng.choice(docs[6:])[1].split(" ")
            w[rng.randrange(len(w))] = word()
            docs.append((i, " ".join(w)))
        elif kind == 2:
            docs.append((i, text(rng.randint(1, 30)) + "\n" + rng.choice(shared) + " " + text(rng.randint(0, 30)) + " " + rng.choice(shared)))
        elif kind == 3:
            docs.append((i, "ab" * rng.randint(50, 400)))
        else:
            docs.append((i, text(rng.randint(1, 120))))
    docs.append((n, " ".join([text(40), shared[0]] * 12)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_exact(spark, seed):
    docs = corpus(seed) + [(900, "r"), (900, "r"), (None, "n"), (None, "n")]
    got = rows(exact_dedup.exact_dedup(frame(spark, docs), capacity=400), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(brute_exact(docs), key=str)


def brute_exact(docs):
    return brute.exact(docs)


def test_exact_kept_keeps_columns(spark):
    docs = corpus(3)
    out = exact_dedup.kept(frame(spark, docs))
    assert out.columns == frame(spark, docs).columns
    assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(d for d, *_, k, _ in brute.exact(docs) if k)


@pytest.mark.parametrize("seed", [1, 2])
def test_near(spark, seed):
    docs = corpus(seed, 90)
    got = rows(near_dup.near_dup(frame(spark, docs)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near(docs), key=str)


def test_near_branches_below_large_nodes(spark, monkeypatch):
    """Leaves of three classes: most nodes branch several times, and nothing is lost."""
    monkeypatch.setattr(near_dup, "LEAF", 3)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*base[: i % 50], f"v{i}", *base[i % 50 :]])) for i in range(40)]
    got = rows(near_dup.near_dup(frame(spark, docs)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near(docs), key=str)


def family(n, linked, seed=1, places=80, rare=0.23, changed=11):
    """n texts that share almost half of their shingles, and copies of some that share 0.759 with their originals; hardly a shingle is rare."""
    rng = random.Random(seed)
    kinds = [[rng.random() < rare for _ in range(places)] for _ in range(n)]
    for k in kinds[:linked]:
        flipped = set(rng.sample(range(places), changed))
        kinds.append([x != (j in flipped) for j, x in enumerate(k)])
    return [(i, " ".join(f"a{j} b{j} {'v' if x else 'c'}{j} d{j} e{j}" for j, x in enumerate(k))) for i, k in enumerate(kinds)]


def links_of(docs):
    """All links, by comparing everything with everything."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in docs)]
    count = Counter(x for s in sets for x in s)
    columns = {x: i for i, x in enumerate(x for x, c in count.items() if c > 1)}
    has = np.zeros((len(docs), len(columns)), np.float32)
    for i, s in enumerate(sets):
        has[i, [columns[x] for x in s if x in columns]] = 1
    size = np.array([len(s) for s in sets])
    both = has @ has.T
    return [(int(a), int(b)) for a, b in np.argwhere(both >= 0.75 * (size[:, None] + size[None, :] - both)) if a < b]


def near_recall(spark, docs):
    label = dict(near_dup.near_dup(frame(spark, docs)).select("doc_id", "component_id").collect())
    true = links_of(docs)
    return sum(label[a] == label[b] for a, b in true) / len(true)


def test_near_recall_in_a_dense_family(spark, monkeypatch):
    """Nodes are large for many levels, as those of far larger families are at LEAF = 256; links at the threshold are found all the same."""
    monkeypatch.setattr(near_dup, "LEAF", 4)
    assert near_recall(spark, family(800, 200)) >= 0.97


def test_near_nodes_that_stay_large_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LEAF", 8)
    monkeypatch.setattr(near_dup, "MAX_LEVELS", 2)
    assert near_recall(spark, family(150, 60)) == 1


def test_near_boilerplate_family(spark, monkeypatch):
    """240 texts that share most of their shingles without being linked, 120 of them with a planted copy near the threshold."""
    monkeypatch.setattr(near_dup, "LEAF", 16)
    rng = random.Random(4)
    core = [f"c{i}" for i in range(800)]
    own = [[f"t{k}x{i}" for i in range(165)] for k in range(240)]
    docs = [(k, " ".join([*core, *own[k]])) for k in range(240)]
    for k in range(120):
        other = list(own[k])
        at = rng.randrange(len(other) - 130)
        other[at : at + 130] = [f"u{k}x{i}" for i in range(130)]
        docs.append((240 + k, " ".join([*core, *other])))
    assert near_recall(spark, docs) >= 0.97


def test_near_several_levels_at_once(spark):
    """A pass over three levels reaches the nodes that three passes over one level reach, each class once in each."""
    rng = np.random.default_rng(6)
    sigs = spark.createDataFrame([(i, rng.integers(0, 3, near_dup.WIDTH).tolist()) for i in range(40)], "cid long, sig array<int>")
    top = sigs.selectExpr("cid % 4 AS node", "cid", "int(cid % 2) AS tree")
    level = near_dup.LEVELS
    at_once = rows(near_dup._on_paths(near_dup._paths(top, sigs, level, 3)), "at", "node", "cid", "tree")
    want, here = [], top
    for i in range(3):
        here = near_dup._on_paths(near_dup._paths(here, sigs, level + i, 1)).select("node", "cid", "tree")
        want += [(i, *r) for r in here.collect()]
    assert len(at_once) == len(set(at_once)) > 3 * 40
    assert sorted(at_once) == sorted(want)


def test_near_only_below_large_nodes(spark):
    """Of the nodes on a path those stay whose ancestors are all large."""
    of = [(1, 0, None, True), (2, 0, None, False), (3, 1, 1, False), (4, 1, 2, True), (5, 2, 3, True), (6, 2, 4, True), (7, 1, 1, True), (8, 2, 7, False)]
    table = spark.createDataFrame([(9, 0, *r, 0, 5, 5, True) for r in of], "cid long, tree int, node long, at int, above long, large boolean, label long, c long, x long, lead boolean")
    assert sorted(r["node"] for r in near_dup._reached(table, 3).collect()) == [1, 2, 3, 7, 8]


def test_near_survival_by_depth():
    """A pair at the threshold stays together in a tree as often as the docstring says."""
    rng = np.random.default_rng(5)

    def together(depth):
        nodes = int(rng.random() < 0.75)
        for _ in range(depth - 1):
            nodes = int(rng.binomial(nodes + rng.binomial(nodes, 1 / 3), 0.75))
        return nodes > 0

    p = 1.0
    for depth in range(1, near_dup.MAX_LEVELS + 1):
        if depth in (1, 4, near_dup.MAX_LEVELS):
            assert abs(np.mean([together(depth) for _ in range(20_000)]) - 0.75 * p) < 0.015
        assert 1 - (1 - 0.75 * p) ** near_dup.TREES >= 0.99
        p -= 3 / 16 * p * p


def test_near_null_ids_and_repeated_rows(spark):
    docs = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    got = rows(near_dup.near_dup(frame(spark, docs)), "doc_id", "component_id", "kept")
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False)], key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("limit", [512, 2])
def test_suffix(spark, seed, limit, monkeypatch):
    monkeypatch.setattr(seeds, "LIMIT", limit)
    docs = corpus(seed)
    got = rows(suffix_dedup.suffix_dedup(frame(spark, docs)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.suffix(docs), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("limit", [512, 2])
def test_substring(spark, seed, limit, monkeypatch):
    monkeypatch.setattr(seeds, "LIMIT", limit)
    docs = corpus(seed)
    got = rows(substring_dedup.substring_dedup(frame(spark, docs)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.substring(docs), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_of_texts_that_end_near_their_anchors(spark, seed):
    """Many different contexts of the same anchors, whose sides are parts of one another."""
    rng = random.Random(seed)
    core = "".join(rng.choice("abcdefgh") for _ in range(170))
    side = lambda: "".join(rng.choice("ab") for _ in range(3)) * rng.randint(0, 25)
    docs = [(i, side() + core[rng.randint(0, 20) :][: rng.randint(140, 170)] + side()) for i in range(80)]
    got = rows(suffix_dedup.suffix_dedup(frame(spark, docs)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.suffix(docs), key=str) and sum(r[2] for r in got) > 0


def test_suffix_arrays_tell_the_repeats():
    """Contexts of one anchor that agree in part: each window by itself, against a comparison of all pairs."""
    rng = random.Random(9)
    line = lambda n: bytes(rng.choice(b"abcdefghij") for _ in range(n))
    core, left, right = line(suffix_dedup.GRAM), line(110), line(130)
    sides = [(left, right[:40] + b"x" * 20), (left[5:], right[:50]), (line(80) + left[80:], right[:120] + line(9)), (line(100) + left[90:], right), (left[40:], right[:77]), (line(120), right[:20])]
    contexts = [(1, i, 0, len(a), a + core + b) for i, (a, b) in enumerate(sides)]
    found = {h[0]: np.flatnonzero(np.unpackbits(np.frombuffer(h[3], np.uint8))).tolist() for h in suffix_dedup.repeats([suffix_dedup.narrowed(contexts)])}
    want: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(sides):
        for l in range(len(a) + 1):
            if any(i != j and (a[len(a) - l :], b[: suffix_dedup.REACH - l]) == (c[len(c) - l :] if l <= len(c) else None, d[: suffix_dedup.REACH - l]) for j, (c, d) in enumerate(sides)) and len(b) >= suffix_dedup.REACH - l:
                want.setdefault(i, []).append(l)
    assert found == want and want


def test_suffix_array():
    rng = random.Random(5)
    for n in (0, 1, 2, 7, 60, 300):
        for letters in (b"a", b"ab", b"abc", bytes(range(256))):
            t = bytes(rng.choice(letters) for _ in range(n))
            assert suffix_dedup.suffix_array(t) == sorted(range(n), key=lambda i: t[i:])
    fib = b"a"
    prev = b"b"
    while len(fib) < 500:
        fib, prev = fib + prev, fib
    assert suffix_dedup.suffix_array(fib) == sorted(range(len(fib)), key=lambda i: fib[i:])


@pytest.mark.parametrize("f", [exact_dedup.exact_dedup, near_dup.near_dup, suffix_dedup.suffix_dedup, substring_dedup.substring_dedup])
def test_empty_table(spark, f):
    assert f(frame(spark, [], 1)).filter(F.lit(True)).count() == 0
