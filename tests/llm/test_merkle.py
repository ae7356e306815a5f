"""The manifest against a plain tree; places against row numbers."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quillstone.llm import merkle
from quillstone.llm.common import Scratch
from quillstone.llm.placing import placed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, path int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 8 * 8
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 8])))
        i //= 8
    return out


def plain(rows):
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {k: tree(list(map(leaf, g))) for k, g in groups.items()}
    top = tree([trees[k][-1][0] for k in langs])
    out = []
    for j, k in enumerate(langs):
        for i, r in enumerate(groups[k]):
            steps = path(trees[k], i) + path(top, j)
            node = leaf((r[0], low(r[1]), *r[2:])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf(r)
            for a, b in steps:
                node = sha(a + node + b)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), node, node == top[-1][0]))
    return out


def compared(spark, rows):
    docs = spark.createDataFrame([(*r, "other", 0) for r in rows], SCHEMA)
    assert sorted(map(str, map(tuple, merkle.manifest(docs).collect()))) == sorted(map(str, plain(rows)))


ODD = [(None, "A", "en", "x", None)] * 2 + [(5, "A", "en", "x", None)] * 3 + [(6, None, None, None, None), (7, "", "", "", 0), (8, "Long É " * 50000, "en", "s", 1)]


def test_like_a_plain_tree(spark):
    langs = [None, "en", "de", "é", "fr"]
    compared(spark, ODD + [(i, f"Tex{i}T" if i % 5 else None, langs[i % 5] if i % 2 else "en", None if i % 7 == 0 else "s", i) for i in range(1, 90)])


def test_one_row_and_none(spark):
    compared(spark, [(1, "x", "en", "s", 3)])
    compared(spark, [])


@pytest.mark.parametrize("langs", [1, 150])
def test_several_rounds_of_blocks(spark, monkeypatch, langs):
    """Blocks of two levels, so that rows, and languages, need more than one round."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 64)
    compared(spark, [(i, f"Tex{i}T", f"l{i % langs}" if i % 3 else "en", "s", i) for i in range(1200)])


def test_places(spark):
    rows = [(g, x, i) for i, (g, x) in enumerate([(None, 3), ("a", 1), ("a", None), ("b", 2)] * 200 + [("a", 7)] * 500)]
    scratch = Scratch(spark)
    saved = scratch.save(spark.createDataFrame(rows, "g string, x long, i long"))
    order = [F.col("x").desc(), F.col("i")]
    got = {r["i"]: (r["pos"], r["of"]) for r in placed(scratch, saved, ["g"], order).collect()}
    for g in (None, "a", "b"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [got[r[2]] for r in own] == [(k, len(own)) for k in range(len(own))]
    every = [r["pos"] for r in placed(scratch, saved, [], order).collect()]
    assert sorted(every) == list(range(len(rows)))
