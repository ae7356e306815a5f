"""The joins of names against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillstone.functions.udfs import similarity
from quillstone.operators import matching, names

FIXED = ["", None, "a", "b", "ab", "ba", "abc", "abcd", "aaaa", "aaaaa", "한글 이름", "한글이름", "x" * 40, "x" * 36 + "yyyy"]


def words(seed, n):
    """Random names and misspelt copies of them, of all lengths, with letters that repeat."""
    r = random.Random(seed)
    own = ["".join(r.choice("abcde-") for _ in range(r.choice([1, 2, 3, 4, 5, 7, 9, 14, 25]))) for _ in range(n)]
    for x in list(own[: n // 2]):
        y = list(x)
        for _ in range(r.randrange(1, 4)):
            at = r.randrange(len(y) + 1)
            y[at : at + r.randrange(2)] = r.choice(["", "q", "a", "cd"])
        own.append("".join(y))
    return own + FIXED


@pytest.fixture(scope="module")
def sides(spark):
    left, right = words(1, 60), words(1, 40) + words(2, 30)
    return left, right, spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string")


@pytest.mark.parametrize("floor, split", [(0.75, 2000), (0.8, 2000), (0.8, 3), (0.9, 2000)])
@pytest.mark.parametrize("ratio", [similarity, matching.levenshtein_ratio])
def test_alike_misses_none(sides, monkeypatch, floor, ratio, split):
    monkeypatch.setattr(names, "SPLIT", split)
    _, _, a, b = sides
    got = sorted((r["a"], r["b"], round(r["score"], 6)) for r in names.alike(a, b, floor, ratio).collect())
    every = a.distinct().crossJoin(b.distinct()).filter((F.length("a") > 0) & (F.length("b") > 0)).withColumn("score", ratio(F.col("a"), F.col("b"))).filter(F.col("score") >= floor)
    assert got == sorted((r["a"], r["b"], round(r["score"], 6)) for r in every.collect()) and len(got) > 30


def test_a_floor_without_a_common_pair_is_refused(sides):
    with pytest.raises(ValueError, match="no pair"):
        names.alike(*sides[2:], 0.6, similarity)


@pytest.mark.parametrize("split", [2000, 2])
def test_containing_like_all_pairs(sides, monkeypatch, split):
    monkeypatch.setattr(names, "SPLIT", split)
    left, right, a, b = sides
    got = [tuple(r) for r in names.containing(a, b).collect()]
    assert sorted(got) == sorted({(x, y) for x in left for y in right if x and y and x in y})


def test_joins_compare_no_extension_with_all_of_its_names(sides):
    plan = names.alike(*sides[2:], 0.8, matching.levenshtein_ratio)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def plain_best(file, listed):
    """The rules for one file, name by name, with the matching-blocks ratio."""
    key = lambda n: n.rsplit(".", 1)[0].replace(" ", "").replace("(", "").replace(")", "").replace("-", "").lower()
    bare = lambda n: key(n.replace(" (2)", ""))
    best = (None, 0.0, "none")
    for name in listed:
        if name.rsplit(".", 1)[1] != file.rsplit(".", 1)[1] or not key(name) or not key(file):
            continue
        if key(name) == key(file):
            return name, 1.0, "exact"
        if bare(file) == key(name) or key(file) == bare(name):
            found = (name, 0.99, "copy_suffix")
        elif key(file) in key(name) or key(name) in key(file):
            found = (name, 0.95, "contains")
        else:
            found = (name, SequenceMatcher(None, key(file), key(name)).ratio(), "similarity")
        best = found if found[1] > best[1] else best
    return best


@pytest.mark.parametrize("below", [True, False])
def test_best_match_like_one_by_one(spark, below):
    files = [f"{x}{s}.{e}" for x in words(5, 25)[:30] if x for s, e in (("", "pdf"), (" (2)", "pdf"), ("", "hwp"))]
    listed = [f"{x}.{'hwp' if i % 4 == 0 else 'pdf'}" for i, x in enumerate(dict.fromkeys(y for y in words(5, 20) + words(6, 20) if y))]
    got = matching.best_match(spark.createDataFrame([(f,) for f in files], "name string"), spark.createDataFrame([(n, i) for i, n in enumerate(listed)], "name string, ordinal int"), below=below)
    for r in got.collect():
        want = plain_best(r["name"], listed)
        want = want if below or want[1] >= 0.8 else (None, 0.0, "none")
        assert (r["best"], round(r["score"], 9), r["match_type"]) == (want[0], round(want[1], 9), want[2]), r


def test_resolve_like_one_by_one(spark):
    files = [f"{x}.pdf" for x in dict.fromkeys(y for y in words(7, 40) if y)] + ["averylongname of a file.pdf", "same beginning one.pdf", "same beginning two.pdf"]
    asked = [f"{x}.pdf" for x in words(7, 60)[20:] if x] + ["averylongname of.pdf", "same beginning.pdf", "nothing like it.pdf"]
    key = lambda n: n[:-4].replace(" ", "").replace("-", "").lower()
    got = {r["name"]: (r["resolved"], r["how"]) for r in matching.resolve(spark.createDataFrame([(x,) for x in asked], "name string"), spark.createDataFrame([(x,) for x in files], "name string")).collect()}
    for name in asked:
        equal = [f for f in files if key(f) == key(name)]
        longer = [f for f in files if len(key(name)) >= 12 and key(f).startswith(key(name))]
        ranked = sorted(((SequenceMatcher(None, key(name), key(f)).ratio(), f) for f in files), reverse=True)
        if equal:
            want = (min(equal), "equal")
        elif len(longer) == 1:
            want = (longer[0], "prefix")
        elif ranked[0][0] >= 0.8 and ranked[0][0] - ranked[1][0] >= 0.05:
            want = (ranked[0][1], "similar")
        else:
            want = (name, "unchanged")
        assert got[name] == want, name
