"""Importance resampling against a plain version."""

import collections
import hashlib
import math
import re
import zlib

import pytest

from quillstone.llm import importance

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n):
    w = WORD.findall((text or "").encode().lower())
    return w, [b" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, n, buckets, percent=10, least=20):
    rows = [(i, *features(t, n)) for i, t in docs]
    counted = lambda fs: collections.Counter(zlib.crc32(f) % buckets for x in fs for f in x)
    s, t = counted(r[2] for r in rows), counted(features(x, n)[1] for x in target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, w, f in rows:
        weight = sum(gain[zlib.crc32(x) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    drawn = percent * len(fit) // 100
    return [(*r[:4], None) for r in out if r[4] < least] + [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(fit)]


ODD = [(None, None), (None, "Aa bB"), (7, "É é x\x00y_z " * 9), (7, "É é x\x00y_z " * 9), (8, ""), (9, "long " * 40000), (10, "w" * 100)]


def compared(spark, docs, target, n, buckets, **more):
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, weight string, score long")
    got = importance.resample(rows, spark.createDataFrame([(t,) for t in target], "text string"), n, buckets, **more)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(docs, target, n, buckets, **({"percent": more["percent"]} if more else {}))))


@pytest.mark.parametrize("n, buckets, percent", [(1, 10_000, 10), (3, 500, 40)])
def test_like_the_plain_version(spark, n, buckets, percent):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    compared(spark, docs + ODD, [*target, None], n, buckets, percent=percent)


def test_empty_tables(spark):
    compared(spark, [], ["a b"], 1, 50)
    compared(spark, ODD, [], 2, 50)


def test_parts_of_a_long_text_count_as_the_whole():
    text = ("Ab cd, e f g " * 50 + "x" * 90 + " y z É").encode()
    form = lambda found: (found[0][0], dict(zip(found[0][1].tolist(), found[0][2].tolist(), strict=True)))
    assert form(importance.Counter(3, 997).of([text])) == form(importance.Counter(3, 997).of([text], part_chars=40, call_chars=100))
