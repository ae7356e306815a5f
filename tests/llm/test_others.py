"""Sharding, mixing, toxicity, nearest neighbours and the pipeline."""

import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import ann, mixing, queries, sharding, toxicity
from quillstone.llm.common import Scratch
from tests.llm import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, _key string, h string, weight double"


def frame(spark, rows, parts=3):
    """rows: (doc_id, text, source); other columns clash with the operators' own names."""
    return spark.createDataFrame([(d, t, None, s, None, 5, 6, "k", "h", None) for d, t, s in rows], DOCS).repartition(parts)


def oracle(name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con.execute(queries.ORACLES[name])


def same(df, cursor):
    columns = sorted(df.columns)
    want = [dict(zip([d[0] for d in cursor.description], r, strict=True)) for r in cursor.fetchall()]
    key = lambda rows: sorted(str([round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns]) for r in rows)
    return key([r.asDict() for r in df.collect()]) == key(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_like_sql(spark, name):
    assert same(queries.QUERIES[name](spark, SF), oracle(name))


# Sharding


def sharded(spark, rows, shards=24):
    out = [r.asDict() for r in sharding.shard_documents(frame(spark, rows), shards).collect()]
    assert Counter((r["doc_id"], r["text_crc32"]) for r in out) == Counter((d, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    slots = defaultdict(list)
    for r in out:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return out


def test_shards_hold_near_equal_bytes(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 300), "s") for i in range(6000)] + [(9000 + i, "copy " * 20, "s") for i in range(3000)] + [(None, None, None)] * 3
    out = sharded(spark, rows)
    size = Counter()
    for r in out:
        size[r["shard"]] += r["size"]
    mean = sum(size.values()) / 24
    assert max(abs(size[s] - mean) for s in range(24)) <= 2 * (0.002 * mean + 308)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a", "s"), (1, "a", "s"), (2, "a", "s")], [(i, "t", "s") for i in range(30)]])
def test_shards_of_few_rows(spark, rows):
    sharded(spark, rows)


# Mixing


def test_mixture_keeps_every_document_and_respects_the_limit(spark):
    rows = [(i, "w " * 30, "big") for i in range(300)] + [(400 + i, "w " * 10, f"s{i % 5}") for i in range(50)] + [(None, None, None), (900, "", "empty"), (901, "x", None)]
    out = mixing.plan(frame(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(d for d, *_ in rows)
    assert all(r["copies"] >= 1 for r in out if r["tokens"])
    used, own = Counter(), Counter()
    for r in out:
        used[r["source_key"]] += r["copies"] * r["tokens"]
        own[r["source_key"]] += r["tokens"]
    repeats = {s: used[s] / own[s] for s in own if own[s]}
    assert max(repeats.values()) / min(repeats.values()) <= mixing.REPEAT_LIMIT + 0.35  # whole documents, not parts
    mixed = mixing.mixed_documents(frame(spark, rows))
    assert mixed.columns == frame(spark, rows).columns
    assert mixed.count() == sum(r["copies"] for r in out)


def test_repeated_rows_keep_to_the_budget(spark):
    """One document thirty times in a source whose budget ends among its rows; elsewhere ids and texts repeat over sources."""
    rows = [(1, "w " * 10, "small")] * 30 + [(1, "w " * 10, "other")] * 2 + [(i, "w " * 40, "big") for i in range(10, 60)]
    out = mixing.plan(frame(spark, rows), budget=2500).collect()
    assert len({r["copies"] for r in out if r["source_key"] == "s:small"}) == 2
    planned = Counter()
    for r in out:
        planned[r["doc_id"], r["source_key"]] += r["copies"]
    mixed = Counter((r["doc_id"], f"s:{r['source']}") for r in mixing.mixed_documents(frame(spark, rows), budget=2500).collect())
    assert mixed == planned


@pytest.mark.parametrize("rows", [[], [(1, "a b", "s")], [(1, None, None)], [(1, "a", "x"), (2, "b", "y")]])
def test_mixture_of_little(spark, rows):
    assert sorted(r["copies"] for r in mixing.plan(frame(spark, rows)).collect()) == [1] * len(rows)


def test_entropy_target(spark):
    shares = spark.createDataFrame([("a", 0.9), ("b", 0.07), ("c", 0.03)], "source_key string, p double")
    k = mixing.exponent(shares, 0.8, 100.0)

    def entropy(a):
        w = np.array([0.9, 0.07, 0.03]) ** a
        w /= w.sum()
        return -(w * np.log(w)).sum()

    assert entropy(k / mixing.STEPS) >= 0.8 * np.log(3) > entropy((k + 1) / mixing.STEPS)


# Toxicity


def test_held_out_ranking(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    pos, neg = ([r["score"] for r in out if r["toxic"] == y] for y in (1, 0))
    auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
    caught = np.mean([r["predicted"] for r in out if r["toxic"] == 1])
    wrong = np.mean([r["predicted"] for r in out if r["toxic"] == 0])
    assert auc > 0.95 and caught > 0.8 and wrong < 0.02, (auc, caught, wrong)


def test_scores_without_usable_labels(spark):
    docs = frame(spark, [(1, None, "s"), (2, "", "s"), (None, "a b", None), (2, "", "s")])
    for labels, score in (([], 0.0), ([(1, 0, 0), (2, 1, None), (None, 1, 1), (77, 1, 1)], 0.0)):
        own = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        out = toxicity.toxicity(docs, own).collect()
        assert len(out) == 4 and all(r["score"] == score and r["predicted"] == 0 for r in out)
        assert toxicity.clean(docs, own).columns == docs.columns
    assert toxicity.toxicity(docs.limit(0), own).count() == 0


def test_held_out_rule(spark):
    ids = [0, 1, 17, 123456789, 2**40]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select("i", toxicity.held_out(F.col("i")).alias("h")).collect()
    assert {r["i"]: r["h"] for r in got} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in ids}


# Nearest neighbours

VECS = "vec_id long, embedding array<float>, rank int, query_id long, h long, v string, node long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, None, None, None, None) for i, v in rows], VECS).repartition(3)


def exact_nearest(rows, every, k=20):
    ok = [(n, i, np.array(v, np.float32).astype(float)) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, i, v in ok:
        if i % every == 0:
            found = sorted((-float(v @ w), j) for m, j, w in ok if m != n)
            out.setdefault(i, []).append([j for _, j in found[:k]])
    return out


def recall(spark, rows, every):
    got = ann.nearest(vectors(spark, rows), lambda i: i % every == 0).collect()
    want = exact_nearest(rows, every)
    lists = defaultdict(list)
    by_id = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and None not in v}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        lists[r["query_id"]].append(r["vec_id"])
        assert abs(r["score"] - by_id[r["query_id"]] @ by_id[r["vec_id"]]) < 1e-9
    assert set(lists) == {q for q, w in want.items() if w[0]}
    assert all(len(lists[q]) == len(w[0]) for q, w in want.items())
    return np.mean([len(set(lists[q]) & set(w[0])) / len(w[0]) for q, w in want.items() if w[0]])


def test_recall_on_the_tables(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    assert recall(spark, rows, 20) >= 0.95


def test_recall_without_structure_and_with_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((1500, 16)))]
    rows += [(2000 + i, [1.0] * 16) for i in range(300)]
    assert recall(spark, rows, 20) >= 0.9


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_on_larger_tables(spark, clusters):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((12_000, 64)) + (3 * rng.standard_normal((clusters, 64))[rng.integers(0, clusters, 12_000)] if clusters else 0)
    rows = [(i, x.tolist()) for i, x in enumerate((v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).astype(float))]
    got = ann.nearest(vectors(spark, rows), lambda i: i % 20 == 0).select("query_id", "vec_id").collect()
    m = np.array([x for _, x in rows])
    scores = m[::20] @ m.T
    scores[np.arange(len(scores)), np.arange(0, len(m), 20)] = -np.inf
    want = {20 * q: set(np.argpartition(-s, 19)[:20].tolist()) for q, s in enumerate(scores)}
    assert sum(r["vec_id"] in want[r["query_id"]] for r in got) / (20 * len(want)) >= 0.9


def test_beams_widen_until_recall_is_met(spark, monkeypatch):
    """Narrow beams miss much of what is near in vectors without structure; they are widened until a sample's nearest are held."""
    monkeypatch.setattr(ann, "BEAM", 21)
    monkeypatch.setattr(ann, "LEAF", 128)  # larger leaves find so much at this size that no beam has to widen
    beams, search = [], ann.search
    monkeypatch.setattr(ann, "search", lambda *a: beams.append(a[5]) or search(*a))
    v = np.random.default_rng(8).standard_normal((4000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert recall(spark, list(enumerate(v.astype(np.float32).astype(float).tolist())), 40) >= 0.9
    assert beams[0] == 21 and len(beams) > 1 and all(b == 2 * a for a, b in zip(beams, beams[1:]))


def test_vectors_of_unequal_length(spark):
    rows = [(i, [1.0, float(i), 2.0]) for i in range(30)] + [(40, [1.0, 2.0]), (60, [1.0] * 5), (61, [2.0, 1.0])]
    got = ann.nearest(vectors(spark, rows), lambda i: i % 20 == 0).collect()
    assert {r["query_id"] for r in got} == {0, 20} and {r["vec_id"] for r in got} <= set(range(30)) and len(got) == 40


def test_search_goes_on_until_beams_settle(spark):
    """A chain of nodes, each better than the one before: the best is twelve hops away."""
    nodes = spark.createDataFrame([(i, [i + 1.0]) for i in range(13)], "id long, v array<double>")
    edges = spark.createDataFrame([(i, i + 1, (i + 1.0) * (i + 2.0)) for i in range(12)], "src long, dst long, score double")
    entries = spark.createDataFrame([(0, 0, 1.0)], "query long, node long, score double")
    found = ann.search(nodes.filter("id = 0"), entries, edges, nodes, Scratch(spark))
    assert sorted(r["node"] for r in found.collect()) == list(range(13))


def test_search_keeps_one_row_for_each_query(spark):
    """Beams are arrays, so rows don't grow with pairs; a wider search goes on from the beams of a narrower one."""
    nodes = spark.createDataFrame([(i, [i + 1.0]) for i in range(13)], "id long, v array<double>")
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    asked = nodes.filter("id < 2")
    entries = spark.createDataFrame([(0, 0, 1.0), (1, 1, 4.0)], "query long, node long, score double")
    scratch = Scratch(spark)
    best = ann.search(asked, ann.state(asked, entries), edges, nodes, scratch, 2)
    wider = ann.search(asked, best, edges, nodes, scratch, 7)
    for found in (best, wider):
        got = {r["query"]: (r["nodes"], r["scores"]) for r in found.collect()}
        assert found.count() == 2 and got == {q: ([12, 11, 10, 9], [(q + 1.0) * x for x in (13, 12, 11, 10)]) for q in (0, 1)}


def test_hops_leave_lists_and_vectors_where_they_are(spark, monkeypatch):
    """A hop reads the nodes' lists by bucket: queries are shuffled, the table is not."""
    nodes = spark.createDataFrame([(i, [i + 1.0]) for i in range(40)], "id long, v array<double>")
    edges = spark.createDataFrame([(i, i + 1) for i in range(39)], "src long, dst long")
    plans, save = [], Scratch.save

    def watched(self, df):
        out = save(self, df)
        if "open" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(Scratch, "save", watched)
    found = ann.search(nodes.filter("id < 2"), spark.createDataFrame([(0, 0, 1.0), (1, 1, 4.0)], "query long, node long, score double"), edges, nodes, Scratch(spark), 3)
    assert {r["node"] for r in found.collect()} == set(range(34, 40))
    hops = [p for p in plans if "products" in p]
    assert len(hops) > 10 and all("Bucketed: true" in p for p in hops)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("ways_")]


def test_narrow_search_ends_early_for_a_wider_one(spark, monkeypatch):
    """A search whose beams won't do is left before its last hops, and the wider one goes on to where it would have come to anyway."""
    monkeypatch.setattr(ann, "FEW", 1.0)
    nodes = spark.createDataFrame([(i, [i + 1.0]) for i in range(13)], "id long, v array<double>")
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    asked, scratch, seen = nodes.filter("id = 0"), Scratch(spark), []
    best = ann.search(asked, ann.state(asked, spark.createDataFrame([(0, 0, 1.0)], "query long, node long, score double")), edges, nodes, scratch, 2, lambda s: bool(seen.append(s.count())))
    assert seen == [1] and best.first()["nodes"] == [1, 0]
    assert ann.search(asked, best, edges, nodes, scratch, 3).first()["nodes"] == [12, 11, 10, 9, 8, 7]


def test_larger_tables_start_with_wider_beams(spark, monkeypatch):
    monkeypatch.setattr(ann, "BEAM", 21)
    monkeypatch.setattr(ann, "BEAM_NODES", 200)
    beams, search = [], ann.search
    monkeypatch.setattr(ann, "search", lambda *a: beams.append(a[5]) or search(*a))
    v = np.random.default_rng(5).standard_normal((800, 8)).astype(np.float32).astype(float)
    assert recall(spark, list(enumerate(v.tolist())), 20) >= 0.95 and beams[0] == 42


def test_long_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(ann, "PIECE", 100)
    v = np.random.default_rng(6).standard_normal((700, 8)).astype(np.float32).astype(float)
    assert recall(spark, list(enumerate(v.tolist())), 20) >= 0.95


def test_doubles_stay_doubles(spark):
    """Vectors that are equal as floats are still told apart where the table has doubles."""
    rows = [(i, [1.0 + i * 1e-12, 1.0]) for i in range(60)] + [(60, [1e60, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 40, k=5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [60, 59, 58, 57, 56]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (20, [0.0, 0.0]), (40, [float("nan"), 1.0]), (60, [float("inf"), 1.0]), (80, [None, 1.0]), (100, []), (None, [1.0, 1.0]), (120, [-1.0, 0.0])]
    assert recall(spark, rows, 20) == 1.0
    got = ann.nearest(vectors(spark, rows), lambda i: i % 20 == 0).filter("query_id = 0").orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 2), (3, 120)]
    assert ann.nearest(vectors(spark, []), lambda i: i % 20 == 0).count() == 0
    assert ann.nearest(vectors(spark, rows[:1]), lambda i: i % 20 == 0).count() == 0


# Pipeline


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        before = docs.collect()
        if at < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            out = spark.read.parquet(str(tmp_path / name))
        pairs = sorted((r["doc_id"], r["text"]) for r in before)
        got = sorted(r["doc_id"] for r in out.select("doc_id").collect())
        if name == "toxicity":
            score = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
            assert got == sorted(d for d, p in score.items() if not p)
        elif name == "exact_dedup":
            assert got == sorted(d for d, *_, k, _ in brute.exact(pairs) if k)
        elif name == "near_dedup":
            assert got == sorted(d for d, _, _, k in brute.near(pairs) if k)
        elif name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in mixing.plan(docs).collect()}
            assert Counter(got) == copies and set(got) == {r["doc_id"] for r in before}
        else:
            assert got == sorted(r["doc_id"] for r in before)
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_stages_on_odd_rows(spark):
    """Nulls everywhere, empty and long texts, repeated rows, columns that clash with the operators' own, an empty table."""
    extra = ["_id", "_key", "_copies", "_pass", "_score", "score", "row", "use", "_features", "_p", "_probability", "key", "text_key", "cid", "sig", "label"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    rows = [(1, None, None, None, None), (None, "a b", None, "s", 3), (2, "", "en", "s", 0), (3, "long " * 40_000, "en", "s", 9), (4, "x y", "en", None, 3), (4, "x y", "en", None, 3)]
    docs = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    for own in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, own, SF)
            got = out.collect()
            if name != "byte_bpe":
                assert out.columns == docs.columns
                assert all(tuple(r)[5:] == tuple(extra) for r in got)
            assert (len(got) > 0) == (own is docs)
