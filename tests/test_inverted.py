"""The stored index against postings that are built anew, through batches, replays, deletions, compaction and a stream."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import index, inverted, search
from quillstone.plans.search import terms
from quillstone.streaming.ingest import ingest_index

QUERIES = ["red blue", "green green amber", "violet", "grey red red grey", "nothing", "ochre"]


def texts(seed, ids):
    r = random.Random(seed)
    words = ["red", "blue", "green", "amber", "violet", "grey", "teal", "pink"]
    return [(i, " ".join(r.choice(words[: 2 + i % 7]) for _ in range(r.randrange(12))) if i % 11 else None, "de" if i % 3 else "en") for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "point_id long, text string, lang string")


def key(hits):
    return sorted((r["query_id"], r["rank"], r["point_id"], round(r["score"], 5)) for r in hits.collect())


def rebuilt(spark, rows, query_terms, k):
    posting, weights = index.statistics(frame(spark, rows), F.col("text"))
    return key(search.keyword(posting, query_terms, weights, k))


@pytest.fixture(scope="module")
def query_terms(spark):
    return terms(spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, text string"))


@pytest.mark.parametrize("block, first, k", [(4, 1, 3), (16, 2, 10), (1000, 8, 5)])
def test_skipping_loses_nothing(spark, tmp_path, monkeypatch, query_terms, block, first, k):
    monkeypatch.setattr(inverted, "BLOCK", block)
    rows = texts(1, range(200))
    inverted.add(frame(spark, rows), str(tmp_path), locality=("lang",))
    hits, work = inverted.search(inverted.open_index(spark, str(tmp_path)), query_terms, k, first)
    assert key(hits) == rebuilt(spark, rows, query_terms, k)
    total = work.agg(F.sum("entries").alias("all"), F.sum("entries_read").alias("read")).first()
    assert total["read"] <= total["all"] and (block != 4 or total["read"] < total["all"])


def test_batches_that_replace_and_delete(spark, tmp_path, monkeypatch, query_terms):
    monkeypatch.setattr(inverted, "BLOCK", 8)
    path, other = str(tmp_path / "a"), str(tmp_path / "b")
    old, new, third = texts(1, range(80)), texts(2, range(60, 100)), texts(3, range(70, 75))
    inverted.add(frame(spark, old), path)
    inverted.add(frame(spark, new), path, 1)
    inverted.add(frame(spark, third), path, 2, deleted=spark.createDataFrame([(0,), (61,), (999,)], "point_id long"))
    living = {r[0]: r for r in old + new + third if r[0] not in (0, 61)}.values()
    want = rebuilt(spark, list(living), query_terms, 5)
    assert key(inverted.search(inverted.open_index(spark, path), query_terms, 5, 1)[0]) == want
    inverted.add(frame(spark, third), path, 2, deleted=spark.createDataFrame([(0,), (61,), (999,)], "point_id long"))  # once more
    assert key(inverted.search(inverted.open_index(spark, path), query_terms, 5, 1)[0]) == want
    inverted.compact(spark, path, other)
    small = inverted.open_index(spark, other)
    assert not small.several and key(inverted.search(small, query_terms, 5, 1)[0]) == want
    count = lambda i: i.blocks.agg(F.sum("n")).first()[0]
    assert count(small) < count(inverted.open_index(spark, path))
    inverted.add(frame(spark, texts(4, range(90, 95))), other, 1)
    later = {r[0]: r for r in [*living, *texts(4, range(90, 95))]}.values()
    assert key(inverted.search(inverted.open_index(spark, other), query_terms, 5)[0]) == rebuilt(spark, list(later), query_terms, 5)


def test_stream_keeps_the_index(spark, tmp_path, query_terms):
    arrivals, path = tmp_path / "in", str(tmp_path / "index")
    last = {}
    for n, rows in enumerate([texts(1, range(40)), texts(2, range(30, 50)), texts(3, range(35, 37)) + texts(4, range(36, 38))]):
        own = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "point_id long, text string, lang string, ordinal int")
        own.coalesce(1).write.mode("append").parquet(str(arrivals))
        last.update({r[0]: r for r in rows})
        stream = spark.readStream.schema(own.schema).parquet(str(arrivals))
        ingest_index(stream, path, str(tmp_path / "checkpoint"), ("lang",)).awaitTermination()
    assert key(inverted.search(inverted.open_index(spark, path), query_terms, 6)[0]) == rebuilt(spark, list(last.values()), query_terms, 6)


def test_empty_index(spark, tmp_path, query_terms):
    inverted.add(frame(spark, []), str(tmp_path))
    hits, work = inverted.search(inverted.open_index(spark, str(tmp_path)), query_terms, 3)
    assert hits.count() == 0 and work.count() == 0


def test_blocks_are_made_in_one_shuffle(spark):
    """Points go to their block's task with their tokens in lists; tokens aren't shuffled one by one, nor dealt to buckets again."""
    counts = index.counted(frame(spark, texts(1, range(60))).withColumn("block", F.col("point_id") % 4), F.col("text"), "block")
    own = inverted._blocks(counts)
    assert own._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rows = sorted((r["point_id"], i, n) for r in counts.collect() for i, n in zip(r["idxs"], r["tfs"], strict=True))
    assert sorted((p, r["idx"], n) for r in own.collect() for p, n in zip(r["points"], r["tfs"], strict=True)) == rows
    assert all(r["most"] == max(r["tfs"]) and r["n"] == len(r["points"]) and r["points"] == sorted(r["points"]) for r in own.collect())
