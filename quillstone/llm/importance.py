"""Resampling documents by importance for a target distribution of hashed word n-grams.

Each partition's texts go through a DuckDB connection of their task: SQL takes the words, makes n-grams by window functions, hashes
them by a registered function (zlib's CRC) and counts buckets. What it counts, one row for each document and one for each
partition, is spilled to Parquet in the shared folder. Spark merges the partitions' counts into the table of gains, which
has one row for each bucket, scores documents from their spilled counts, and ranks them by one exchange in ranges.

A document's score is its mean gain plus Gumbel noise from its id, so the highest scores are a sample without
replacement with probabilities that follow the importance weights.

Defined results. Null and empty texts, and those without words: no features, weight 0, never drawn; they are in the result. Null ids: as
the id of no characters. Repeated rows: each counted and scored; equal scores go to the smaller id, then fewer features.
Very long texts: cut between words into parts for SQL, with the words before a part that its n-grams need. Bytes that aren't UTF-8: U+FFFD. Empty table or
target: no rows, or gains by what is there. Only doc_id and the texts are read, so extra columns of any name stay behind.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pieces, texts
from .placing import placed

BUCKETS, SEED = 10_000, 2024
#: A call of SQL gets about so many characters, a part of a text at most so many and a word; DuckDB's memory in a task.
CALL_CHARS, PART_CHARS, MEMORY = 1 << 20, 1 << 20, "600MB"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased, and what stands between words.
_ANY_WORD, _BETWEEN = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+"), re.compile(r"[^0-9A-Za-z\x80-\U0010FFFF]")
SPILL = "doc_id long, whole boolean, n_words long, n_features long, buckets array<int>, counts array<long>"


def counting_sql(n: int, buckets: int) -> str:
    """Bucket counts of the parts in the table texts (part, text, skip): n-grams of 1 to n words that end after the first skip words."""
    grams = ["SELECT part, skip, i, 1 AS size, w AS f FROM words"]
    for size in range(2, n + 1):
        run = " || ' ' || ".join([*(f"lag(w, {j}) OVER own" for j in range(size - 1, 0, -1)), "w"])
        grams.append(f"SELECT part, skip, i, {size}, {run} FROM words WINDOW own AS (PARTITION BY part ORDER BY i)")
    return rf"""WITH words AS (
  SELECT part, skip, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT part, skip, regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS ws FROM texts)),
grams AS ({" UNION ALL ".join(grams)}),
counted AS (SELECT part, size, f, count(*) AS n FROM grams WHERE f IS NOT NULL AND i > skip GROUP BY part, size, f),
hashed AS (SELECT f, crc32(f) % {buckets} AS bucket FROM (SELECT DISTINCT f FROM counted)),
by_bucket AS (SELECT part, bucket, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (size = 1), 0)::BIGINT AS own FROM counted JOIN hashed USING (f) GROUP BY part, bucket)
SELECT part, sum(own)::BIGINT AS n_words, list(bucket::INTEGER) AS buckets, list(n) AS counts FROM by_bucket GROUP BY part"""


def parts(text: str, n: int, size: int) -> Iterator[tuple[str, int]]:
    """(part, number of words before it that it begins with): cut between words, so that all n-grams of a text lie in its parts."""
    if len(text) <= size:
        yield text, 0
        return
    at, before = 0, []
    while at < len(text):
        end = _BETWEEN.search(text, min(at + size, len(text)))
        end = end.start() if end else len(text)
        part = text[at:end]
        yield " ".join([*before, part]), len(before)
        if n > 1:
            before = [*before, *_ANY_WORD.findall(part)][1 - n :]
        at = end


def _crc(words: pa.ChunkedArray) -> pa.Array:
    return pa.array(map(zlib.crc32, words.cast(pa.binary()).to_pylist()), pa.int64())


class Counter:
    """A task's DuckDB connection, in memory, and what its partition has counted so far."""

    def __init__(self, n: int, buckets: int, memory: str = MEMORY):
        import duckdb

        self.sql, self.n, self.buckets, self.total, self.words = counting_sql(n, buckets), n, buckets, np.zeros(buckets, np.int64), 0
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        self.db.create_function("crc32", _crc, ["VARCHAR"], "BIGINT", type="arrow")

    def _run(self, part: list[int], text: list[str], skip: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(number, words, buckets, counts) of the given parts that have any."""
        self.db.register("texts", pa.table({"part": pa.array(range(len(part)), pa.int32()), "text": pa.array(text, pa.string()), "skip": pa.array(skip, pa.int32())}))
        found = self.db.sql(self.sql).to_arrow_table().combine_chunks()
        self.db.unregister("texts")
        columns = [found.column(c).combine_chunks() for c in ("buckets", "counts")]
        offsets = columns[0].offsets.to_numpy()
        buckets, counts = (np.asarray(c.values) for c in columns)
        for i, (at, words) in enumerate(zip(found.column("part").to_pylist(), found.column("n_words").to_pylist(), strict=True)):
            own = slice(offsets[i], offsets[i + 1])
            yield part[at], words, buckets[own], counts[own]

    def of(self, rows: list[bytes], part_chars: int = PART_CHARS, call_chars: int = CALL_CHARS) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(words, buckets, counts) of each text."""
        out: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in rows]
        call: tuple[list[int], list[str], list[int]] = ([], [], [])
        size = 0

        def run() -> None:
            for at, words, buckets, counts in self._run(*call):
                self.total[buckets] += counts
                self.words += words
                out[at].append((words, buckets, counts))
            for x in call:
                x.clear()

        for i, raw in enumerate(rows):
            for text, skip in parts(raw.decode(errors="replace"), self.n, part_chars):
                for x, value in zip(call, (i, text, skip), strict=True):
                    x.append(value)
                size += len(text)
                if size >= call_chars:
                    run()
                    size = 0
        if call[0]:
            run()
        return list(map(self._merged, out))

    @staticmethod
    def _merged(found: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
        """A document's parts as one; its buckets are bounded, whatever its length."""
        if len(found) == 1:
            return found[0]
        if not found:
            return 0, np.empty(0, np.int32), np.empty(0, np.int64)
        buckets, at = np.unique(np.concatenate([b for _, b, _ in found]), return_inverse=True)
        counts = np.zeros(len(buckets), np.int64)
        np.add.at(counts, at, np.concatenate([c for _, _, c in found]))
        return sum(w for w, _, _ in found), buckets, counts


def count(rows: DataFrame, n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """SPILL's columns: a row for each of rows (doc_id, text), and one for each partition, whole, with all that it counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(n, buckets)

        def made(ids: pa.Array, whole: bool, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            cols = [
                ids, pa.array([whole] * len(found)), pa.array([w for w, _, _ in found], pa.int64()), pa.array([int(c.sum()) for _, _, c in found], pa.int64()),
                pa.array([b for _, b, _ in found], pa.list_(pa.int32())), pa.array([c for _, _, c in found], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "whole", "n_words", "n_features", "buckets", "counts"])

        for batch in pieces(batches, 1024):
            yield made(batch.column("doc_id"), False, counter.of(texts(batch.column("text"))))
        used = np.flatnonzero(counter.total)
        yield made(pa.array([None], pa.int64()), True, [(counter.words, used.astype(np.int32), counter.total[used])])

    return rows.mapInArrow(run, SPILL)


def merged(spilled: DataFrame, name: str) -> DataFrame:
    """bucket and its count in all partitions."""
    return spilled.filter("whole").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row, gain array<long>, a number for each bucket: floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B))))."""
    every = source.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(merged(source, "s"), "bucket", "left").join(merged(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c, more: (F.col(c) + more).cast("double")
    gain = F.floor(1000 * F.ln(d("t", 1) * d("all_s", buckets) / (d("s", 1) * d("all_t", buckets))))
    own = both.crossJoin(F.broadcast(sums)).select("bucket", gain.alias("gain"))  # sums: one row
    return own.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "gain"))), lambda x: x["gain"]).alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from 32 bits of the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, seed: int = SEED, least_words: int = 20, percent: int = 10, text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank (of the drawn, from 1; null: not drawn) of every document.

    target: a table with the column text. percent of the documents that have least_words words are drawn.
    """
    scratch = Scratch(docs.sparkSession)
    rows = lambda df, own_id, column: df.select(own_id.cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"))
    spilled = scratch.save(count(rows(docs, F.col("doc_id"), text), n, buckets))
    wanted = scratch.save(count(rows(target, F.lit(None), "text"), n, buckets))
    gain = scratch.save(gains(spilled, wanted, buckets))
    own = spilled.filter("NOT whole").crossJoin(F.broadcast(gain))  # one row, as long as there are buckets
    total = F.aggregate(F.arrays_zip("buckets", "counts"), F.lit(0).cast("long"), lambda s, x: s + F.element_at("gain", x["buckets"] + 1) * x["counts"])
    summed = own.select("doc_id", "n_words", "n_features", total.alias("total"))
    weight = F.when(F.col("n_features") > 0, ((F.col("total") - F.pmod("total", "n_features")) / F.col("n_features")).cast("long")).otherwise(F.lit(0).cast("long"))
    scored = scratch.save(summed.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    fit = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * fit.count() // 100
    order = [F.col("score").desc(), F.asc_nulls_first("doc_id"), F.col("n_features")]
    ranked = placed(scratch, fit, [], order).select("doc_id", "n_features", "weight", "score", F.when(F.col("pos") < drawn, F.col("pos") + 1).alias("rank"))
    return ranked.unionByName(scored.filter(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
