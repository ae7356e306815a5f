"""Helpers shared by the training-data operators: tables, scratch tables, words and intervals."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as bytes.split() takes it; the same class as a pattern for JVM-side expressions.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a local session gets a temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Intermediate tables in the shared folder. They cut lineage as checkpoint() does, but compressed and by column."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.paths = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}", {}

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in frames:
            path = self.paths[id(df)][1]
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64, so that every bit of the input reaches every bit of the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    BOUND = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multipliers that make a run of words or bytes one number, depending on order.
BASE = np.uint64(0x9E3779B97F4A7C15)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive items (whose own hashes are well mixed): one for each start, none if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total *= BASE
            total += hashes[i : i + n]
    return mixed(total)


class Powers:
    """Powers of BASE and of its inverse, as far as they have been needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            size = max(n + 1, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (BASE, inverse))
        return self.up, self.down


def slices(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of hashes[start:end], whatever their lengths, by differences of one running sum."""
    up, down = powers.of(len(hashes))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * down[: len(hashes)], dtype=np.uint64)))
        return mixed((sums[end] - sums[start]) * up[end] + (seed.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Sorted positions that hold the rightmost least value of some window of that width (winnowing).

    Sparse-table minima: log2(width) passes whatever the width is.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    # Values are made unique by position in the low bits, so that ties go to the rightmost place of a window.
    best, span = np.arange(len(values), dtype=np.int64), 1
    while span * 2 <= width:
        left, right = best[: len(best) - span], best[span:]
        best = np.where(values[right] <= values[left], right, left)
        span *= 2
    left, right = best[:n], best[width - span : width - span + n]
    return np.unique(np.where(values[right] <= values[left], right, left))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that half-open intervals cover; touching ones become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate(([True], s[1:] > e[:-1]))
    last = np.concatenate((first[1:], [True]))
    return s[first], e[last]


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut small, so that what a task holds follows a few texts, not Arrow's batch size."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def id_text(docs: DataFrame) -> DataFrame:
    """Only what the digests need; extra columns, of whatever names, stay behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
