"""Texts to chunks: fixed strides, recursive splitting, sentence windows, semantic breaks; chunk ids and payloads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.udfs import embed
from .search import dot, normalised

SIZE, OVERLAP = 500, 50
SEPARATORS = ("\n\n", "\n", " ", "")
SENTENCE_SEPARATORS = ("\n\n", "\n", ". ", " ")
HARD_CUT = 4000
#: Unicode's space separators: what is cut from the ends of a sentence.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def fixed(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """docs with pos (from 0) and content: pieces of size characters, each starting size - overlap after the last."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap is less than size")
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))
    cut = docs.filter(n > 0).select("*", F.posexplode(starts).alias("pos", "_start"))
    return cut.withColumn("content", F.substring(F.col(text), F.col("_start") + 1, F.lit(size))).drop("_start", text)


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most size characters, cut at the first separator that occurs; what is too long goes on to the next."""

    def joined(parts: list[str], between: str) -> Iterator[str]:
        held: list[str] = []
        total = 0
        for p in parts:
            if held and total + len(between) + len(p) > size:
                yield between.join(held)
                while held and (total > overlap or total + len(between) + len(p) > size):
                    total -= len(held[0]) + (len(between) if len(held) > 1 else 0)
                    held.pop(0)
            total += len(p) + (len(between) if held else 0)
            held.append(p)
        if held:
            yield between.join(held)

    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :] if sep in separators else ()
    out: list[str] = []
    short: list[str] = []
    for part in text.split(sep) if sep else list(text):
        if not part:
            continue
        if len(part) <= size:
            short.append(part)
            continue
        out += joined(short, sep)
        short = []
        out += split_text(part, size, overlap, rest) if rest else [part]
    out += joined(short, sep)
    return [x for p in out if (x := p.strip())]


def recursive(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS, text: str = "text") -> DataFrame:
    """docs with pos and content by split_text. Python sees the texts only; other columns stay in the JVM."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_text(t, size, overlap, separators) if t else [])

    return docs.select("*", F.posexplode(run(F.col(text))).alias("pos", "content")).drop(text)


def windows(units: DataFrame, key: str, per_chunk: int = 4, overlap: int = 1, hard_cut: int = HARD_CUT) -> DataFrame:
    """units: key, pos (from 0), content. Every step-th unit opens a window of per_chunk units; the last may be short.

    A unit goes to the windows that hold it (a bounded number), so no document has to be sorted in one task.
    """
    step = max(1, per_chunk - overlap)
    last = F.floor(F.col("pos") / step)
    first = F.greatest(F.ceil((F.col("pos") - per_chunk + 1) / step), F.lit(0))
    placed = units.filter(F.pmod("pos", F.lit(step)) < per_chunk).select(key, "pos", "content", F.explode(F.sequence(first, last)).alias("window"))
    grouped = placed.groupBy(key, "window").agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("own"))
    joined = F.array_join(F.transform("own", lambda u: F.trim(u["content"])), " ")
    return grouped.select(key, F.col("window").cast("int").alias("pos"), F.substring(joined, 1, hard_cut).alias("content"))


def sentences(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, pos, content: a text cut after sentence ends and at line ends; blank ones, no-break spaces included, don't count."""
    marked = F.regexp_replace(F.regexp_replace(F.col(text), r"\n+", "\n"), r"([.!?])[ \t]+", "$1\n")
    parts = F.filter(F.transform(F.split(marked, "\n"), lambda s: F.btrim(s, F.lit(SPACES))), lambda s: s != "")
    return docs.select(key, F.posexplode(parts).alias("pos", "content"))


def distances(units: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """units with distance: 1 - cosine to the unit before; null for the first of a text."""
    before = F.lag("_v").over(W.partitionBy(key).orderBy("pos"))
    own = units.withColumn("_v", normalised(F.col(vector)))
    return own.withColumn("distance", F.round(1 - dot(F.col("_v"), before), 9)).drop("_v")


def breakpoints(measured: DataFrame, key: str, percentile: float = 70.0) -> DataFrame:
    """key, threshold: the percentile of a text's distances, interpolated."""
    return measured.groupBy(key).agg(F.percentile("distance", F.lit(percentile / 100)).alias("threshold"))


def semantic(units: DataFrame, key: str, percentile: float = 70.0, vector: str = "vector") -> DataFrame:
    """key, chunk, n_units, content: units until the distance to the next exceeds the text's percentile.

    A chunk of any length stays whole here; see resplit.
    """
    measured = distances(units, key, vector)
    own = measured.join(breakpoints(measured, key, percentile), key)
    breaks = F.sum(F.when(F.col("distance") > F.col("threshold"), 1).otherwise(0)).over(W.partitionBy(key).orderBy("pos"))
    grouped = own.withColumn("chunk", breaks.cast("int")).groupBy(key, "chunk").agg(F.count("*").alias("n_units"), F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("own"))
    return grouped.select(key, "chunk", "n_units", F.array_join(F.transform("own", lambda u: u["content"]), " ").alias("content"))


def resplit(chunks: DataFrame, key: str, longest: int = HARD_CUT, size: int = 1200, overlap: int = 100) -> DataFrame:
    """key, chunk, pos, content: chunks of more than longest characters cut again by the recursive splitter; others whole, as pos 0."""
    long = chunks.filter(F.length("content") > longest).select(key, "chunk", F.col("content").alias("text"))
    whole = chunks.filter(F.length("content") <= longest).select(key, "chunk", F.lit(0).alias("pos"), "content")
    return whole.unionByName(recursive(long, size, overlap).select(key, "chunk", "pos", "content"))


def numbered(chunks: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """chunks with seq from 1 within key, and chunk_id <key>_<seq>."""
    seq = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return chunks.withColumn("seq", seq).withColumn("chunk_id", F.format_string("%s_%04d", F.col(key).cast("string"), F.col("seq")))


#: Fields that a chunk has from its document's metadata.
META = ("title", "organization", "budget", "announcement_date", "bid_start", "bid_deadline", "section_title", "file_type")


def payload(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """chunks: file_key, stem, page_number, pos, content, file_type. meta: file_key, doc_id, title, ... of known files.

    Files without metadata, or whose number is blank, go by their stem.
    """
    fields = [f for f in META if f in meta.columns]
    known = meta.select("file_key", F.nullif(F.trim(F.col("doc_id").cast("string")), F.lit("")).alias("_doc"), *(F.col(f).alias(f"_{f}") for f in fields))
    own = chunks.join(known, "file_key", "left").withColumn("doc_id", F.coalesce("_doc", "stem"))
    for f in fields:
        other = F.col("stem") if f == "title" else F.col(f) if f in chunks.columns else None
        own = own.withColumn(f, F.col(f"_{f}") if other is None else F.coalesce(f"_{f}", other))
    out = numbered(own, "doc_id", "file_key", F.col("page_number").asc_nulls_first(), "pos")
    return out.drop("_doc", *(f"_{f}" for f in fields))


def with_context(chunks: DataFrame, summary: Column) -> DataFrame:
    """A summary, if there is one, put before the content and kept beside it."""
    text = F.nullif(F.trim(summary), F.lit(""))
    return chunks.withColumn("context_summary", text).withColumn("content", F.when(F.col("context_summary").isNull(), F.col("content")).otherwise(F.concat_ws("\n\n", "context_summary", "content")))


def chunk(docs: DataFrame, mode: str, key: str, **options) -> DataFrame:
    """By mode: recursive, sentence, fixed or semantic (sentences by their vectors, long chunks cut again)."""
    if mode == "recursive":
        return recursive(docs, **options)
    if mode == "fixed":
        return fixed(docs, **options)
    if mode == "sentence":
        units = recursive(docs.select(key, "text"), 400, 50, SENTENCE_SEPARATORS)
        return windows(units, key, **options)
    if mode == "semantic":
        provider = options.pop("provider", "local")
        units = sentences(docs, key).withColumn("vector", embed(F.col("content"), provider))
        return resplit(semantic(units, key, **options), key)
    raise ValueError(f"unknown chunk mode: {mode}")
