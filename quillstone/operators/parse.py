"""A parse run: the pages of files to chunks with the metadata of their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key
from ..sources.files import with_tables
from ..sources.stored import stored
from . import chunking, matching

#: Score that a match of names has to have. Similarity alone has to reach matching.SIMILAR whatever this is.
THRESHOLD = 0.55


def listed_names(pages: DataFrame, meta: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """file_name, listed: the name in the metadata table that a file goes by, null if none comes near enough.

    No kind of match scores between threshold and SIMILAR and counts, so the index of names is asked for SIMILAR at least.
    """
    files = pages.select(F.col("file_name").alias("name")).distinct()
    best = matching.best_match(files, meta.select(F.col("file_name").alias("name"), "ordinal"), max(threshold, matching.SIMILAR), below=False)
    return best.select(F.col("name").alias("file_name"), F.when(F.col("matched"), F.col("best")).alias("listed"))


def chunks(pages: DataFrame, meta: DataFrame, mode: str = "recursive", threshold: float = THRESHOLD, tables: bool = True, **options) -> DataFrame:
    """pages: as sources.files gives them; meta: as sources.tables.read_metadata does. A row per chunk with chunk_id, doc_id, page_number
    (from 1), content, file_name and what chunking.payload has.

    Pages with an error or without text give no chunk; files that the metadata doesn't list go by their names. tables: whether
    a page's tables go with its text. Of metadata rows for one file the first listed counts.
    """
    unit = F.sha2(F.concat_ws("\n", "source", F.col("page").cast("string")), 256)
    text = with_tables(F.col("text"), F.col("tables")) if tables else F.col("text")
    docs = stored(pages.filter("error IS NULL").select(unit.alias("unit"), "source", "file_name", "file_type", (F.col("page") + 1).alias("page_number"), text.alias("text")).filter("trim(text) != ''"))
    cut = chunking.chunk(docs.select("unit", "text"), mode, "unit", **options)
    if "chunk" in cut.columns:  # semantic: pieces within chunks
        cut = cut.withColumn("pos", F.col("chunk").cast("long") * (1 << 31) + F.col("pos"))
    own = docs.drop("text").join(listed_names(docs, meta, threshold), "file_name")
    own = own.withColumn("file_key", name_key(F.coalesce("listed", "file_name"))).withColumn("stem", F.regexp_replace("file_name", r"\.[^.]+$", ""))
    pick = [c for c in meta.columns if c not in ("ordinal", "file_key")]
    first = meta.groupBy("file_key").agg(F.min_by(F.struct(*pick), "ordinal").alias("x")).select("file_key", *(F.col("x")[c].alias(c) for c in pick if c != "file_name"))
    return chunking.payload(cut.select("unit", "pos", "content").join(own, "unit"), first).drop("unit", "stem", "listed")
