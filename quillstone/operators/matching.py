"""Files to metadata rows and names to files: exact, by copy suffix, by containment, by similarity.

Names meet on equal keys, and else through the index of operators.names; rows are compared only after that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import copy_suffix_key, extension, name_key
from ..functions.udfs import similarity
from ..sources.stored import stored
from . import names

Ratio = Callable[[Column, Column], Column]
THRESHOLD, SIMILAR = 0.8, 0.9
PREFIX, MARGIN = 12, 0.05


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """Without Python: one minus the edit distance over the longer length."""
    return F.round(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)), 6)


def _keys(names: DataFrame, column: str, prefix: str, *more: str) -> DataFrame:
    own = F.col(column)
    return names.select(own.alias(prefix), *more, extension(own).alias("ext"), name_key(own).alias(f"{prefix}_key"), copy_suffix_key(own).alias(f"{prefix}_bare"))


def _candidates(a: DataFrame, b: DataFrame, floor: float, ratio: Ratio) -> DataFrame:
    """actual_key, csv_key of names that are the same but for a copy suffix, part of one another, or alike by floor at least."""
    one, other = a.select(F.col("actual_key").alias("a")), b.select(F.col("csv_key").alias("b"))
    swapped = names.containing(other.select(F.col("b").alias("a")), one.select(F.col("a").alias("b"))).select(F.col("b").alias("a"), F.col("a").alias("b"))
    inside = names.containing(one, other).unionByName(swapped)
    close = names.alike(one, other, floor, ratio).select("a", "b")
    keys = ["actual_key", "csv_key"]
    copied = a.join(b, a["actual_bare"] == b["csv_key"]).select(keys).unionAll(a.join(b, a["actual_key"] == b["csv_bare"]).select(keys))
    return inside.unionByName(close).toDF(*keys).unionAll(copied).distinct()


def best_match(files: DataFrame, listed: DataFrame, threshold: float = THRESHOLD, ratio: Ratio = similarity, below: bool = True) -> DataFrame:
    """files: name. listed: name, ordinal. One row per file: name, best, score, match_type, matched.

    Equal keys (1) beat equal keys without copy suffix (.99), containment (.95) and similarity; of equal scores the first
    listed wins. Similarity has to reach .9 at least. below: whether files that nothing matches by the threshold say
    what comes nearest, for which they, and they alone, are compared with every name of their extension.
    """
    a = _keys(files.select("name").distinct(), "name", "actual").filter("actual_key != ''")
    b = _keys(listed, "name", "csv", "ordinal").filter("csv_key != ''").withColumnRenamed("ext", "csv_ext")
    a, b = stored(a), stored(b)
    fits = (F.col("ext") == "") | (F.col("ext") == F.col("csv_ext"))
    exact = a.join(b, (a["actual_key"] == b["csv_key"]) & fits)
    exact = exact.groupBy("actual").agg(F.min(F.struct("ordinal", "csv"))["csv"].alias("best")).select("actual", "best", F.lit(1.0).alias("score"), F.lit("exact").alias("match_type"))
    rest = a.join(exact, "actual", "left_anti")
    copied = (F.col("actual_bare") == F.col("csv_key")) | (F.col("actual_key") == F.col("csv_bare"))
    inside = F.contains("csv_key", "actual_key") | F.contains("actual_key", "csv_key")
    kind = F.when(copied, "copy_suffix").when(inside, "contains").otherwise("similarity")
    score = F.when(copied, 0.99).when(inside, 0.95).otherwise(ratio(F.col("actual_key"), F.col("csv_key")))

    def first(pairs: DataFrame, least: float) -> DataFrame:
        scored = pairs.filter(fits).withColumn("score", score).withColumn("match_type", kind).filter((F.col("score") > 0) & (F.col("score") >= least))
        own = scored.groupBy("actual").agg(F.min(F.struct((-F.col("score")).alias("cost"), "ordinal", F.col("csv").alias("best"), "score", "match_type")).alias("x"))
        return own.select("actual", "x.best", "x.score", "x.match_type")

    near = stored(first(rest.join(_candidates(rest, b, threshold, ratio), "actual_key").join(b, "csv_key"), threshold))
    found = exact.unionByName(near)
    if below:
        found = found.unionByName(first(rest.join(near, "actual", "left_anti").join(b, fits), 0.0))
    need = F.when(F.col("match_type") == "similarity", F.greatest(F.lit(threshold), F.lit(SIMILAR))).otherwise(F.lit(threshold))
    out = files.select("name").join(found, found["actual"] == files["name"], "left").drop("actual")
    return out.select("name", "best", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("match_type", F.lit("none")).alias("match_type"), F.coalesce(F.col("score") >= need, F.lit(False)).alias("matched"))


def first_containing(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """wanted: name, key. listed: ordinal, listed_name, listed_key. The first listed one that holds a name or is held by it."""
    one, other = wanted.select(F.col("key").alias("a")), listed.select(F.col("listed_key").alias("b"))
    swapped = names.containing(other.select(F.col("b").alias("a")), one.select(F.col("a").alias("b")))
    met = names.containing(one, other).toDF("key", "listed_key").unionByName(swapped.toDF("listed_key", "key")).distinct()
    pairs = wanted.join(met, "key").join(listed, "listed_key")
    first = pairs.groupBy("name").agg(F.min(F.struct("ordinal", "listed_name"))["listed_name"].alias("listed_name"))
    return wanted.select("name").join(first, "name", "left")


def resolve(wanted: DataFrame, files: DataFrame, ratio: Ratio = similarity) -> DataFrame:
    """wanted: name; files: name. name, resolved, how: equal key, the only longer name, the most similar by a margin, or unchanged.

    Names meet on equal keys, on their first PREFIX characters, and where they are alike by THRESHOLD - MARGIN at least: a second name
    that is less alike than that doesn't come within the margin of a first that counts.
    """
    asked = stored(_keys(wanted.distinct(), "name", "asked"))
    there = stored(_keys(files.distinct(), "name", "file").withColumnRenamed("ext", "file_ext"))
    keys = ["asked", "file"]
    same = asked.join(there, asked["asked_key"] == there["file_key"]).filter("ext = file_ext").select(keys).unionAll(asked.join(there, asked["asked_bare"] == there["file_bare"]).filter("ext = file_ext").select(keys)).distinct()
    close = names.alike(asked.select(F.col("asked_key").alias("a")), there.select(F.col("file_key").alias("b")), THRESHOLD - MARGIN, ratio)
    near = asked.join(close, asked["asked_key"] == close["a"]).join(there, F.col("b") == F.col("file_key")).filter("ext = file_ext").select(*keys, "score")
    scored = same.withColumn("score", F.lit(1.0)).unionByName(near.join(same, keys, "left_anti"))
    start = lambda c: F.substring(c, 1, PREFIX)
    longer = asked.filter(F.length("asked_bare") >= PREFIX).join(there, (start("asked_bare") == start("file_bare")) & (F.col("ext") == F.col("file_ext"))).filter(F.startswith("file_bare", "asked_bare"))
    order = W.partitionBy("asked").orderBy(F.desc("score"), F.desc("file"))
    ranked = scored.withColumn("n", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("score").over(order), F.lit(0.0)))
    best = ranked.filter(f"n = 1 AND score >= {THRESHOLD} AND score - next >= {MARGIN}").select("asked", F.col("file").alias("near"))
    per_name = asked.select("asked").join(same.groupBy("asked").agg(F.min("file").alias("equal")), "asked", "left")
    per_name = per_name.join(longer.groupBy("asked").agg(F.when(F.count("*") == 1, F.min("file")).alias("only")), "asked", "left").join(best, "asked", "left")
    out = wanted.join(per_name, per_name["asked"] == wanted["name"], "left")
    how = F.when(F.col("equal").isNotNull(), "equal").when(F.col("only").isNotNull(), "prefix").when(F.col("near").isNotNull(), "similar").otherwise("unchanged")
    return out.select("name", F.coalesce("equal", "only", "near", "name").alias("resolved"), how.alias("how"))


def with_metadata(chunks: DataFrame, meta: DataFrame, key: str = "file_key") -> DataFrame:
    """A left join that Spark broadcasts if the metadata is small enough."""
    return chunks.join(meta, key, "left")


def audit(rows: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """rows' keys with matched."""
    known = meta.select(key).distinct().withColumn("_known", F.lit(True))
    return rows.join(known, key, "left").select(key, F.col("_known").isNotNull().alias("matched"))


def match_rate(audited: DataFrame) -> DataFrame:
    return audited.agg(F.sum(F.col("matched").cast("int")).alias("matched"), F.count("*").alias("total"), F.round(100 * F.avg(F.col("matched").cast("int")), 1).alias("percent"))


def null_audit(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, null_count, total, ratio: missing values, NaN included."""
    kinds = dict(rows.dtypes)
    gone = lambda c: F.col(c).isNull() | F.isnan(c) if kinds[c] in ("float", "double") else F.col(c).isNull()
    sums = rows.agg(F.count("*").alias("total"), *(F.coalesce(F.sum(gone(c).cast("long")), F.lit(0)).alias(c) for c in columns))
    long = sums.unpivot("total", columns, "column", "null_count")
    return long.select("column", "null_count", "total", F.round(F.col("null_count") / F.greatest("total", F.lit(1)), 6).alias("ratio"))
