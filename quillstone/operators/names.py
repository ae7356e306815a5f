"""Joins of names by likeness and by containment through an index of character pairs, instead of by comparing all with all.

Names that are alike share pairs of characters: of two names of T characters together that agree in M of them in order,
3 M - T - 1 pairs at least are common, each change breaking two pairs of its own name and an insertion one of the other's. So
names meet on their rare pairs only (as many as make sure that one of the common ones is among them), lengths and the
count of common pairs are checked, and only what is left is compared in full. A name that is part of another has all its
pairs there, so it looks for its rarest one. Pairs that very many names have are split by salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored

Ratio = Callable[[Column, Column], Column]
#: Names that a pair of characters brings to one task, before it is split.
SPLIT = 2000
#: A ratio may have been rounded up by so much.
ROUNDED = 1e-6


def pairs_of(key: Column) -> Column:
    """The pairs of neighbouring characters, as often as they occur: the second xy is another one than the first."""
    own = F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - 1, F.lit(1))), lambda i: F.substring(key, i, 2))
    numbered = F.transform(own, lambda p, i: F.concat(p, F.size(F.filter(F.slice(own, 1, i), lambda q: q == p)).cast("string")))
    return F.when(F.length(key) > 1, numbered).otherwise(F.array().cast("array<string>"))


def _parts(n: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)


def _common(floor: float, both: Column) -> Column:
    """Common pairs that two names with so many characters together have at least, if their ratio reaches floor."""
    return F.ceil((1.5 * floor - 1) * both - 1 - ROUNDED)


def _rare(keys: DataFrame, known: DataFrame, floor: float, column: str) -> DataFrame:
    """column, pair, n: those pairs of each key, the rarest, one of which any key alike must share; n: parts that a pair is in."""
    length = F.length(column)
    least = F.greatest(_common(floor, length + F.ceil(length * floor / (2 - floor) - ROUNDED)), F.lit(1))
    own = keys.select(column, F.explode("pairs").alias("pair"), (F.size("pairs") - least + 1).cast("int").alias("take")).join(known, "pair")
    listed = own.groupBy(column, "take").agg(F.array_sort(F.collect_list(F.struct("df", "pair"))).alias("x"))
    taken = listed.filter("take > 0").select(column, F.explode(F.slice("x", F.lit(1), F.col("take"))).alias("x"))
    return taken.select(column, F.col("x.pair").alias("pair"), F.ceil(F.col("x.df") / SPLIT).cast("int").alias("n"))


def alike(left: DataFrame, right: DataFrame, floor: float, ratio: Ratio) -> DataFrame:
    """a, b, score of all keys of left (column a) and right (column b) whose ratio is floor at least; none is missed.

    ratio: 2 M / T with M characters in common in order, or less, like matching blocks and one minus the edit distance over
    the longer length. floor is above 2/3, as below it likeness needs no common pair. Null and empty keys are like nothing.
    """
    if floor <= 2 / 3 + 0.01:
        raise ValueError("names that are less alike than 0.68 may have no pair of characters in common")
    t = floor - ROUNDED
    a, b = (stored(df.filter(F.length(c) > 0).select(c).distinct().withColumn("pairs", pairs_of(F.col(c)))) for df, c in ((left, "a"), (right, "b")))
    known = stored(a.select(F.explode("pairs").alias("pair")).unionAll(b.select(F.explode("pairs").alias("pair"))).groupBy("pair").agg(F.count("*").alias("df")))
    one = _rare(a, known, t, "a").withColumn("part", F.pmod(F.xxhash64("a"), F.col("n")))
    other = _rare(b, known, t, "b").withColumn("part", F.explode(_parts(F.col("n"))))
    both, shorter = F.length("a") + F.length("b"), F.least(F.length("a"), F.length("b"))
    met = one.join(other.select("b", "pair", "part"), ["pair", "part"]).filter(2 * shorter >= t * both).select("a", "b")
    # Names so short that likeness needs no common pair have a common character.
    short = int(1 / (1.5 * t - 1)) + 1
    letters = lambda df, c: df.filter(F.length(c) < short).select(c, F.explode(F.array_distinct(F.split(c, ""))).alias("letter"))
    small = letters(a, "a").join(letters(b, "b"), "letter").filter((both <= short) & (2 * shorter >= t * both)).select("a", "b")
    found = met.unionAll(small).distinct().join(a, "a").join(b.withColumnRenamed("pairs", "other_pairs"), "b")
    fit = found.filter(F.size(F.array_intersect("pairs", "other_pairs")) >= _common(t, both)).select("a", "b")
    return fit.withColumn("score", ratio(F.col("a"), F.col("b"))).filter(F.col("score") >= floor)


def containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """a, b: the keys of inner (column a) that are part of a key of outer (column b), equal ones included. Empty keys are part of nothing."""
    a = inner.filter(F.length("a") > 0).select("a").distinct()
    b = stored(outer.filter(F.length("b") > 0).select("b").distinct())
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, 2)))
    places = b.filter(F.length("b") > 1).select("b", F.explode(pairs(F.col("b"))).alias("pair"))
    known = stored(places.groupBy("pair").agg(F.count("*").alias("df")))
    own = a.filter(F.length("a") > 1).select("a", F.explode(pairs(F.col("a"))).alias("pair")).join(known, "pair", "left").fillna(0, ["df"])
    rarest = own.groupBy("a").agg(F.min(F.struct("df", "pair")).alias("x")).filter("x.df > 0")
    n = F.ceil(F.col("df") / SPLIT).cast("int")
    one = rarest.select("a", F.col("x.pair").alias("pair"), F.explode(_parts(F.ceil(F.col("x.df") / SPLIT))).alias("part"))
    wanted = known.join(rarest.select(F.col("x.pair").alias("pair")).distinct(), "pair", "left_semi")
    other = places.join(wanted, "pair").select("b", "pair", F.pmod(F.xxhash64("b"), n).alias("part"))
    met = one.join(other, ["pair", "part"]).select("a", "b")
    letters = b.select("b", F.explode(F.array_distinct(F.split("b", ""))).alias("a"))
    return met.filter(F.contains("b", "a")).unionAll(a.filter(F.length("a") == 1).join(letters, "a").select("a", "b"))
