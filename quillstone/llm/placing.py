"""Gapless places of rows in a total order, found without bringing the rows of a group together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, partitions

ROW_BITS = 33


def placed(scratch: Scratch, rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """rows with pos (long, from 0 within each group, null groups included) and of (the group's rows).

    One exchange by ranges sorts the rows; each range then only needs to know how many of its group's rows are in earlier
    ranges, which a table of one row for each range and group tells. A group that is most of the table is in many ranges. rows must give the
    same rows when read again (a written table); order should tell all rows apart whose places matter, and a last column
    that differs between equal rows keeps many of those out of one range.
    """
    keys = list(map(F.col, group))
    own = rows.repartitionByRange(partitions(rows.sparkSession), *keys, *order).sortWithinPartitions(*keys, *order)
    sorted_ = scratch.save(own.withColumn("_id", F.monotonically_increasing_id()))
    part, at = F.shiftright("_id", ROW_BITS).alias("_part"), F.col("_id").bitwiseAND((1 << ROW_BITS) - 1)
    ranges = sorted_.groupBy(*keys, part).agg(F.min(at).alias("_first"), F.count("*").alias("_n"))
    of_group = W.partitionBy(*keys)
    earlier = F.coalesce(F.sum("_n").over(of_group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*(F.col(k).alias(f"_{k}") for k in group), F.col("_part").alias("_range"), (earlier - F.col("_first")).alias("_shift"), F.sum("_n").over(of_group).alias("of"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in group), F.shiftright("_id", ROW_BITS) == F.col("_range"))
    out = sorted_.join(ranges, same)
    return out.select(*rows.columns, (at + F.col("_shift")).alias("pos"), "of")
