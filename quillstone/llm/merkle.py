"""Merkle manifest of a dataset, in higher-order SQL functions over blocks.

A leaf is the hash of a row's fields. The leaves of a language stand in order and go in blocks of 8^4 into fixed-size arrays; a
block's levels are collapsed inside its row by sequence, slice and transform, and what a block becomes is a leaf of the
next round, until each language is one node. Languages, in their order, make the tree above in the same way. On the way
down, a block's row finds for each of its members the other nodes of its run on every level (slice again), and the
rounds above add theirs, so a member gets its path to the root; aggregate folds a leaf along it.

A block's arrays are bounded whatever the table or the share of a language; places come from one exchange by ranges.

Defined results. Nulls in any field: `-` in the leaf; a null language is a language, the first; null ids come first within it.
Repeated rows and equal ids: each a leaf, ordered by leaf, so equal rows have all results but their places alike. Null, empty and very long texts: hashed
as they are (null isn't empty); a null id or text isn't tampered with. Empty table: no rows. Only the five fields
are read, so extra columns of any name stay behind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .placing import placed

RUN, LEVELS = 8, 4
BLOCK = RUN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(fields: list[Column]) -> Column:
    """The hash of fields as strings: `-` for null, else the number of bytes, a colon and the value."""
    return sha(F.concat(*(F.coalesce(F.concat(F.octet_length(f), F.lit(":"), f), F.lit("-")) for f in fields)))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _collapsed(level: Column) -> Column:
    """One level up: the hash of every RUN consecutive nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / RUN).cast("int"))
    return F.transform(runs, lambda r: sha(F.array_join(F.slice(level, r * RUN + 1, F.lit(RUN)), "")))


def _height(n: Column) -> Column:
    """Levels that a block has: all of them, or as many as bring a group that fits in it to one node."""
    return reduce(lambda a, b: a + b, ((n > RUN**d).cast("int") for d in range(LEVELS)))


def _blocks(nodes: DataFrame) -> DataFrame:
    """grp, block, of, items (in order), l0..l3 (arrays of hex) and top (hex). nodes: grp, pos, of, node binary, and what else an item keeps.

    The levels are columns of their own, so that a member's slices don't build them anew.
    """
    kept = [c for c in nodes.columns if c not in ("grp", "of", "pos", "node")]
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    rows = nodes.groupBy("grp", block).agg(F.first("of").alias("of"), F.array_sort(F.collect_list(F.struct("pos", "node", *kept))).alias("items"))
    rows = rows.withColumn("l0", F.transform("items", lambda x: _hex(x["node"])))
    for d in range(LEVELS):
        rows = rows.withColumn(f"l{d + 1}", _collapsed(F.col(f"l{d}")))
    root = F.element_at(F.array(*(F.element_at(f"l{d}", 1) for d in range(LEVELS + 1))), _height(F.col("of")) + 1)
    items = F.transform("items", lambda x: F.struct(*(x[c].alias(c) for c in ("pos", *kept))))
    return rows.withColumn("top", root).withColumn("items", items).drop(f"l{LEVELS}")


def tree(scratch: Scratch, nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(the rounds' blocks, grp and root of each group). nodes: grp, pos, of, node, ..."""
    rounds = [scratch.save(_blocks(nodes))]
    while rounds[-1].filter(F.col("of") > BLOCK).limit(1).count():
        last = rounds[-1].filter(F.col("of") > BLOCK)
        rounds.append(scratch.save(_blocks(last.select("grp", F.col("block").alias("pos"), F.ceil(F.col("of") / BLOCK).alias("of"), F.unhex("top").alias("node")))))
    return rounds, reduce(DataFrame.unionByName, (r.filter(F.col("of") <= BLOCK).select("grp", F.col("top").alias("root")) for r in rounds))


def _siblings(i: Column) -> Column:
    """What stands before and after member i of a block in its run, level by level, as far as the block's height."""
    own = []
    for d, level in enumerate(F.col(f"l{d}") for d in range(LEVELS)):
        at = F.shiftright(i, 3 * d)
        inside = at.bitwiseAND(RUN - 1)
        before, after = F.slice(level, at - inside + 1, inside), F.slice(level, at + 2, RUN - 1 - inside)
        own.append(F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after")))
    return F.slice(F.array(*own), F.lit(1), _height(F.col("of")))


def paths(scratch: Scratch, rounds: list[DataFrame], tops: DataFrame, *more: str) -> DataFrame:
    """What each node of the first round has kept, with node (hex), path (array of before and after, to the root) and more.

    tops: grp, path (of the group's root to the tree's), and more.
    """
    above = None
    for r in reversed(rounds):
        ends = r.filter((F.col("of") <= BLOCK) & (F.col("block") == 0)).select("grp", "block")
        own = ends.join(tops.withColumnRenamed("grp", "_grp"), F.col("grp") == F.col("_grp")).select("grp", "block", "path", *more)
        upper = own if above is None else own.unionByName(above.select("grp", F.col("pos").alias("block"), "path", *more))
        upper = upper.select(F.col("grp").alias("_grp"), F.col("block").alias("_block"), F.col("path").alias("_upper"), *more)
        both = r.join(upper, (F.col("grp") == F.col("_grp")) & (F.col("block") == F.col("_block")))
        member = F.transform("items", lambda x, i: F.struct(*(x[c].alias(c) for c in r.schema["items"].dataType.elementType.fieldNames()), F.element_at("l0", i + 1).alias("node"), F.concat(_siblings(i), F.col("_upper")).alias("path")))
        above = both.select("grp", *more, F.inline(member))
        if r is not rounds[0]:
            above = scratch.save(above.drop("node"))
    return above


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf (hex) and its path give."""
    return F.aggregate(path, start, lambda node, s: sha(F.concat(s["before"], node, s["after"])))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, one row per row of docs.

    tampered: which rows are folded from a leaf whose text's A-Z are lower-cased; unset: those whose id's crc32 3 divides.
    """
    scratch = Scratch(docs.sparkSession)
    fields = [F.col(c).cast("string") for c in FIELDS]
    altered = [*fields[:-1], F.translate(fields[-1], UPPER, UPPER.lower())]
    touched = F.crc32(fields[0]) % 3 == 0 if tampered is None else tampered
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), fields[2]), F.lit("")).alias("grp"), F.unhex(leaf(fields)).alias("node"),
        F.when(touched, F.unhex(leaf(altered))).alias("other"), F.monotonically_increasing_id().alias("tie"),
    )
    leaves = scratch.save(rows)
    ordered = placed(scratch, leaves, ["grp"], [F.asc_nulls_first("doc_id"), F.col("node"), F.col("tie")]).drop("tie")
    rounds, subroots = tree(scratch, ordered)
    subroots = scratch.save(subroots.select(F.lit("").alias("whole"), "grp", F.unhex("root").alias("node")))
    above = placed(scratch, subroots, ["whole"], [F.col("grp")]).withColumnsRenamed({"grp": "of_grp", "whole": "grp"})
    above_rounds, roots = tree(scratch, above)
    none = F.array().cast("array<struct<before:string,after:string>>")
    tops = paths(scratch, above_rounds, roots.select("grp", none.alias("path"), "root"), "root").select(F.col("of_grp").alias("grp"), "path", F.col("node").alias("subroot"), "root")
    found = paths(scratch, rounds, scratch.save(tops), "subroot", "root")
    proof = sha(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""))
    out = found.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded(F.col("path"), F.coalesce(_hex(F.col("other")), F.col("node"))).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
