"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source with share p of all words gets weight p^a / sum(p^a). The exponent a is the largest of k / 2^20 at which the
weights reach the target entropy, but no less than the smallest at which no source is repeated more often than the
limit allows. Both conditions are monotone in a, so it is found by bisection: each round evaluates a few exponents
between the bounds over the table of sources, as one aggregate.

Weights become whole documents by budgeted block permutations: a source's budget gives it so many full passes and a
rest. Its documents fall into about sqrt(documents) blocks by hash; the blocks are put into an order of their own, the
documents of a block too, and the rest takes documents in that order until the budget is spent. Blocks keep every
window small: no task ever sorts a whole source. By default the budget is the least one that uses each document of
every source at least once.

Nulls: a null source is a source of its own; a null text has no words; a null id is ordered before others. A source
without words gets no budget, and its documents are used once. Empty tables give empty results. Repeated rows are rows of
their own, and so are ties: of equal rows it doesn't matter which one is used once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch

STEPS, WAYS = 1 << 20, 32
TARGET_ENTROPY = 0.92
REPEAT_LIMIT = 2.0
#: So many sources, of some hundred bytes each, are broadcast to the rows.
BROADCAST = 50_000


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("null"))


def measured(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, text_key, source_key, tokens, h: what mixing needs of each document."""
    key = _source_key(F.col("source"))
    tokens = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), key.alias("source_key"), tokens.alias("tokens")).withColumn("h", _hash(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _curve(shares: DataFrame, low: int, high: int) -> list:
    """For WAYS exponents between the bounds: entropy of the weights and the most repeats of a source."""
    step = max(1, (high - low) // WAYS)
    probes = shares.select("p", F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step))).alias("k"))
    a = F.col("k") / STEPS
    sums = probes.groupBy("k").agg(F.sum(F.pow("p", a)).alias("z"), F.sum(F.pow("p", a) * a * F.ln("p")).alias("zl"), F.pow(F.max("p"), F.max(a) - 1).alias("top"), F.pow(F.min("p"), F.max(a) - 1).alias("least"))
    return sums.select("k", (F.ln("z") - F.col("zl") / F.col("z")).alias("entropy"), (F.col("least") / F.col("top")).alias("repeats")).orderBy("k").collect()  # at most WAYS + 2 rows


def exponent(shares: DataFrame, target: float, repeats: float) -> int:
    """a * 2^20. shares: (source_key, p) with p > 0. target: part of the greatest entropy, ln(sources)."""
    n = shares.count()
    if n < 2:
        return STEPS
    import math

    goal = target * math.log(n)

    def bisect(good, low: int, high: int) -> int:
        """The largest k of low..high for which good holds, if it holds from low on; else low."""
        while True:
            rows = [r for r in _curve(shares, low, high)]
            met = [r["k"] for r in rows if good(r)]
            at = max(met, default=low)
            over = min((r["k"] for r in rows if r["k"] > at), default=high)
            if over - at <= 1 or (at, over) == (low, high) and high - low < 2:
                return high if high in met else at
            low, high = at, over

    wanted = bisect(lambda r: r["entropy"] >= goal, 0, STEPS)
    # Repeats shrink as the exponent grows: the largest exponent that still repeats too often, and one more.
    if _curve(shares, wanted, wanted)[0]["repeats"] > repeats:
        wanted = min(STEPS, bisect(lambda r: r["repeats"] > repeats, wanted, STEPS) + 1)
    return wanted


def plan(docs: DataFrame, target: float = TARGET_ENTROPY, repeats: float = REPEAT_LIMIT, budget: int | None = None) -> DataFrame:
    """One row per document: doc_id, text_key, source_key, tokens, block, weight, copies (how often it is used)."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(measured(docs))
    sources = scratch.save(rows.groupBy("source_key").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs")))
    total = sources.agg(F.sum("n")).first()[0] or 0
    shares = sources.filter("n > 0").select("source_key", (F.col("n") / F.lit(max(total, 1))).alias("p"))
    a = exponent(shares, target, repeats) / STEPS
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    weighted = shares.withColumn("weight", F.pow("p", F.lit(a)) / F.lit(z))
    if budget is None:
        budget = weighted.agg(F.max(F.col("p") * total / F.col("weight"))).first()[0] or 0.0
    whole = sources.join(weighted.select("source_key", "weight"), "source_key", "left")
    want = F.floor(F.round(F.col("weight") * F.lit(float(budget)), 3)).cast("long")
    passes = whole.select("source_key", "docs", F.round(F.coalesce("weight", F.lit(0.0)), 9).alias("weight"), F.when(F.col("n") > 0, F.floor(want / F.col("n"))).otherwise(1).cast("long").alias("full"), F.when(F.col("n") > 0, want % F.col("n")).otherwise(0).alias("rest"))
    # A hot source then stays where its rows are. More sources than that are joined by key, where none can be hot for long.
    blocked = rows.join(F.broadcast(passes) if sources.count() <= BROADCAST else passes, "source_key").withColumn("block", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % F.ceil(F.sqrt("docs")).cast("long"))
    per_block = blocked.groupBy("source_key", "block").agg(F.sum("tokens").alias("block_tokens"))
    order = W.partitionBy("source_key").orderBy(_hash(F.lit("block"), F.col("source_key"), F.col("block").cast("string")), "block").rowsBetween(W.unboundedPreceding, -1)
    starts = per_block.select("source_key", "block", F.coalesce(F.sum("block_tokens").over(order), F.lit(0)).alias("start"))
    inside = W.partitionBy("source_key", "block").orderBy("h", "doc_id", "tokens").rowsBetween(W.unboundedPreceding, -1)
    placed = blocked.withColumn("before", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(starts, ["source_key", "block"])
    extra = (F.col("start") + F.col("before") < F.col("rest")).cast("long")
    return placed.select("doc_id", "text_key", "source_key", "tokens", "block", "weight", (F.col("full") + extra).alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mixture uses them, with all their columns.

    Of repeated rows (equal id, text and source) the plan may use some once more than others; those uses go to one of them,
    the first by its columns, so that a source never exceeds its budget.
    """
    per = plan(docs, **options).groupBy("doc_id", "text_key", "source_key").agg(F.min("copies").alias("_copies"), (F.sum("copies") - F.min("copies") * F.count("*")).alias("_extra"))
    uses = Scratch(docs.sparkSession).save(per.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("source_key").alias("_source"), "_copies", "_extra"))

    def rows(own: DataFrame, *more: Column) -> DataFrame:
        same = docs["doc_id"].cast("long").eqNullSafe(own["_id"]) & (F.xxhash64(docs["text"].cast("string")) == own["_key"]) & (_source_key(docs["source"]) == own["_source"])
        return docs.join(own, same).select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *more)

    each = uses.filter("_copies > 0")
    out = rows(each, F.explode(F.sequence(F.lit(1).cast("long"), each["_copies"])).alias("use")).select("row.*")
    more = uses.filter("_extra > 0")  # at most one group of a source: the one in which its budget ends
    if more.isEmpty():
        return out
    keys = [more[c].alias(f"k{i}") for i, c in enumerate(("_id", "_key", "_source", "_extra"))]
    first = rows(more, *keys).groupBy("k0", "k1", "k2", "k3").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return out.unionByName(first.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "k3")).alias("use")).select("row.*"))
