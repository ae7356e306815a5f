"""Metadata filters: from a query's text, merged, and as conditions on rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.amounts import amount_bounds, date_bounds, date_near


@dataclass(frozen=True)
class MetadataFilter:
    """Conditions of one query; None: no condition. A single organization may be given as a string."""

    organization: list[str] | str | None = None
    budget_min: float | None = None
    budget_max: float | None = None
    announcement_after: str | None = None
    announcement_before: str | None = None
    bid_start_after: str | None = None
    bid_start_before: str | None = None
    bid_deadline_after: str | None = None
    bid_deadline_before: str | None = None
    title_keyword: str | None = None
    doc_id: str | None = None

    def organizations(self) -> list[str]:
        own = [self.organization] if isinstance(self.organization, str) else self.organization or []
        return list(dict.fromkeys(x for x in own if x))

    def is_empty(self) -> bool:
        return not self.organizations() and all(getattr(self, f.name) is None for f in fields(self)[1:])

    def merged(self, other: MetadataFilter) -> MetadataFilter:
        """Own conditions win; organizations of both, own first."""
        own = {f.name: getattr(self, f.name) if getattr(self, f.name) is not None else getattr(other, f.name) for f in fields(self)[1:]}
        return replace(self, organization=list(dict.fromkeys(self.organizations() + other.organizations())) or None, **own)

    def condition(self, words: str = "all") -> Column:
        """All conditions as one column expression, which Spark pushes to the scan where it can."""
        terms = []
        if self.organizations():
            terms.append(reduce(lambda a, b: a | b, (text_matches(F.col("organization"), o, words) for o in self.organizations())))
        if self.budget_min is not None:
            terms.append(F.col("budget") >= self.budget_min)
        if self.budget_max is not None:
            terms.append(F.col("budget") <= self.budget_max)
        for name, column in (("announcement", "announcement_date"), ("bid_start", "bid_start"), ("bid_deadline", "bid_deadline")):
            for side, end in (("after", "starts"), ("before", "ends")):
                if (value := getattr(self, f"{name}_{side}")) is not None:
                    bound = F.to_timestamp_ntz(F.replace(date_bounds(F.lit(value))[end], F.lit("Z"), F.lit("")), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
                    terms.append(F.col(column) >= bound if side == "after" else F.col(column) <= bound)
        if self.title_keyword:
            terms.append(text_matches(F.col("title"), self.title_keyword, words))
        if self.doc_id is not None:
            terms.append(F.col("doc_id").cast("string") == self.doc_id)
        return reduce(lambda a, b: a & b, terms) if terms else F.lit(True)


def text_matches(column: Column, wanted: str, words: str = "all") -> Column:
    """words: 'all': every word of wanted occurs, as a word; 'substring': wanted occurs as it is. Case doesn't count."""
    text = F.lower(F.coalesce(column, F.lit("")))
    if words == "substring":
        return F.contains(text, F.lit(wanted.lower()))
    tokens = F.split(text, r"(?U)[^\w]+")
    return reduce(lambda a, b: a & b, (F.array_contains(tokens, w) for w in re.findall(r"\w+", wanted.lower())), F.lit(True))


def from_text(text: Column, announced=fixed.ANNOUNCED, starts=fixed.STARTS, deadline=fixed.DEADLINE, after=fixed.AFTER, before=fixed.BEFORE, **amounts) -> list[Column]:
    """The filter columns that a query's text gives: bounds of the amount, and of three dates by words for direction.

    The words are looked for in the whole text, so they speak of all its dates; those for 'after' come first.
    """
    has = lambda words: reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))
    money = amount_bounds(text, **amounts)
    out = [money["budget_min"].alias("budget_min"), money["budget_max"].alias("budget_max")]
    for name, words in (("announcement", announced), ("bid_start", starts), ("bid_deadline", deadline)):
        date = date_near(text, words)
        out += [F.when(has(after) | ~has(before), date).alias(f"{name}_after"), F.when(~has(after), date).alias(f"{name}_before")]
    return out


def organizations(names: DataFrame, column: str) -> DataFrame:
    """Distinct names that aren't blank, the longest first."""
    own = names.select(F.trim(F.col(column)).alias("organization")).filter("organization != ''").distinct()
    return own.withColumn("length", F.length("organization"))


def find_organizations(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Names that occur in a query's text, inside words too, and aren't part of a longer name that does. queries: query_id, text.

    A piece of a text is taken where a name's first two characters stand, as long as the names are that begin so, and meets
    names by equality: nothing is compared with everything. Case doesn't count; null and blank texts and names find nothing.
    """
    known = names.filter(F.trim("organization") != "").select("organization", F.lower("organization").alias("piece")).distinct()
    head = lambda c, at: F.substring(c, at, 2)
    heads = known.filter(F.length("piece") > 1).groupBy(head(F.col("piece"), 1).alias("_head")).agg(F.collect_set(F.length("piece")).alias("_lengths"))
    letters = known.filter(F.length("piece") == 1).agg(F.collect_set("piece").alias("_letters"))  # one row: names of one character
    texts = queries.filter(F.trim("text") != "").select("query_id", F.lower("text").alias("_low"))
    placed = texts.select("query_id", "_low", F.explode(F.sequence(F.lit(1), F.length("_low"))).alias("_at")).withColumn("_head", head(F.col("_low"), F.col("_at")))
    begun = placed.join(F.broadcast(heads), "_head").select("query_id", "_low", "_at", F.explode("_lengths").alias("_n"))
    pieces = begun.select("query_id", F.substring("_low", F.col("_at"), F.col("_n")).alias("piece"))
    single = texts.crossJoin(F.broadcast(letters)).select("query_id", F.explode(F.filter("_letters", lambda c: F.contains("_low", c))).alias("piece"))
    asked = pieces.unionAll(single)
    found = asked.join(known, "piece").select("query_id", "organization").distinct()
    longer = found.select(F.col("query_id").alias("q"), F.col("organization").alias("o"))
    inside = (F.col("query_id") == F.col("q")) & (F.length("o") > F.length("organization")) & F.contains(F.lower("o"), F.lower("organization"))
    return found.join(longer, inside, "left_anti")


def from_queries(queries: DataFrame, names: DataFrame, **words) -> DataFrame:
    """All that the texts of queries give: query_id, organization (names that occur, the longest first; null without any)
    and the columns of from_text. queries: query_id, text; names: organization."""
    longest = F.array_sort(F.collect_set(F.struct((-F.length("organization")).alias("n"), "organization")))
    found = find_organizations(queries, names).groupBy("query_id").agg(F.transform(longest, lambda x: x["organization"]).alias("organization"))
    rest = from_text(F.col("text"), **words)
    return queries.select("query_id", *rest).join(found, "query_id", "left").select("query_id", "organization", *FIELDS[1:9])


FIELDS = tuple(f.name for f in fields(MetadataFilter))


def merged_columns(own: str, other: str) -> list[Column]:
    """Filters of many queries merged: fields of the structs own and other; own wins, organizations are joined in order."""
    none = F.array().cast("array<string>")
    orgs = F.array_distinct(F.concat(F.coalesce(F.col(f"{own}.organization"), none), F.coalesce(F.col(f"{other}.organization"), none)))
    return [F.when(F.size(orgs) > 0, orgs).alias("organization"), *(F.coalesce(f"{own}.{f}", f"{other}.{f}").alias(f) for f in FIELDS[1:])]
