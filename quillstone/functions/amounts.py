"""Amounts and dates in text as Column functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def parse_amount(cell: Column, currency: str = fixed.CURRENCY) -> Column:
    """A table cell as a double: commas and the currency word go; blank, unreadable and NaN cells are null."""
    value = F.regexp_replace(F.trim(cell), f",|{re.escape(currency)}", "").try_cast("double")
    return F.when(~F.isnan(value), value)


def _units(units: dict[str, float]) -> str:
    return "|".join(sorted(units, key=len, reverse=True))


def compound_amount(text: Column, units: dict[str, float] = fixed.MONEY_UNITS) -> Column:
    """The sum of number times unit over a text; 0 where there is none."""
    pattern = rf"(\d+(?:\.\d+)?)\s*({_units(units)})"
    numbers, names = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    value = lambda n, u: n.cast("double") * reduce(lambda rest, x: F.when(u == x[0], x[1]).otherwise(rest), units.items(), F.lit(0.0))
    return F.coalesce(F.aggregate(F.zip_with(numbers, names, value), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def amount_bounds(text: Column, units=fixed.MONEY_UNITS, between=fixed.RANGE_WORDS, at_least=fixed.AT_LEAST, at_most=fixed.AT_MOST, currency: str = fixed.CURRENCY) -> Column:
    """struct<budget_min, budget_max>. A range decides alone; else each bound by itself. The currency word is optional."""
    money = rf"((?:\d+(?:\.\d+)?\s*(?:{_units(units)})\s*)+)(?:{re.escape(currency)})?\s*"
    words = lambda ws: "(?:" + "|".join(map(re.escape, ws)) + ")"
    ranged = rf"{money}{words(between)}\s*{money}"
    read = lambda pattern, i: F.nullif(compound_amount(F.regexp_extract(text, pattern, i), units), F.lit(0.0))
    a, b = read(ranged, 1), read(ranged, 2)
    both = a.isNotNull() & b.isNotNull()
    low, high = read(money + words(at_least), 1), read(money + words(at_most), 1)
    return F.struct(F.when(both, F.least(a, b)).otherwise(low).alias("budget_min"), F.when(both, F.greatest(a, b)).otherwise(high).alias("budget_max"))


DATE = r"(\d{4})\s*(?:년|[-./])\s*(?:(\d{1,2})\s*(?:월|[-./])\s*)?(?:(\d{1,2})\s*일?)?"


def date_near(text: Column, keywords: list[str], window: tuple[int, int] = fixed.DATE_WINDOW) -> Column:
    """The first date around the first keyword that has one: Y, Y-M or Y-M-D."""

    def around(word: str) -> Column:
        at = F.instr(text, word)
        start = F.greatest(at - window[0], F.lit(1))
        part = F.when(at > 0, F.substring(text, start, at + window[1] - start))
        y, m, d = (F.nullif(F.regexp_extract(part, DATE, i), F.lit("")) for i in (1, 2, 3))
        month = F.concat(y, F.lit("-"), F.lpad(m, 2, "0"))
        return F.coalesce(F.concat(month, F.lit("-"), F.lpad(d, 2, "0")), month, y)

    return F.coalesce(*map(around, keywords))


def date_bounds(text: Column) -> Column:
    """struct<starts, ends>: first and last second of a day, month or year; null for what is no date."""
    part = lambda i: F.try_element_at(F.split(text, "-"), F.lit(i)).try_cast("int")
    y, m, d = part(1), part(2), part(3)
    first = F.try_make_timestamp_ntz(y, F.coalesce(m, F.lit(1)), F.coalesce(d, F.lit(1)), F.lit(0), F.lit(0), F.lit(0))
    last_month = F.try_make_timestamp_ntz(y, F.coalesce(m, F.lit(12)), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    day = F.when(d.isNotNull(), first.cast("date")).otherwise(F.last_day(last_month.cast("date")))
    show = lambda c: F.date_format(c, "yyyy-MM-dd")
    return F.struct(F.concat(show(first), F.lit("T00:00:00Z")).alias("starts"), F.concat(show(day), F.lit("T23:59:59Z")).alias("ends"))


def format_amount(value: Column) -> Column:
    """An amount in large units, with the plain number behind it."""
    n = value.cast("long")
    plain = F.concat(F.format_number(n, 0), F.lit("원"))
    eok, rest, man = F.floor(n / 100_000_000), n % 100_000_000, F.floor(n / 10_000)
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts), F.lit(" ("), plain, F.lit(")"))
    large = F.when(rest >= 10_000_000, text(eok, "억 ", F.floor(rest / 10_000_000), "천만원")).otherwise(text(eok, "억원"))
    return F.coalesce(F.when(n >= 100_000_000, large).when(n >= 10_000, text(man, "만원")).otherwise(plain), F.lit("N/A"))
