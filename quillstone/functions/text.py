"""Strings, names, hashes and templates as Column functions. Everything stays in the JVM unless a name says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .udfs import normal_form


def squeezed(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def compact(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def token_set(text: Column, pattern: str = fixed.TOKEN, stop: list[str] = fixed.STOPWORDS) -> Column:
    """Distinct lower-case tokens, in order, without stop words."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1))
    return F.array_except(F.array_distinct(F.transform(found, F.lower)), F.array(*map(F.lit, stop)))


def token_hash(token: Column) -> Column:
    """The first four bytes of the MD5 digest as a number."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long")


def point_id(name: Column) -> Column:
    """The name-based UUID (version 5, DNS name space) of a chunk id."""
    digest = F.sha1(F.concat(F.unhex(F.lit(fixed.NAMESPACE_DNS)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    part = lambda s, n: F.substring(digest, s, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def url_basename(name: Column) -> Column:
    """The bare file name of a URL or path; a plus sign stays one."""
    trimmed = F.trim(name)
    path = F.when(trimmed.rlike("^(?i)(https?|file)://"), F.regexp_extract(trimmed, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)).otherwise(trimmed)
    path = F.when(F.length(path) > 0, path).otherwise(trimmed)
    plain = F.coalesce(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), path)
    return F.coalesce(F.trim(F.element_at(F.split(F.rtrim(F.regexp_replace(plain, r"\\", "/"), F.lit("/")), "/"), -1)), F.lit(""))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def name_key(name: Column) -> Column:
    """What names are compared by: composed (NFC), no extension, case, spaces or punctuation. Python makes the normal form."""
    bare = normal_form(F.regexp_replace(name, r"(?i)\.(pdf|hwp|hwpx)$", ""), "NFC", fold=True)
    return F.regexp_replace(bare, r"(?U)[\s_\-&()\[\]{}.,·ㆍ]", "")


def without_copy_suffix(name: Column) -> Column:
    """A trailing ' (n)' before the extension goes, before punctuation does."""
    return F.regexp_replace(name, r"(?i)\s*\(\d+\)(?=(\.(pdf|hwp|hwpx))?$)", "")


def copy_suffix_key(name: Column) -> Column:
    return name_key(without_copy_suffix(name))


def strip_control(text: Column) -> Column:
    """Without CJK ideographs and without characters of the control categories, line ends included."""
    return F.regexp_replace(F.regexp_replace(text, "[一-鿿]+", ""), r"\p{C}", "")


def snippet(text: Column, limit: int = 280) -> Column:
    plain = squeezed(F.coalesce(text, F.lit("")))
    return F.when(F.length(plain) > limit, F.concat(F.rtrim(F.substring(plain, 1, limit)), F.lit("..."))).otherwise(plain)


def trim_text(text: Column, limit: int = 1800) -> Column:
    """Two thirds of the limit from the head and the rest from the tail of what is too long."""
    plain = squeezed(F.coalesce(text, F.lit("")))
    if limit <= 0:
        return plain
    head = limit * 2 // 3
    return F.when(F.length(plain) > limit, F.concat(F.substring(plain, 1, head), F.lit(" ... "), F.right(plain, F.lit(limit - head)))).otherwise(plain)


def fields_text(fields: list[tuple[str, Column]]) -> Column:
    """'name: value' lines of the fields that are neither null nor blank."""
    line = lambda name, value: F.when(F.length(F.trim(value.cast("string"))) > 0, F.concat(F.lit(f"{name}: "), value.cast("string")))
    return F.concat_ws("\n", *(line(n, v) for n, v in fields))


def labelled_text(fields: list[tuple[str, Column]], null: str = "") -> Column:
    """'label: value' lines of all fields; null: what stands for missing values."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{n}: "), F.coalesce(v.cast("string"), F.lit(null))) for n, v in fields))


def extract_values(text: Column) -> Column:
    """Dates, requirement ids and numbers with units, in that order, compact, each once."""
    plain = squeezed(F.coalesce(text, F.lit("")))
    found = [F.regexp_extract_all(plain, F.lit(f"({p})"), F.lit(1)) for p in (fixed.DATE_VALUE, fixed.REQUIREMENT_ID, f"(?i){fixed.NUMBER_VALUE}")]
    return F.array_distinct(F.filter(F.transform(F.concat(*found), lambda v: F.replace(compact(v), F.lit(","), F.lit(""))), lambda v: v != ""))


def find_pages(text: Column) -> Column:
    """Page numbers that a text cites, each once."""
    found = [F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?iU){p}"), F.lit(1)), lambda x: F.try_to_number(x, F.lit("9999999999")).cast("int")) for p in fixed.PAGES]
    return F.array_distinct(F.filter(F.concat(*found), lambda x: x.isNotNull()))


def find_chunk_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({fixed.CHUNK_ID})"), F.lit(1)))


def not_found(text: Column, pattern: str = fixed.NOT_FOUND) -> Column:
    return squeezed(F.coalesce(text, F.lit(""))).rlike(f"(?i){pattern}")


def page_match(page: Column, cited: Column) -> Column:
    """Pages count from 0 in chunks and from 1 in many answers: either may be cited."""
    return F.coalesce(F.arrays_overlap(F.array(page, page + 1), cited), F.lit(False))


def lexical_score(query_tokens: Column, text_tokens: Column) -> Column:
    """The part of the query's tokens that the text has; 0 without tokens."""
    return F.when(F.size(query_tokens) > 0, F.size(F.array_intersect(query_tokens, text_tokens)) / F.size(query_tokens)).otherwise(0.0)


def missing_values(values: Column, evidence: Column) -> Column:
    whole = F.replace(compact(evidence), F.lit(","), F.lit(""))
    return F.filter(values, lambda v: ~F.contains(whole, v))


def value_score(values: Column, evidence: Column) -> Column:
    """The part of the values that the evidence holds; 1 without values."""
    return F.when(F.size(values) > 0, 1 - F.size(missing_values(values, evidence)) / F.size(values)).otherwise(1.0)


def ambiguous(text: Column, markers: list[str] = fixed.AMBIGUOUS) -> Column:
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")
    return reduce(lambda a, b: a | b, (F.contains(plain, F.lit("".join(m.split()))) for m in markers))


def final_answer(text: Column, marker: str = "▶\\s*답변\\s*:", tails: tuple[str, ...] = ("\\n*\\[출처", "\\n*\\*\\*출처 상세\\*\\*")) -> Column:
    """What follows the answer marker, without the list of sources; all of it where the marker is missing or nothing follows."""
    whole = F.coalesce(text, F.lit(""))
    after = F.trim(F.regexp_extract(whole, f"(?s){marker}(.*)", 1))
    cut = F.trim(F.regexp_replace(after, f"(?s)(?:{'|'.join(tails)}).*$", ""))
    return F.when(whole.rlike(f"(?s){marker}"), F.when(cut != "", cut).otherwise(whole)).otherwise(F.trim(whole))


def reply_type(text: Column, kinds: list[str]) -> Column:
    """The type that a model's JSON reply names, code fence or not; unknown if it can't be read."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```(?:json)?", ""))
    kind = F.lower(F.trim(F.get_json_object(bare, "$.type")))
    return F.when(kind.isin(kinds), kind).otherwise(F.lit(fixed.UNKNOWN))


def table_markdown(rows: Column) -> Column:
    """array<array<string>> to a Markdown table whose first row is the head; null cells are blank."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.element_at(rows, 1))))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(F.element_at(rows, 1)), rule), body), "\n")).otherwise("")


def reading_order(boxes: Column, height: int = 10) -> Column:
    """Texts of array<struct<x, y, text>> line by line (y in steps of height), then from left to right."""
    keyed = F.transform(boxes, lambda b: F.struct(F.floor(b["y"] / height).alias("row"), b["x"].alias("x"), b["text"].alias("text")))
    return F.transform(F.array_sort(keyed), lambda b: b["text"])
