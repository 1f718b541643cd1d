"""Columns on semantic IDs, predictions, histories and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"<[abc]_\d+>"


def parts(sid: Column) -> Column:
    """The three tokens of a SID in angle or slash form; null where it is neither."""
    angle = F.when(sid.rlike(rf"^({TOKEN}){{3}}\z"), F.regexp_extract_all(sid, F.lit(TOKEN), F.lit(0)))
    split = F.split(sid, "/")
    slash = F.when((F.size(split) == 3) & ~F.exists(split, lambda p: p == ""), split)
    return F.when(sid.startswith("<"), angle).otherwise(slash)


def is_valid(sid: Column) -> Column:
    return F.coalesce(parts(sid).isNotNull(), F.lit(False))


def tokens(sid: Column) -> Column:
    """Angle tokens in order; empty where there are none."""
    return F.coalesce(F.regexp_extract_all(sid, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def join_tokens(token_array: Column) -> Column:
    return F.array_join(token_array, "")


def prefix(sid: Column, level: int) -> Column:
    return F.array_join(F.slice(tokens(sid), 1, level), "")


def code(sid: Column, level: str) -> Column:
    """The number of the last token of a level (a, b or c), or null."""
    found = F.regexp_extract_all(sid, F.lit(rf"<{level}_(\d+)>"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).cast("int")


def level1(sid: Column) -> Column:
    return F.regexp_extract(sid, r"<a_(\d+)>", 1)


def level2(sid: Column) -> Column:
    return F.concat(level1(sid), F.lit("_"), F.regexp_extract(sid, r"<b_(\d+)>", 1))


def level1_text(sid: Column) -> Column:
    return F.substring_index(sid, "<b_", 1)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize(x: Column) -> Column:
    """A prediction's text without white space and double quotes around it."""
    return strip(F.regexp_replace(strip(x), '^"+|"+$', ""))


def parse_ids(raw: Column) -> Column:
    """All runs of digits as numbers; null gives none."""
    return F.transform(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))


def parse_id_list(raw: Column) -> Column:
    """Comma-separated texts in one pair of brackets, without quotes; blanks go."""
    inner = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"^\[|\]$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), r"^['\"]+|['\"]+$", "")), lambda x: x != "")


def parse_sid_list(raw: Column) -> Column:
    """Texts in single quotes, else tokens three at a time."""
    quoted = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit("'([^']*)'"), F.lit(1))
    found = tokens(F.coalesce(raw, F.lit("")))
    threes = F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(3)), lambda i: F.array_join(F.slice(found, i, 3), ""))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(quoted) > 0, quoted).otherwise(threes)


def parse_history(raw: Column) -> Column:
    """A list literal as texts; what is none gives the empty list."""
    return F.when(F.trim(raw).rlike(r"^[\[(].*[\])]$"), parse_id_list(F.translate(F.trim(raw), "()", "[]"))).otherwise(F.array().cast("array<string>"))


def list_literal(x: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(x, lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", "), F.lit("]"))


def target_of(output: Column) -> Column:
    """`output` as text: itself, or the head of a JSON list, or "" for an empty list."""
    found = F.from_json(output, "array<string>")
    return F.when(output.startswith("["), F.coalesce(F.get(found, F.lit(0)), F.lit(""))).otherwise(output)


def product_key(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"(?U)[\s\x00-\x1f]+", " "))


def title_tokens(title: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(title), "[^a-z0-9]+"), lambda x: F.length(x) >= 3))


def jaccard(a: Column, b: Column) -> Column:
    """0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
