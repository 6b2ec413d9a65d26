"""Text helpers as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import NULL_CELLS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value computed once a row however often body uses it: a plain Column would be copied to each use."""
    return F.transform(F.array(value), body)[0]


def strip_ws(c: Column | str) -> Column:
    """Without white space at the ends; U+3000 and line ends count as white space, which trim() leaves."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def clean_cell(c: Column | str, null_cells: list[str] = NULL_CELLS) -> Column:
    """Null and the words for it become empty; the rest is stripped."""
    s = strip_ws(F.coalesce(col(c).cast("string"), F.lit("")))
    return F.when(F.lower(s).isin(null_cells), "").otherwise(s)


def blank(c: Column | str) -> Column:
    return F.coalesce(strip_ws(c) == "", F.lit(True))


def numbered(items: Column | str) -> Column:
    """1. first, 2. second, ... one a line."""
    return F.array_join(F.transform(col(items), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def utf8_cut(c: Column | str, most: int) -> Column:
    """At most so many UTF-8 bytes; a character split by the cut is dropped."""
    c = col(c)
    head = F.make_valid_utf8(F.substring(c.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(c) <= most, c).otherwise(F.regexp_replace(head, "�+$", ""))


def token_estimate(c: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(col(c)) / 2).cast("int"))


def json_array(c: Column | str, schema: str) -> Column:
    """The outermost [...] of a model's answer, a code fence around it removed, read by an array schema."""
    bare = F.regexp_replace(col(c), r"```(?:json)?", "")
    return F.from_json(F.regexp_extract(bare, r"(?s)\[.*\]", 0), schema)
