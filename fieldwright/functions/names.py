"""Field and standard names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .domain import date_kind
from .enums import pairs
from .text import col, strip_ws
from .vocab import DATETIME, FLAG, NO, SUFFIX_SYNONYMS, YES


def name_variants(name: Column | str, groups: list[list[str]] = SUFFIX_SYNONYMS) -> Column:
    """The name, then one variant for each other member of the group of its longest listed suffix."""
    name = col(name)
    by_length = sorted(((s, g) for g in groups for s in g), key=lambda x: -len(x[0]))
    out = F.array(name)
    for suffix, group in reversed(by_length):
        stem = F.substring(name, F.lit(1), F.length(name) - len(suffix))
        out = F.when(name.endswith(suffix), F.array(name, *[F.concat(stem, F.lit(m)) for m in group if m != suffix])).otherwise(out)
    return out


def enum_names(name: Column, english: Column, physical: Column) -> Column:
    """struct(name, english, physical): names of enum standards end in 代码; where that is added, the English name gets CODE and
    the physical one _CD, 24 characters at most, unless they have them."""
    fix = ~F.coalesce(name, F.lit("")).endswith("代码")
    en, ph = F.coalesce(english, F.lit("")), F.coalesce(physical, F.lit(""))
    en = F.when(F.upper(F.rtrim(en)).endswith("CODE"), en).otherwise(F.trim(F.concat(F.rtrim(en), F.lit(" CODE"))))
    ph = F.when(F.upper(ph).endswith("CD"), ph).otherwise(F.substring(F.concat(F.regexp_replace(ph, "_+$", ""), F.lit("_CD")), 1, 24))
    return F.struct(
        F.when(fix, F.concat(F.coalesce(name, F.lit("")), F.lit("代码"))).otherwise(name).alias("name"),
        F.when(fix, en).otherwise(english).alias("english"), F.when(fix, ph).otherwise(physical).alias("physical"),
    )


def is_indicator(name: Column | str, caliber: Column | str) -> Column:
    """A statistic: its name has a statistical word and its caliber tells a source, filter or time window."""
    return F.coalesce(col(name).rlike("率|数|笔数|额|值|均值|占比") & col(caliber).rlike("取.*表|大于|小于|等于|统计|筛选|判断|减.*天|近.*[天日月年]"), F.lit(False))


def datetime_name(name: Column | str, kind: Column) -> Column:
    """The name with the suffix of its kind: 日期, 时间 or 时间戳 at the end is exchanged, else it is added."""
    return F.concat(F.regexp_replace(col(name), "(日期|时间戳|时间)$", ""), kind)


def clean_name(name: Column | str) -> Column:
    """struct(name, changed): without serial tails such as KEY值5 or 5 and without Latin residue at its ends; a name of which nothing
    would remain stays."""
    s = strip_ws(name)
    short = F.regexp_replace(F.regexp_replace(s, r"(?i)(KEY)?值?[0-9]+$|KEY值?[0-9]*$", ""), r"^[A-Za-z0-9_\-.]+|[A-Za-z0-9_\-.]+$", "")
    out = F.when(strip_ws(short) == "", s).otherwise(strip_ws(short))
    return F.struct(out.alias("name"), (out != s).alias("changed"))


def needs_flag_rename(field_type: Column | str, enum_values: Column | str) -> Column:
    """Flags whose values are there and are not exactly 是 and 否."""
    seen = F.array_distinct(F.filter(F.transform(pairs(enum_values), lambda p: p["value"]), lambda x: x != ""))
    yes_no = (F.size(seen) == 2) & F.array_contains(seen, YES) & F.array_contains(seen, NO)
    return (col(field_type) == FLAG) & (F.size(seen) > 0) & ~yes_no


def needs_datetime_rename(field_type: Column | str, name: Column | str, sample: Column | str) -> Column:
    kind = date_kind(sample)
    return F.coalesce((col(field_type) == DATETIME) & kind.isNotNull() & ~col(name).endswith(kind), F.lit(False))
