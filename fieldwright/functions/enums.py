"""Enum lists written as code-value;code-value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, strip_ws
from .vocab import COMPLEMENTARY, NOT_COMPLEMENTARY

#: Three tests of whether a rule cites an outside standard, each with its own use.
CITED_IN_PAIR = "[《》]|GB/T|GBT"
CITED_IN_RULE = "参考|参照|参见|《.*》|GB/?T|JR/T|行标|国标"
CITED_IN_DETAIL = "参考|参照|参见|《.*》|GB/?T|JR/T"


def items(c: Column | str) -> Column:
    """The parts between semicolons, stripped, blank ones dropped. Null gives none."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), ";"), strip_ws)
    return F.filter(parts, lambda x: x != "")


def pair_of(item: Column) -> Column:
    """struct(code, value), cut at the first hyphen; without one the code is empty."""
    at = F.instr(item, "-")
    return F.struct(
        F.when(at > 0, strip_ws(F.substring(item, F.lit(1), at - 1))).otherwise("").alias("code"),
        F.when(at > 0, strip_ws(F.substring(item, at + 1, F.length(item)))).otherwise(item).alias("value"),
    )


def pairs(c: Column | str) -> Column:
    return F.transform(items(c), pair_of)


def valid_pairs(c: Column | str) -> Column:
    return F.filter(pairs(c), lambda p: (p["code"] != "") & ~p["code"].rlike(CITED_IN_PAIR) & ~p["value"].rlike(CITED_IN_PAIR))


def item_count(c: Column | str) -> Column:
    return F.size(items(c))


def values(c: Column | str) -> Column:
    return F.transform(pairs(c), lambda p: p["value"])


def repeated(parts: Column) -> Column:
    """The non-empty texts that stand in the array more than once, in order of first appearance."""
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & (F.size(F.filter(parts, lambda y: y == x)) > 1)))


#: A digits-mark-name part of a rule text, and the code of an item.
RULE_PART = r"(\d+)\s*[-—、,，:：]\s*([^\d;,，\n；]+)"
ITEM_CODE = r"(?:^|;)([^\s;-]+)-"


def tidy_rule(c: Column | str) -> Column:
    """A rule text as code-name;code-name if it holds at least two digits-mark-name parts; as it is if it cites a standard; else null."""
    s = strip_ws(c)
    codes, names = F.regexp_extract_all(s, F.lit(RULE_PART), F.lit(1)), F.regexp_extract_all(s, F.lit(RULE_PART), F.lit(2))
    joined = F.array_join(F.zip_with(codes, names, lambda a, b: F.concat(a, F.lit("-"), strip_ws(b))), ";")
    return F.when(s.rlike(CITED_IN_RULE), s).when(F.size(codes) >= 2, joined)


def strict_detail(c: Column | str) -> Column:
    """(code, value) pairs of a rule, none if it cites a standard; both sides must be there, -- is no code."""
    s = strip_ws(c)
    parts = F.transform(F.split(F.coalesce(s, F.lit("")), "[;；]"), lambda x: F.regexp_replace(strip_ws(x), "[、，,]+$", ""))
    found = F.transform(F.filter(parts, lambda x: F.instr(x, "-") > 0), pair_of)
    kept = F.filter(found, lambda p: (p["code"] != "") & (p["value"] != "") & (p["code"] != "--"))
    return F.when(F.coalesce(s.rlike(CITED_IN_DETAIL), F.lit(False)), F.filter(kept, lambda p: F.lit(False))).otherwise(kept)


def loose_detail(c: Column | str) -> Column:
    """As strict_detail, cut at semicolons, or at full-width commas where there is none; only 参考 and 《 count as a citation."""
    s = F.coalesce(col(c), F.lit(""))
    parts = F.when(F.instr(s, ";") > 0, F.split(s, ";")).otherwise(F.split(s, "，"))
    found = F.transform(F.filter(F.transform(parts, strip_ws), lambda x: F.instr(x, "-") > 0), pair_of)
    kept = F.filter(found, lambda p: (p["code"] != "") & (p["value"] != ""))
    return F.when(s.rlike("参考|《"), F.filter(kept, lambda p: F.lit(False))).otherwise(kept)


def enum_domain_type(rule: Column | str) -> Column:
    """an..(n): n the longest code, 2 at least and by default, 20 for a cited standard."""
    r = F.coalesce(col(rule), F.lit(""))
    longest = F.array_max(F.transform(F.regexp_extract_all(r, F.lit(ITEM_CODE), F.lit(1)), F.length))
    return F.when(r.rlike("参考|《"), "an..(20)").otherwise(F.concat(F.lit("an..("), F.greatest(F.coalesce(longest, F.lit(2)), F.lit(2)).cast("string"), F.lit(")")))


def normalised(c: Column | str) -> Column:
    """struct(has_codes, needs_normalization, normalized): the written rules for enum lists, as far as patterns carry them.

    Items are cut at ; ； , ， | and line ends; where none of these stands, also before a new code that follows white space. Codes
    are letters and digits, in brackets or not, before - : ： = or bracketed; a list whose items all end in -CODE is turned
    round. normalized is filled only if the list has codes and is not written as code-value;code-value already.
    """
    code = r"-?[0-9A-Za-z]+"
    head = rf"(?s)^[(（]?({code})(?:[)）]\s*[-:：=]?|\s*[-:：=])\s*(.+)$"
    tail = r"(?s)^(.*\P{ASCII}.*)-\s*([0-9A-Za-z]+)$"

    def parts(s: Column) -> Column:
        cut_soft = F.regexp_replace(s, rf"(?U)\s+(?=[(（]{code}[)）]|{code}\s*[-:：=])", ";")
        cut = F.when(s.rlike(r"[;；,，|\n]"), F.regexp_replace(s, r"(?U)\s*[;；,，|\n]\s*", ";")).otherwise(cut_soft)
        return F.filter(F.transform(F.split(cut, ";"), strip_ws), lambda x: x != "")

    def read(xs: Column) -> Column:
        ahead, behind = F.forall(xs, lambda x: x.rlike(head)), F.forall(xs, lambda x: x.rlike(tail))
        front = F.transform(xs, lambda x: F.concat(F.regexp_extract(x, head, 1), F.lit("-"), strip_ws(F.regexp_extract(x, head, 2))))
        turned = F.transform(xs, lambda x: F.concat(F.regexp_extract(x, tail, 2), F.lit("-"), strip_ws(F.regexp_extract(x, tail, 1))))
        new = F.when(ahead, front).when(behind, turned)
        return F.struct(F.size(xs).alias("n"), ((F.size(xs) == 0) | ahead | behind).alias("has"), F.array_join(new, ";").alias("new"))

    def judged(v: Column) -> Column:
        has = v["has"]
        needs = (v["n"] > 0) & has & (v["new"] != F.coalesce(col(c), F.lit("")))
        return F.struct(has.alias("has_codes"), needs.alias("needs_normalization"), F.when(needs, v["new"]).otherwise("").alias("normalized"))

    bare = F.regexp_replace(strip_ws(F.coalesce(col(c), F.lit(""))), r"^[:：]\s*(?=-?[0-9A-Za-z]+\s*[-:：=])", "")
    return let(let(let(bare, parts), read), judged)


def complementary(a: Column | str, b: Column | str, default: bool = True) -> Column:
    """Whether two words are the two sides of one switch: listed pairs and negated forms are; listed graded or directional
    opposites are not; for the rest the default, which leans to yes as the written rule does."""
    a, b = strip_ws(a), strip_ws(b)

    def listed(pairs_: list[tuple[str, str]]) -> Column:
        out = F.lit(False)
        for x, y in pairs_:
            out = out | ((a == x) & (b == y)) | ((a == y) & (b == x))
        return out

    negated = F.lit(False)
    for no in ("不", "未", "无"):
        negated = negated | (a == F.concat(F.lit(no), b)) | (b == F.concat(F.lit(no), a))
    return F.when(listed(COMPLEMENTARY) | negated, True).when(listed(NOT_COMPLEMENTARY), False).otherwise(default)
