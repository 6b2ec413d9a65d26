"""Domain types: reading them, and judging a sample by them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, strip_ws
from .vocab import BAD_CHARACTER, NO_SAMPLE

_FAMILY = r"^(anc|an|ac|nc|n|a|c)(\.\.|!)\(([0-9]*)\)$"
_NUMBER = r"^i\(([0-9]+)(,\s*([0-9]+))?\)$"


def parse_domain(c: Column | str) -> Column:
    """struct(key, x, y) of a domain type, null if it is none. x: length or digits before the point, y: digits after it."""
    def parts(s: Column) -> Column:
        names = [(_FAMILY, "family"), (_FAMILY, "kind"), (_FAMILY, "size"), (_NUMBER, "digits"), (_NUMBER, "rest"), (_NUMBER, "places")]
        return F.struct(*[F.regexp_extract(s, pattern, 1 + k % 3).alias(name) for k, (pattern, name) in enumerate(names)], F.lower(s).alias("low"))

    def read(m: Column) -> Column:
        key = (
            F.when((m["family"] != "") & (m["kind"] == "!") & (m["size"] != ""), F.concat(m["family"], F.lit("_fix")))
            .when((m["family"] != "") & (m["kind"] == "..") & (m["size"] != ""), F.concat(m["family"], F.lit("_var")))
            .when((m["family"] != "") & (m["kind"] == ".."), F.concat(m["family"], F.lit("_var_nolimit")))
            .when((m["digits"] != "") & (m["rest"] == ""), F.lit("i_int"))
            .when(m["digits"] != "", F.lit("i_dec"))
            .when(m["low"].isin("date", "time", "datetime", "timestamp"), m["low"])
        )
        number = lambda x: F.when(x != "", x).cast("long")
        return let(key, lambda k: F.when(k.isNotNull(), F.struct(k.alias("key"), F.coalesce(number(m["size"]), number(m["digits"])).alias("x"), number(m["places"]).alias("y"))))

    return let(strip_ws(c), lambda s: let(parts(s), read))


def char_class(key: Column) -> Column:
    """Domain key -> character class: the family before the underscore, i for numbers."""
    return F.split_part(key, F.lit("_"), F.lit(1))


def char_fault(sample: Column, key: Column) -> Column:
    """The message on the first character that the domain's class does not allow; null if there is none."""
    kind, out = char_class(key), F.lit(None).cast("string")
    for name, (pattern, before, after) in BAD_CHARACTER.items():
        bad = F.regexp_extract(sample, pattern, 0)
        out = F.when((kind == name) & (bad != ""), F.concat(F.lit(before), bad, F.lit(after))).otherwise(out)
    return out


def _size(n: Column) -> Column:
    return n.cast("string")


def length_fault(sample: Column, domain: Column) -> Column:
    """The message on a sample too long, too short or ill-formed for its domain; null if there is none."""
    key, x, y, n = domain["key"], domain["x"], domain["y"], F.length(sample)
    text = F.when(
        key.endswith("_fix") & (n != x), F.concat(F.lit("长度应为"), _size(x), F.lit("位，实际"), _size(n), F.lit("位"))
    ).when(key.endswith("_var") & (n > x), F.concat(F.lit("长度超过最大限制"), _size(x), F.lit("位，实际"), _size(n), F.lit("位")))

    dot = F.instr(sample, ".") > 0
    whole = F.regexp_replace(F.split_part(sample, F.lit("."), F.lit(1)), r"^[+-]+", "")
    places = F.length(sample) - F.instr(sample, ".")
    too_big = F.concat(F.lit("整数部分不得超过"), _size(x), F.lit("位，实际"), _size(F.length(whole)), F.lit("位"))
    number = (
        F.when((key == "i_int") & dot, F.concat(F.lit("i("), _size(x), F.lit(")为整数类型，数据示例不应包含小数点")))
        .when(whole == "", "数据示例不是有效的数值")
        .when(F.length(whole) > x, too_big)
        .when((key == "i_dec") & dot & (places > y), F.concat(F.lit("小数部分不得超过"), _size(y), F.lit("位，实际"), _size(places), F.lit("位")))
    )

    digits = F.translate(sample, "-:/ T", "")
    main = F.split_part(digits, F.lit("."), F.lit(1))
    fraction = F.substring(digits, F.length(main) + 2, F.length(digits))
    broken = F.when((F.instr(digits, ".") > 0) & ~fraction.rlike("^[0-9]+$"), F.concat(F.lit("毫秒部分应为纯数字，实际'"), fraction, F.lit("'")))
    m, name = F.length(main), F.upper(key)
    date = F.when(~F.length(digits).between(6, 8), F.concat(F.lit("DATE应为6-8位日期数字（YYYYMMDD），实际"), _size(F.length(digits)), F.lit("位")))
    time = F.when(~m.between(3, 6), F.concat(F.lit("TIME应为3-6位时间数字（HHMMSS），实际"), _size(m), F.lit("位"))).otherwise(broken)
    moment = (
        F.when(m == 8, F.concat(name, F.lit("应为日期时间格式（YYYYMMDDHHmmss，14位），数据示例仅包含日期部分")))
        .when(~m.between(9, 14), F.concat(name, F.lit("应为9-14位日期时间数字（YYYYMMDDHHmmss），实际"), _size(m), F.lit("位")))
        .otherwise(broken)
    )
    return (
        F.when(key.isin("i_int", "i_dec"), number).when(key == "date", date).when(key == "time", time)
        .when(key.isin("datetime", "timestamp"), moment).otherwise(text)
    )


def _fault(sample: Column, domain: Column) -> Column:
    """sample stripped, domain parsed, each given as a value that is read once."""
    return F.when(
        domain.isNotNull() & (F.coalesce(sample, F.lit("")) != "") & ~sample.isin(NO_SAMPLE), F.coalesce(char_fault(sample, domain["key"]), length_fault(sample, domain))
    )


def sample_fault(domain_type: Column | str, sample: Column | str) -> Column:
    """Why a sample breaks its domain type; null if it does not, if it is a placeholder, or if the type is unreadable."""
    both = F.struct(parse_domain(domain_type).alias("d"), strip_ws(sample).alias("s"))
    return let(both, lambda v: let(v["d"], lambda d: _fault(v["s"], d)))


def date_kind(sample: Column | str) -> Column:
    """日期, 时间 or 时间戳: the first of DATE, TIME and DATETIME that a sample satisfies; null for none or a placeholder."""
    def kind(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for domain, name in (("datetime", "时间戳"), ("time", "时间"), ("date", "日期")):
            read = F.struct(F.lit(domain).alias("key"), F.lit(None).cast("long").alias("x"), F.lit(None).cast("long").alias("y"))
            out = F.when(_fault(s, read).isNull(), name).otherwise(out)
        return F.when((F.coalesce(s, F.lit("")) != "") & ~s.isin(NO_SAMPLE), out)

    return let(strip_ws(sample), kind)


def domain_conflict(domain_type: Column | str, sample: Column | str) -> Column:
    """Whether a candidate's domain type rules the sample out; a blank side never does."""
    return (F.coalesce(strip_ws(col(domain_type)), F.lit("")) != "") & sample_fault(domain_type, sample).isNotNull()
