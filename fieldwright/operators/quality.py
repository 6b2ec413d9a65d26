"""The quality check of an application sheet: rules, consistency, verdicts and soft notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import enums
from ..functions.domain import parse_domain, sample_fault
from ..functions.text import blank, col, let, numbered, strip_ws
from ..functions.vocab import (
    CLASSES, ENUM, ENUM_LIKE, FAILED, FLAG, KEY_ITEMS, NO, NO_ENUM_MARKS, NOTHING, NOTHING_COLUMNS, PASSED, REQUIRED, WHITELIST, YES,
)


def blank_placeholders(sheet: DataFrame) -> DataFrame:
    """Cells that are exactly 无 become empty, but for the table name; so do enum cells that are one of the dash and slash marks."""
    def cell(c: str) -> Column:
        marks = [NOTHING, *(NO_ENUM_MARKS if c == "enum_values" else [])]
        return F.when(F.col(c).isin(marks), "").otherwise(F.col(c)).alias(c)

    return sheet.select(*[cell(c) if c in NOTHING_COLUMNS else F.col(c) for c in sheet.columns])


def required_issue() -> Column:
    missing = F.array_compact(F.array(*[F.when(blank(c), F.lit(label)) for c, label in REQUIRED]))
    return F.when(F.size(missing) > 0, F.concat(F.lit("必填字段为空: "), F.array_join(missing, ", ")))


def name_issue() -> Column:
    return F.when((F.col("field_name") != "") & ~F.col("field_name").rlike("[一-鿿]"), F.concat(F.lit("字段中文名'"), F.col("field_name"), F.lit("'必须包含至少一个中文字符")))


def class_ok() -> Column:
    return F.col("field_type").isin(CLASSES)


def class_issue() -> Column:
    listed = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"
    return F.when(~blank("field_type") & ~class_ok(), F.concat(F.lit("字段所属类型'"), F.col("field_type"), F.lit(f"'不合法，必须是{listed}中的一种")))


def enum_issue() -> Column:
    """Class, is-enum and enum list judged together: at most one issue."""
    given, wants = strip_ws("is_enum"), F.col("field_type").isin(ENUM_LIKE)
    has = ~blank("enum_values")
    expected = F.when(wants, YES).otherwise(NO)
    text = F.concat(
        F.col("field_type"), F.lit("字段的'是否枚举'必须为'"), expected, F.lit("'且"), F.when(wants, "填写").otherwise("不填写"), F.lit("枚举值，实际为'"), given,
        F.lit("'且枚举值"), F.when(has, "不为空").otherwise("为空"),
    )
    return F.when(
        class_ok() & ~blank("is_enum"),
        F.when(~given.isin(YES, NO), F.concat(F.lit("'是否枚举'填写为'"), given, F.lit("'，必须为'是'或'否'"))).when((given != expected) | (has != wants), text),
    )


def domain_issue() -> Column:
    def issue(v: Column) -> Column:
        allowed = F.lit(False)
        for name, keys in WHITELIST.items():
            allowed = allowed | ((F.col("field_type") == name) & v["key"].isin(keys))
        return F.when(v["key"].isNull(), F.concat(F.lit("域类型'"), F.col("domain_type"), F.lit("'格式不合法"))).when(
            ~allowed, F.concat(F.lit("域类型'"), F.col("domain_type"), F.lit("'不允许用于字段所属类型'"), F.col("field_type"), F.lit("'"))
        )

    asked = class_ok() & ~F.col("field_type").isin(ENUM_LIKE) & ~blank("domain_type")
    return F.when(asked, let(F.struct(parse_domain("domain_type")["key"].alias("key")), issue))


def sample_issue() -> Column:
    asked = class_ok() & ~F.col("field_type").isin(ENUM_LIKE) & ~blank("data_example")
    text = lambda v: F.when(v["f"].isNotNull(), F.concat(F.lit("数据示例'"), F.col("data_example"), F.lit("'不符合域类型'"), F.col("domain_type"), F.lit("'的限制: "), v["f"]))
    return F.when(asked, let(F.struct(sample_fault("domain_type", "data_example").alias("f")), text))


def row_issues() -> Column:
    """The issues of a row on its own, in report order."""
    return F.array_compact(F.array(required_issue(), name_issue(), class_issue(), enum_issue(), domain_issue(), sample_issue()))


def duplicate_fields(sheet: DataFrame) -> DataFrame:
    """sheet with is_duplicate: its (table, field) stands in more than one row. Rows with a blank name are no duplicates and stay
    out of the count, so blanks form no hot key. Counts are pre-aggregated; only repeated names are joined back."""
    t, f = strip_ws("table_name").alias("__t"), strip_ws("field_name").alias("__f")
    counted = sheet.where((F.col("table_name") != "") & (F.col("field_name") != "")).groupBy(t, f).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    named = F.when((F.col("table_name") != "") & (F.col("field_name") != ""), strip_ws("field_name"))
    keyed = sheet.withColumn("__k", named).withColumn("__tk", strip_ws("table_name"))
    joined = keyed.join(counted, (F.col("__tk") == F.col("__t")) & (F.col("__k") == F.col("__f")), "left")
    return joined.withColumn("is_duplicate", F.col("__n").isNotNull()).drop("__k", "__tk", "__t", "__f", "__n")


def check_rules(sheet: DataFrame) -> DataFrame:
    """sheet, placeholders blanked, with rule_issues and rule_passed."""
    marked = duplicate_fields(blank_placeholders(sheet).withColumn("rule_issues", row_issues()))
    again = F.concat(F.lit("字段中文名'"), F.col("field_name"), F.lit("'在表'"), F.col("table_name"), F.lit("'中重复"))
    issues = F.when(F.col("is_duplicate"), F.array_append("rule_issues", again)).otherwise(F.col("rule_issues"))
    return marked.withColumn("rule_issues", issues).withColumn("rule_passed", F.size("rule_issues") == 0).drop("is_duplicate")


def consistency_issue(field_type: Column, enum_values: Column, enum_status: Column, has_codes: Column, normalized: Column) -> Column:
    """The issue of an enum list that does not fit its class; null if none, if the result came twice or the list lacks codes."""
    used = F.when(F.coalesce(normalized, F.lit("")) != "", normalized).otherwise(enum_values)
    skip = (F.coalesce(enum_status, F.lit("")) == "duplicate") | (F.coalesce(has_codes, F.lit(True)) == F.lit(False)) | (F.coalesce(enum_values, F.lit("")) == "")

    def issue(seen: Column) -> Column:
        yes_no = (F.size(F.array_distinct(seen)) == 2) & F.array_contains(seen, YES) & F.array_contains(seen, NO)
        return F.when((field_type == ENUM) & yes_no, "代码枚举类字段的枚举值有且仅有'是'和'否'，应申报为标志类").when(
            (field_type == FLAG) & (F.size(seen) > 2), F.concat(F.lit("标志类字段的枚举值超过两项（实际"), F.size(seen).cast("string"), F.lit("项），应申报为代码枚举类"))
        )

    return F.when(~skip, let(enums.values(used), issue))


def add_consistency(rows: DataFrame) -> DataFrame:
    """rows with flag_issues; they carry enum_status, has_codes and normalized of the enum scorer (null where it was not asked)."""
    issue = consistency_issue(F.col("field_type"), F.col("enum_values"), F.col("enum_status"), F.col("has_codes"), F.col("normalized"))
    return rows.withColumn("flag_issues", F.array_compact(F.array(issue)))


def meaning_eligible() -> Column:
    enum_ok = (F.col("enum_values") == "") | F.coalesce(F.col("has_codes"), F.lit(False))
    return (F.col("business_meaning") != "") & F.col("rule_passed") & (F.size("flag_issues") == 0) & enum_ok


def meaning_requests(rows: DataFrame) -> DataFrame:
    """The rows of the meaning check: the definition stands behind the table's name, the enum list normalised where it was."""
    enum = F.when(F.coalesce("normalized", F.lit("")) != "", F.col("normalized")).otherwise(F.col("enum_values"))
    return rows.where(meaning_eligible()).select(
        "row_index", "field_name", "field_type",
        F.when(F.col("table_name") != "", F.concat(F.lit("来自表“"), F.col("table_name"), F.lit("”。"), F.col("business_meaning"))).otherwise(F.col("business_meaning")).alias("business_meaning"),
        enum.alias("enum_values"),
    )


def enum_requests(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("enum_values") != "").select("row_index", "field_name", "enum_values")


def soft_requests(rows: DataFrame) -> dict[str, DataFrame]:
    """class_check and sample: passed rows of other classes than enum and flag; antonym: passed rows of those two with exactly two
    items, both values beside."""
    passed = rows.where(F.col("check_result") == PASSED)
    used = F.when(F.coalesce("normalized_enum", F.lit("")) != "", F.col("normalized_enum")).otherwise(F.col("enum_values"))
    other = passed.where(~F.col("field_type").isin(ENUM_LIKE))
    two = passed.where(F.col("field_type").isin(ENUM_LIKE)).withColumn("__v", enums.values(used)).where(F.size("__v") == 2)
    plain = ["row_index", "field_name", "field_type", "business_meaning", "data_example"]
    return {
        "class_check": other.select(*plain),
        "sample": other.select(*plain, "domain_type"),
        "antonym": two.select("row_index", "field_name", F.col("__v")[0].alias("word1"), F.col("__v")[1].alias("word2")),
    }


def combine(rows: DataFrame) -> DataFrame:
    """rows with check_result, fail_reason, is_meaningful, meaning_reason and normalized_enum. They carry rule_issues, flag_issues and, of
    the scorers, meaning_status, scored_meaningful, scored_reason, enum_status, has_codes and normalized: null where nothing came."""
    m, e = F.col("meaning_status"), F.col("enum_status")
    meaning = (
        F.when(m == "duplicate", "LLM返回重复结果，业务含义检查需人工复核")
        .when(m == "ok", F.when(~F.col("scored_meaningful"), F.col("scored_reason")))
        .when(meaning_eligible(), "LLM未返回该行结果，业务含义检查需人工复核")
    )
    enum = (
        F.when(e == "duplicate", "LLM返回重复结果，枚举值规范化需人工复核")
        .when(e == "ok", F.when(~F.col("has_codes"), "枚举值缺少代码，应填写'代码-码值'形式"))
        .when(F.col("enum_values") != "", "LLM未返回该行枚举值规范化结果，需人工复核")
    )
    reasons = F.concat(F.col("rule_issues"), F.col("flag_issues"), F.array_compact(F.array(meaning, enum)))
    out = rows.withColumn("__r", reasons)
    return out.select(
        *rows.columns,
        F.when(m == "ok", F.col("scored_meaningful")).otherwise(True).alias("is_meaningful"),
        F.when(m == "ok", F.col("scored_reason")).when(m.isNull() & meaning_eligible(), "LLM未返回该行结果").otherwise("").alias("meaning_reason"),
        F.when((e == "ok") & F.col("has_codes"), F.col("normalized")).otherwise("").alias("normalized_enum"),
        F.when(F.size("__r") > 0, FAILED).otherwise(PASSED).alias("check_result"),
        numbered("__r").alias("fail_reason"),
    )


def key_item_note(name: Column | str, sample: Column | str, rules: list[tuple] = KEY_ITEMS) -> Column:
    """The note of the first key-item rule whose suffix the name has, if its sample's first token has another length than allowed.
    rules: (category, suffixes, allowed lengths, note)."""
    token = F.coalesce(col(sample), F.lit(""))
    for mark in ("；", ";", "，", ",", "、"):
        token = F.split_part(strip_ws(token), F.lit(mark), F.lit(1))
    first = F.struct(strip_ws(name).alias("name"), F.length(strip_ws(token)).alias("n"))

    def note(v: Column) -> Column:
        out = F.lit(None).cast("string")
        for category, suffixes, lengths, text in reversed(rules):
            hit = F.lit(False)
            for s in suffixes:
                hit = hit | v["name"].endswith(s)
            said = F.when(~v["n"].isin(lengths), F.concat(F.lit(f"{category}类字段数据示例长度为"), v["n"].cast("string"), F.lit(f"位，{text}")))
            out = F.when(hit, said).otherwise(out)
        return F.when(v["n"] > 0, out)

    return let(first, note)


def single_note(field_type: Column, enum: Column) -> Column:
    return F.when(
        enums.item_count(enum) == 1,
        F.when(field_type == FLAG, F.concat(F.lit("标志类应有两项语义相反的取值，当前仅有'"), enum, F.lit("'，请人工确认")))
        .otherwise(F.concat(F.lit("枚举值仅有一个取值'"), enum, F.lit("'，请确认该字段是否为枚举类型或需补充其他枚举值"))),
    )


def duplicate_code_notes(enum: Column) -> Column:
    """Array: the notes on codes and on values that stand more than once in a list of several items, in order of appearance."""
    found = enums.pairs(enum)
    codes, values = enums.repeated(F.transform(found, lambda p: p["code"])), enums.repeated(F.transform(found, lambda p: p["value"]))
    note = lambda what, x: F.when(F.size(x) > 0, F.concat(F.lit(what + "重复："), F.array_join(x, "、"), F.lit("出现多次，请人工确认")))
    return F.when(F.size(found) > 1, F.array_compact(F.array(note("枚举码", codes), note("枚举码值", values)))).otherwise(F.array().cast("array<string>"))


def _scored(status: Column, failed: Column | None, label: str, bad: Column) -> Column:
    return (
        F.when(F.lit(False) if failed is None else failed, f"LLM{label}未执行，需人工复核")
        .when(status == "duplicate", f"LLM返回重复结果，{label}需人工复核")
        .when(status == "missing", f"LLM未返回该行结果，{label}需人工复核")
        .when(status == "ok", bad)
    )


def soft_notes(rows: DataFrame, key_items: list[tuple] = KEY_ITEMS) -> DataFrame:
    """rows with soft_check_result: numbered notes on passed rows, each once: key item, class, single item, duplicates, antonym,
    sample. Of the scorers the rows carry class_status, is_correct, correct_type, class_reason, antonym_status, is_antonym, sample_status,
    is_valid, sample_reason (null where not asked) and, for a call that failed, class_failed, antonym_failed, sample_failed."""
    used = F.when(F.coalesce("normalized_enum", F.lit("")) != "", F.col("normalized_enum")).otherwise(F.col("enum_values"))
    two = lambda text: F.concat(F.lit("枚举值两项（"), used, F.lit(text))
    failed = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in rows.columns else None
    wrong = F.when(~F.col("is_correct"), F.concat(F.lit("因为"), F.col("class_reason"), F.lit("，当前字段所属类型可能错误，应为"), F.col("correct_type"), F.lit("，请联系业务确认")))
    opposite = F.when((F.col("field_type") == ENUM) & F.col("is_antonym"), two("）为反义词，该字段可能应为标志类而非代码枚举类，请联系业务确认")).when(
        (F.col("field_type") == FLAG) & ~F.col("is_antonym"), two("）不能理解为反义词或'是/否'关系，该字段可能不是标志类，请联系业务确认")
    )
    bad_sample = F.when(~F.col("is_valid"), F.concat(F.lit("数据示例存在问题："), F.col("sample_reason")))
    notes = F.concat(
        F.array(key_item_note("field_name", "data_example", key_items), _scored(F.col("class_status"), failed("class_failed"), "字段所属类型检查", wrong), single_note(F.col("field_type"), used)),
        duplicate_code_notes(used),
        F.array(
            _scored(F.col("antonym_status"), failed("antonym_failed"), "枚举值反义词检查", opposite),
            _scored(F.col("sample_status"), failed("sample_failed"), "数据示例语义检查", bad_sample),
        ),
    )
    text = numbered(F.array_distinct(F.array_compact(notes)))
    return rows.withColumn("soft_check_result", F.when(F.col("check_result") == PASSED, text).otherwise(""))
