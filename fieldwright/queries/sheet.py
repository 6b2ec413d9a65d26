"""Queries of sources, filters and rule checks over the application sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.domain import char_fault, date_kind, domain_conflict, length_fault, parse_domain, sample_fault
from ..functions.text import clean_cell, json_array, token_estimate, utf8_cut
from ..functions.vocab import FAILED, PASSED
from ..operators import mapping, quality, report, scoring
from ..plans import jobs
from ..sources import tables
from . import sql
from .derive import C, DICTIONARY_SQL, DOMAINS_SQL, RESULTS_SQL, SHEET_SQL, dictionary, domains, results, sheet, table

Q: dict = {}
O: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if oracle:
            O[f.__name__] = oracle
        return f

    return keep


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return quality.check_rules(sheet(spark, d))


@query(f"SELECT row_index, CASE WHEN len(issues) = 0 THEN '通过' ELSE '不通过' END AS verdict, array_to_string(issues, ' / ') AS issues FROM ({sql.ruled(SHEET_SQL)})")
def quality_check_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return verdicts(spark, d).select("row_index", F.when(F.col("rule_passed"), PASSED).otherwise(FAILED).alias("verdict"), F.array_join("rule_issues", " / ").alias("issues"))


@query("SELECT c_custkey AS row_index, c_name AS field_name, c_mktsegment AS field_type, '' AS business_caliber FROM customer")
def a2_columns(spark: SparkSession, d: str) -> DataFrame:
    wanted = {"field_name": ["missing", "c_name"], "field_type": ["c_mktsegment"], "business_caliber": ["nowhere", "nor_here"]}
    return tables.load_sheet(table(spark, d, "customer"), ["field_name", "field_type"], ["business_caliber"], wanted, key=C)


_CELLS = "CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN ' NaN ' WHEN 2 THEN 'None' WHEN 3 THEN '　' || c_name || ' ' WHEN 4 THEN 'NAT' WHEN 5 THEN '' ELSE c_name END"


@query(f"SELECT c_custkey, CASE WHEN lower({sql.strip('cell')}) IN ('nan', 'none', 'nat') THEN '' ELSE {sql.strip('cell')} END AS cell FROM (SELECT c_custkey, coalesce({_CELLS}, '') AS cell FROM customer)")
def a4_clean_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", clean_cell(F.expr(_CELLS)).alias("cell"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders")
def a5_row_index(spark: SparkSession, d: str) -> DataFrame:
    return tables.with_row_index(table(spark, d, "orders").select("o_orderkey"))


@query("SELECT 'a' AS std_type, c_custkey AS id, c_name AS name, NULL::VARCHAR AS extra FROM customer UNION ALL SELECT 'b', s_suppkey, s_name, 'x' FROM supplier")
def a6_union_classes(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("x").alias("extra"))
    return tables.union_classes({"a": a, "b": b})


@query(f"SELECT domain_id, domain_name, domain_type, pos FROM ({DOMAINS_SQL}) WHERE trim(domain_id) <> '' QUALIFY row_number() OVER (PARTITION BY domain_id ORDER BY pos DESC) = 1")
def a7_domains_last(spark: SparkSession, d: str) -> DataFrame:
    return tables.load_domains(domains(spark, d)).select("domain_id", "domain_name", "domain_type", "pos")


@query(f"SELECT s.row_index, s.field_name, coalesce(r.verdict, '') AS check_result FROM ({SHEET_SQL}) s LEFT JOIN (SELECT row_index, 'n' || (row_index % 3) AS verdict FROM ({SHEET_SQL}) WHERE row_index % 4 = 1) r USING (row_index)")
def a8_write_back(spark: SparkSession, d: str) -> DataFrame:
    s = sheet(spark, d)
    done = s.where("row_index % 4 = 1").select("row_index", F.concat(F.lit("n"), (F.col("row_index") % 3).cast("string")).alias("check_result"))
    return tables.write_back(s.select("row_index", "field_name"), done)


@query(f"SELECT row_index, CASE WHEN row_index % 3 = 0 THEN 'n-' || row_index ELSE enum_values END AS enum_values FROM ({SHEET_SQL})")
def a9_enum_overwrite(spark: SparkSession, d: str) -> DataFrame:
    norm = F.expr("CASE row_index % 3 WHEN 0 THEN 'n-' || row_index WHEN 1 THEN '' END")
    return sheet(spark, d).select("row_index", tables.overwrite_enum(F.col("enum_values"), norm).alias("enum_values"))


@query("SELECT c_custkey AS standard_id, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE 'old' END AS name FROM customer UNION ALL SELECT -c_custkey - 1, 'new' FROM customer WHERE c_custkey % 10 = 0")
def a12_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col(C).alias("standard_id"))
    new = c.where("standard_id % 5 = 0").union(c.where("standard_id % 10 = 0").select(-F.col("standard_id") - 1)).withColumn("name", F.lit("new"))
    return tables.upsert(c.withColumn("name", F.lit("old")), new)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'cached' ELSE 'made' END AS origin FROM orders")
def a13_resume(spark: SparkSession, d: str) -> DataFrame:
    todo = table(spark, d, "orders").select("o_orderkey")
    cache = todo.where("o_orderkey % 3 = 0").withColumn("origin", F.lit("cached"))
    return tables.resume(todo, cache, "o_orderkey", lambda x: x.withColumn("origin", F.lit("made")))


@query(f"SELECT row_index, table_name, field_name, field_type, domain_type, data_example, is_enum, business_meaning, enum_values FROM ({sql.blanked(SHEET_SQL)})")
def b1_placeholders(spark: SparkSession, d: str) -> DataFrame:
    return quality.blank_placeholders(sheet(spark, d)).drop("business_caliber")


@query(f"SELECT row_index, field_type FROM ({SHEET_SQL}) WHERE field_type IN ('数值类', '编码类', '日期时间类', '标志类', '文本类')")
def b2_non_enum(spark: SparkSession, d: str) -> DataFrame:
    return mapping.non_enum_fields(sheet(spark, d)).select("row_index", "field_type")


_MEANING = f"""WITH r AS ({sql.ruled(SHEET_SQL)}), e AS (
  SELECT *, CASE WHEN enum_values = '' THEN NULL WHEN row_index % 5 = 0 THEN NULL ELSE row_index % 4 <> 0 END AS has_codes, CASE WHEN enum_values <> '' AND row_index % 3 = 0 THEN 'N-' || enum_values ELSE '' END AS normalized FROM r)
SELECT row_index, field_name, CASE WHEN table_name <> '' THEN '来自表“' || table_name || '”。' || business_meaning ELSE business_meaning END AS business_meaning,
  CASE WHEN normalized <> '' THEN normalized ELSE enum_values END AS enum_values FROM e
WHERE business_meaning <> '' AND len(issues) = 0 AND (enum_values = '' OR coalesce(has_codes, false))"""


def _with_enum_result(rows: DataFrame) -> DataFrame:
    asked = F.col("enum_values") != ""
    return rows.withColumn("has_codes", F.when(asked & (F.col("row_index") % 5 != 0), F.col("row_index") % 4 != 0)).withColumn(
        "normalized", F.when(asked & (F.col("row_index") % 3 == 0), F.concat(F.lit("N-"), "enum_values")).otherwise("")
    )


@query(_MEANING)
def b7_meaning_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_enum_result(verdicts(spark, d)).withColumn("flag_issues", F.array().cast("array<string>"))
    return quality.meaning_requests(rows).drop("field_type")


@query(_MEANING.replace("SELECT row_index, field_name, CASE WHEN table_name", "SELECT row_index, true AS eligible, --\nCASE WHEN table_name").replace("\nCASE WHEN table_name <> '' THEN '来自表“' || table_name || '”。' || business_meaning ELSE business_meaning END AS business_meaning,\n  CASE WHEN normalized <> '' THEN normalized ELSE enum_values END AS enum_values FROM e", "\n FROM e").replace("true AS eligible, --", "true AS eligible --"))
def b6_meaning_eligible(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_enum_result(verdicts(spark, d)).withColumn("flag_issues", F.array().cast("array<string>"))
    return rows.where(quality.meaning_eligible()).select("row_index", F.lit(True).alias("eligible"))


@query(f"SELECT row_index, field_name, enum_values FROM ({sql.blanked(SHEET_SQL)}) WHERE enum_values <> ''")
def b8_enum_requests(spark: SparkSession, d: str) -> DataFrame:
    return quality.enum_requests(quality.blank_placeholders(sheet(spark, d)))


_SOFT = f"SELECT *, {sql.items('enum_values')} AS its FROM ({sql.blanked(SHEET_SQL)}) WHERE row_index % 3 <> 0"


@query(f"""WITH p AS ({_SOFT})
SELECT row_index, 'class_check' AS kind, '' AS word1, '' AS word2 FROM p WHERE field_type NOT IN ('代码枚举类', '标志类') UNION ALL
SELECT row_index, 'sample', '', '' FROM p WHERE field_type NOT IN ('代码枚举类', '标志类') UNION ALL
SELECT row_index, 'antonym', {sql.value_of('its[1]')}, {sql.value_of('its[2]')} FROM p WHERE field_type IN ('代码枚举类', '标志类') AND len(its) = 2""")
def b9_soft_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.blank_placeholders(sheet(spark, d)).withColumn("normalized_enum", F.lit("")).withColumn("check_result", F.when(F.col("row_index") % 3 != 0, PASSED).otherwise(FAILED))
    r = quality.soft_requests(rows)
    plain = lambda k: r[k].select("row_index", F.lit(k).alias("kind"), F.lit("").alias("word1"), F.lit("").alias("word2"))
    return plain("class_check").union(plain("sample")).union(r["antonym"].select("row_index", F.lit("antonym"), "word1", "word2"))


_VALUES = f"list_sort(list_distinct(list_filter(list_transform({sql.items('enum_values')}, lambda x: {sql.value_of('x')}), lambda x: x <> '')))"


@query(f"SELECT row_index, field_name, enum_values FROM ({sql.blanked(SHEET_SQL)}) WHERE field_type = '标志类' AND len({_VALUES}) > 0 AND {_VALUES} <> ['否', '是']")
def b10_flag_rename(spark: SparkSession, d: str) -> DataFrame:
    return mapping.flag_rename_requests(quality.blank_placeholders(sheet(spark, d))).select("row_index", "field_name", "enum_values")


def _kind(s: str) -> str:
    ok = lambda t: f"({sql.sample_fault(repr(t), s)}) IS NULL"
    return f"CASE WHEN {sql.strip(s)} = '' OR {sql.strip(s)} IN {sql.NO_SAMPLE} THEN NULL WHEN {ok('DATE')} THEN '日期' WHEN {ok('TIME')} THEN '时间' WHEN {ok('DATETIME')} THEN '时间戳' END"


@query(f"SELECT row_index, field_name, detected_type FROM (SELECT *, {_kind('data_example')} AS detected_type FROM ({SHEET_SQL})) WHERE field_type = '日期时间类' AND detected_type IS NOT NULL AND NOT suffix(field_name, detected_type)")
def b11_datetime_rename(spark: SparkSession, d: str) -> DataFrame:
    return mapping.datetime_rename_requests(sheet(spark, d)).select("row_index", "field_name", "detected_type")


_RECONCILED = f"SELECT row_index, count(*) AS n, arg_max(is_ok, arrival) AS is_ok, arg_max(verdict, arrival) AS verdict FROM ({RESULTS_SQL}) GROUP BY row_index"


@query(f"SELECT s.row_index FROM ({SHEET_SQL}) s LEFT JOIN ({_RECONCILED}) r USING (row_index) WHERE NOT coalesce(r.n = 1 AND r.is_ok, false)")
def b12_drop_indicators(spark: SparkSession, d: str) -> DataFrame:
    s = sheet(spark, d)
    done = scoring.reconcile(s.select("row_index"), results(spark, d)).withColumnRenamed("is_ok", "is_indicator")
    return mapping.drop_indicators(s, done).select("row_index")


@query(f"SELECT row_index, string_agg(std_id || '=' || std_name, ';' ORDER BY pos) AS candidates FROM (SELECT p_partkey AS row_index FROM part) s JOIN (SELECT pos, std_id, std_name FROM ({DICTIONARY_SQL})) c ON c.pos // 3 = s.row_index GROUP BY row_index")
def b13_selection_requests(spark: SparkSession, d: str) -> DataFrame:
    s = sheet(spark, d)
    cand = s.select("row_index").join(dictionary(spark, d).withColumn("row_index", F.expr("pos DIV 3")), "row_index").withColumnRenamed("pos", "place")
    r = mapping.selection_requests(s, cand)
    return r.select("row_index", F.array_join(F.transform("candidates", lambda x: F.concat(x["std_id"], F.lit("="), x["std_name"])), ";").alias("candidates"))


@query(f"SELECT row_index, {sql.domain_key('domain_type')} AS key, CASE WHEN ({sql.domain_key('domain_type')}) IS NOT NULL THEN {sql.domain_x('domain_type')} END AS x, CASE WHEN ({sql.domain_key('domain_type')}) IS NOT NULL THEN {sql.domain_y('domain_type')} END AS y FROM ({SHEET_SQL})")
def c1_parse_domain(spark: SparkSession, d: str) -> DataFrame:
    p = parse_domain("domain_type")
    return sheet(spark, d).select("row_index", p["key"].alias("key"), p["x"].alias("x"), p["y"].alias("y"))


@query(f"SELECT row_index, {sql.char_fault('data_example', '(' + sql.domain_key('domain_type') + ')')} AS fault FROM ({SHEET_SQL})")
def c2_char_class(spark: SparkSession, d: str) -> DataFrame:
    return sheet(spark, d).select("row_index", char_fault(F.col("data_example"), parse_domain("domain_type")["key"]).alias("fault"))


@query(f"SELECT row_index, {sql.length_fault('data_example', '(' + sql.domain_key('domain_type') + ')', sql.domain_x('domain_type'), sql.domain_y('domain_type'))} AS fault FROM ({SHEET_SQL})")
def c3_length(spark: SparkSession, d: str) -> DataFrame:
    return sheet(spark, d).select("row_index", length_fault(F.col("data_example"), parse_domain("domain_type")).alias("fault"))


@query(f"SELECT row_index, {sql.sample_fault('domain_type', 'data_example')} AS fault FROM ({SHEET_SQL})")
def c4_sample_check(spark: SparkSession, d: str) -> DataFrame:
    return sheet(spark, d).select("row_index", sample_fault("domain_type", "data_example").alias("fault"))


def _rule(name: str, issue):
    def f(spark: SparkSession, d: str) -> DataFrame:
        return quality.blank_placeholders(sheet(spark, d)).select("row_index", issue().alias("issue"))

    f.__name__ = name
    return f


for _n, _k, _f in (
    ("c5_required", "required", quality.required_issue), ("c6_name", "name", quality.name_issue), ("c7_class", "class", quality.class_issue),
    ("c8_enum_triple", "enum", quality.enum_issue), ("c9_domain_whitelist", "domain", quality.domain_issue), ("c10_sample_issue", "sample", quality.sample_issue),
):
    query(f"SELECT row_index, {sql.ISSUES[_k]} AS issue FROM ({sql.blanked(SHEET_SQL)})")(_rule(_n, _f))


@query("SELECT p_partkey AS row_index, count(*) OVER (PARTITION BY p_brand, p_name) > 1 AS is_duplicate FROM part")
def c11_duplicate_fields(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("row_index"), F.col("p_brand").alias("table_name"), F.col("p_name").alias("field_name"))
    return quality.duplicate_fields(p).select("row_index", "is_duplicate")


@query(f"SELECT row_index, array_to_string(issues, ' / ') AS issues, len(issues) AS n_issues FROM ({sql.ruled(SHEET_SQL)})")
def c12_issues(spark: SparkSession, d: str) -> DataFrame:
    return verdicts(spark, d).select("row_index", F.array_join("rule_issues", " / ").alias("issues"), F.size("rule_issues").cast("bigint").alias("n_issues"))


_CONSISTENT = f"""SELECT *, CASE WHEN field_type IN ('代码枚举类', '标志类') AND enum_values <> '' THEN
  CASE WHEN field_type = '代码枚举类' AND list_sort(list_distinct(list_transform({sql.items('enum_values')}, lambda x: {sql.value_of('x')}))) = ['否', '是'] THEN '代码枚举类字段的枚举值有且仅有''是''和''否''，应申报为标志类'
  WHEN field_type = '标志类' AND len({sql.items('enum_values')}) > 2 THEN '标志类字段的枚举值超过两项（实际' || len({sql.items('enum_values')}) || '项），应申报为代码枚举类' END END AS flag_issue FROM ({sql.ruled(SHEET_SQL)})"""


@query(f"SELECT row_index, CASE WHEN row_index % 5 = 0 OR row_index % 7 = 0 THEN NULL ELSE flag_issue END AS issue FROM ({_CONSISTENT})")
def c13_consistency(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("row_index") % 5 == 0, "duplicate").otherwise("ok")
    has = F.when(F.col("row_index") % 7 == 0, False).otherwise(True)
    issue = quality.consistency_issue(F.col("field_type"), F.col("enum_values"), status, has, F.lit(""))
    return quality.blank_placeholders(sheet(spark, d)).select("row_index", issue.alias("issue"))


_ELIGIBLE = "business_meaning <> '' AND len(issues) = 0 AND flag_issue IS NULL AND (enum_values = '' OR row_index % 11 NOT IN (0, 1))"
_COMBINED = f"""SELECT row_index, reasons FROM (SELECT *, list_filter(list_concat(issues, [flag_issue,
    CASE WHEN {_ELIGIBLE} THEN CASE row_index % 6 WHEN 0 THEN 'LLM返回重复结果，业务含义检查需人工复核' WHEN 1 THEN 'LLM未返回该行结果，业务含义检查需人工复核' WHEN 2 THEN 'reason ' || row_index END END,
    CASE WHEN enum_values <> '' THEN CASE row_index % 11 WHEN 0 THEN 'LLM未返回该行枚举值规范化结果，需人工复核' WHEN 1 THEN '枚举值缺少代码，应填写''代码-码值''形式' WHEN 2 THEN 'LLM返回重复结果，枚举值规范化需人工复核' END END]), lambda x: x IS NOT NULL) AS reasons
  FROM (SELECT * REPLACE (CASE WHEN row_index % 11 IN (1, 2) THEN NULL ELSE flag_issue END AS flag_issue) FROM ({_CONSISTENT})))"""


@query(f"SELECT row_index, CASE WHEN len(reasons) > 0 THEN '不通过' ELSE '通过' END AS check_result, coalesce(array_to_string(list_transform(reasons, lambda x, i: i || '. ' || x), chr(10)), '') AS fail_reason FROM ({_COMBINED})")
def c14_combine(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("row_index")
    asked = F.col("enum_values") != ""
    rows = verdicts(spark, d).withColumns({
        "enum_status": F.when(asked & (k % 11 == 2), "duplicate").when(asked & (k % 11 != 0), "ok"),
        "has_codes": F.when(asked & (k % 11 != 0), k % 11 != 1), "normalized": F.lit(""),
    })
    rows = quality.add_consistency(rows)
    sent = quality.meaning_eligible()
    rows = rows.withColumns({
        "meaning_status": F.when(sent & (k % 6 == 0), "duplicate").when(sent & (k % 6 != 1), "ok"),
        "scored_meaningful": F.when(sent, k % 6 != 2), "scored_reason": F.when(sent, F.concat(F.lit("reason "), k.cast("string"))),
    })
    return quality.combine(rows).select("row_index", "check_result", "fail_reason")


@query(f"SELECT row_index, {sql.key_note()} AS note FROM ({SHEET_SQL})")
def c15_key_items(spark: SparkSession, d: str) -> DataFrame:
    return sheet(spark, d).select("row_index", quality.key_item_note("field_name", "data_example", sql.KEY_ITEMS).alias("note"))


_ONE = f"""CASE WHEN len({sql.items('enum_values')}) = 1 THEN CASE WHEN field_type = '标志类' THEN '标志类应有两项语义相反的取值，当前仅有''' || enum_values || '''，请人工确认'
  ELSE '枚举值仅有一个取值''' || enum_values || '''，请确认该字段是否为枚举类型或需补充其他枚举值' END END"""


@query(f"SELECT row_index, {_ONE} AS note FROM ({SHEET_SQL})")
def c16_single(spark: SparkSession, d: str) -> DataFrame:
    return sheet(spark, d).select("row_index", quality.single_note(F.col("field_type"), F.col("enum_values")).alias("note"))


def _twice(of: str) -> str:
    xs = f"list_transform({sql.items('enum_values')}, lambda x: {of})"
    return f"list_filter({xs}, lambda y, i: y <> '' AND list_position({xs}, y) = i AND len(list_filter({xs}, lambda z: z = y)) > 1)"


_DUP = f"""CASE WHEN len({sql.items('enum_values')}) > 1 THEN list_filter([
  CASE WHEN len({_twice(sql.code_of('x'))}) > 0 THEN '枚举码重复：' || array_to_string({_twice(sql.code_of('x'))}, '、') || '出现多次，请人工确认' END,
  CASE WHEN len({_twice(sql.value_of('x'))}) > 0 THEN '枚举码值重复：' || array_to_string({_twice(sql.value_of('x'))}, '、') || '出现多次，请人工确认' END], lambda n: n IS NOT NULL) ELSE [] END"""


@query(f"SELECT row_index, coalesce(array_to_string({_DUP}, ' / '), '') AS notes FROM ({SHEET_SQL})")
def c17_dup_codes(spark: SparkSession, d: str) -> DataFrame:
    return sheet(spark, d).select("row_index", F.array_join(quality.duplicate_code_notes(F.col("enum_values")), " / ").alias("notes"))


@query(f"""SELECT row_index, CASE WHEN row_index % 3 = 0 THEN '' ELSE coalesce(array_to_string(list_transform(list_filter(list_concat(
    [{sql.key_note()}, CASE row_index % 5 WHEN 0 THEN 'LLM返回重复结果，字段所属类型检查需人工复核' WHEN 1 THEN 'LLM未返回该行结果，字段所属类型检查需人工复核' WHEN 2 THEN '因为r，当前字段所属类型可能错误，应为文本类，请联系业务确认' END, {_ONE}], {_DUP},
    [CASE WHEN row_index % 4 IN (1, 3) AND field_type = '代码枚举类' THEN '枚举值两项（' || enum_values || '）为反义词，该字段可能应为标志类而非代码枚举类，请联系业务确认' WHEN row_index % 4 = 2 AND field_type = '标志类' THEN '枚举值两项（' || enum_values || '）不能理解为反义词或''是/否''关系，该字段可能不是标志类，请联系业务确认' END,
     CASE WHEN row_index % 7 = 0 THEN '数据示例存在问题：s' END]), lambda n: n IS NOT NULL), lambda n, i: i || '. ' || n), chr(10)), '') END AS soft_check_result FROM ({sql.blanked(SHEET_SQL)})""")
def c18_soft_notes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("row_index")
    rows = quality.blank_placeholders(sheet(spark, d)).withColumns({
        "normalized_enum": F.lit(""), "check_result": F.when(k % 3 == 0, FAILED).otherwise(PASSED),
        "class_status": F.when(k % 5 == 0, "duplicate").when(k % 5 == 1, "missing").otherwise("ok"), "is_correct": k % 5 != 2, "correct_type": F.lit("文本类"), "class_reason": F.lit("r"),
        "antonym_status": F.when(k % 4 != 0, "ok"), "is_antonym": k % 4 != 2, "sample_status": F.lit("ok"), "is_valid": k % 7 != 0, "sample_reason": F.lit("s"),
    })
    return quality.soft_notes(rows, sql.KEY_ITEMS).select("row_index", "soft_check_result")


@query(f"SELECT row_index, {_kind('data_example')} AS kind FROM ({SHEET_SQL})")
def c19_date_kind(spark: SparkSession, d: str) -> DataFrame:
    return sheet(spark, d).select("row_index", date_kind("data_example").alias("kind"))


@query(f"SELECT row_index, CASE WHEN suffix(field_name, '编号') THEN field_name || '/' || left(field_name, length(field_name) - 2) || '号' WHEN suffix(field_name, '号') THEN field_name || '/' || left(field_name, length(field_name) - 1) || '编号' ELSE field_name END AS variants FROM ({SHEET_SQL})")
def c20_synonyms(spark: SparkSession, d: str) -> DataFrame:
    return sheet(spark, d).select("row_index", F.array_join(names.name_variants("field_name"), "/").alias("variants"))


_GROUPS = "SELECT p_partkey AS group_id, unnest([1, 2, 3]) AS pos, unnest([lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0'), 'x' || p_partkey, '客户' || p_partkey]) AS suffix FROM part"
_NAMES = "SELECT c_custkey AS row_index, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_name || 'x' || (c_custkey % 700) WHEN 2 THEN '客户' || (c_custkey % 900) ELSE 'none' END AS field_name FROM customer"


@query(f"""WITH g AS ({_GROUPS}), m AS (SELECT suffix, max(group_id) AS group_id FROM g GROUP BY suffix), n AS ({_NAMES}),
  h AS (SELECT n.row_index, field_name, m.suffix, m.group_id FROM n JOIN m ON suffix(n.field_name, m.suffix) QUALIFY row_number() OVER (PARTITION BY n.row_index ORDER BY length(m.suffix) DESC) = 1)
  SELECT row_index, 0::BIGINT AS variant_pos, field_name AS variant FROM n
  UNION ALL SELECT h.row_index, row_number() OVER (PARTITION BY h.row_index ORDER BY g.pos), left(h.field_name, length(h.field_name) - length(h.suffix)) || g.suffix FROM h JOIN g ON g.group_id = h.group_id AND g.suffix <> h.suffix""")
def c20_synonym_table(spark: SparkSession, d: str) -> DataFrame:
    """Variants by a table of synonym groups, one for each part."""
    k = F.col("p_partkey").cast("string")
    members = F.array(F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.concat(F.lit("x"), k), F.concat(F.lit("客户"), k))
    groups = table(spark, d, "part").select(F.col("p_partkey").alias("group_id"), F.posexplode(members).alias("pos", "suffix"))
    c = F.col("c_custkey")
    name = F.when(c % 4 == 0, F.col("c_name")).when(c % 4 == 1, F.concat("c_name", F.lit("x"), (c % 700).cast("string"))).when(c % 4 == 2, F.concat(F.lit("客户"), (c % 900).cast("string"))).otherwise("none")
    fields = table(spark, d, "customer").select(c.alias("row_index"), name.alias("field_name"))
    return mapping.name_variants_by(fields, groups).select("row_index", F.col("variant_pos").cast("bigint").alias("variant_pos"), "variant")


@query(f"SELECT row_index, ({sql.sample_fault('domain_type', 'data_example')}) IS NOT NULL AS conflict FROM ({SHEET_SQL})")
def c21_conflict(spark: SparkSession, d: str) -> DataFrame:
    return sheet(spark, d).select("row_index", F.coalesce(domain_conflict("domain_type", "data_example"), F.lit(False)).alias("conflict"))


_CAND = f"SELECT s.row_index, s.field_type, s.data_example, 'C' || o.i AS std_id, o.i AS place, CASE o.i WHEN 0 THEN 'n..(10)' WHEN 1 THEN 'DATE' WHEN 2 THEN '' ELSE 'an..(6)' END AS domain_type FROM ({SHEET_SQL}) s, (SELECT unnest(range(4)) AS i) o"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    s = sheet(spark, d).select("row_index", "field_type", "data_example", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("place"))
    kinds = F.when(F.col("place") == 0, "n..(10)").when(F.col("place") == 1, "DATE").when(F.col("place") == 2, "").otherwise("an..(6)")
    return s.withColumn("std_id", F.concat(F.lit("C"), F.col("place").cast("string"))).withColumn("domain_type", kinds)


@query(f"""WITH c AS (SELECT *, field_type <> '标志类' AND data_example <> '' AND ({sql.sample_fault('domain_type', 'data_example')}) IS NOT NULL AS bad FROM ({_CAND}))
SELECT row_index, count(*) FILTER (NOT bad) AS n_kept, coalesce(string_agg(std_id, ',' ORDER BY place) FILTER (bad), '') AS eliminated,
  CASE WHEN first(field_type) = '标志类' THEN '标志类字段，域类型恒定通过' WHEN first(data_example) = '' THEN '无数据示例，跳过域类型冲突检测'
  ELSE string_agg('备选标准' || std_id || '域类型' || domain_type || CASE WHEN bad THEN '与数据示例''' || data_example || '''冲突，已淘汰' ELSE '无冲突' END, '; ' ORDER BY place) END AS details FROM c GROUP BY row_index""")
def c22_domain_filter(spark: SparkSession, d: str) -> DataFrame:
    kept, info = mapping.filter_domains(_candidates(spark, d))
    n = kept.groupBy("row_index").agg(F.count(F.lit(1)).alias("n"))
    return info.join(n, "row_index", "left").select("row_index", F.coalesce("n", F.lit(0)).alias("n_kept"), F.array_join("eliminated", ",").alias("eliminated"), F.col("domain_check_details").alias("details"))


@query(f"SELECT field_type, count(*) AS n_rows, count(*) FILTER (len(issues) = 0) AS n_0, count(*) FILTER (len(issues) > 0) AS n_1, 0 AS n_other FROM ({sql.ruled(SHEET_SQL)}) GROUP BY field_type")
def f9_summary(spark: SparkSession, d: str) -> DataFrame:
    v = verdicts(spark, d).withColumn("verdict", F.when(F.col("rule_passed"), PASSED).otherwise(FAILED))
    return report.summary(v, "verdict", [PASSED, FAILED], ["field_type"])


@query("SELECT CASE WHEN label IS NULL AND module IS NULL THEN 'total' ELSE module || '/' || label END AS grp, sum(n) AS n_calls, sum(CASE WHEN g = 0 THEN e ELSE g END)::BIGINT AS tokens FROM (SELECT 'm' || (conv_id % 3) AS module, role AS label, count(*) AS n, sum(CASE WHEN conv_id % 3 = 0 THEN 0 ELSE turn END) AS g, sum(greatest(1, length(text) // 2) + 1) AS e FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL GROUP BY ALL) GROUP BY GROUPING SETS ((module, label), ())")
def f10_tokens(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where("role is not null and text is not null")
    calls = c.select(
        F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("module"), F.col("role").alias("label"), F.col("text").alias("prompt"), F.lit("").alias("answer"),
        F.when(F.col("conv_id") % 3 == 0, 0).otherwise(F.col("turn")).alias("prompt_tokens"), F.lit(0).alias("answer_tokens"),
    )
    u = report.token_usage(calls)
    return u.select(F.coalesce(F.concat("module", F.lit("/"), "label"), F.lit("total")).alias("grp"), "n_calls", "tokens")


@query(f"SELECT std_type, count(*) AS n FROM ({DICTIONARY_SQL}) GROUP BY std_type")
def f11_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.count_by(dictionary(spark, d), "std_type")


_EXP = "SELECT o_orderkey AS row_index, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) || '.0' END AS cust FROM orders WHERE o_orderkey % 7 <> 0"


@query(f"""WITH a AS (SELECT o_orderkey AS row_index, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS cust FROM orders), e AS ({_EXP}),
x AS (SELECT row_index, 'status' AS "column", a.status AS actual, e.status AS expected FROM a JOIN e USING (row_index) UNION ALL SELECT row_index, 'cust', a.cust, coalesce(replace(e.cust, '.0', ''), '') FROM a JOIN e USING (row_index))
SELECT * FROM x WHERE actual <> expected""")
def e16_compare(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    a = o.select(F.col("o_orderkey").alias("row_index"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"))
    e = o.where("o_orderkey % 7 <> 0").selectExpr("o_orderkey AS row_index", "CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS status", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) || '.0' END AS cust")
    return report.compare(a, e, ["status", "cust", "nowhere"])[0]


@query(f"SELECT row_index, \"column\", actual, expected FROM ({O['e16_compare']}) ORDER BY row_index, \"column\" LIMIT 20")
def h4_diff_sample(spark: SparkSession, d: str) -> DataFrame:
    return report.difference_sample(e16_compare(spark, d))


@query(f"SELECT s.row_index, CASE WHEN r.n IS NULL THEN 'missing' WHEN r.n > 1 THEN 'duplicate' ELSE 'ok' END AS status, r.verdict, r.is_ok FROM (SELECT DISTINCT conv_id AS row_index FROM conversations) s LEFT JOIN ({_RECONCILED}) r USING (row_index)")
def e7_reconcile(spark: SparkSession, d: str) -> DataFrame:
    sent = table(spark, d, "conversations").select(F.col("conv_id").alias("row_index")).distinct()
    return scoring.reconcile(sent, results(spark, d)).select("row_index", "status", "verdict", "is_ok")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def d15_json_array(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit("Here it is:\n```json\n["), "props", F.lit("]\n``` done"))
    return table(spark, d, "events").select("event_id", json_array(answer, "array<struct<k:bigint>>")[0]["k"].alias("k"))


@query("SELECT batch, '[' || string_agg('{\"row_index\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}', ',' ORDER BY o_orderkey) || ']' AS request FROM (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 10 AS batch FROM orders) GROUP BY batch")
def d16_json_request(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_index"), F.col("o_orderstatus").alias("status"))
    return scoring.batches(o, 10).groupBy("batch").agg(scoring.json_request(None, "row_index", "status").alias("request"))


@query("SELECT conv_id, turn, greatest(1, length(text) // 2) AS tokens FROM conversations WHERE text IS NOT NULL")
def d18_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", token_estimate("text").cast("bigint").alias("tokens"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 100 THEN text ELSE (SELECT max(left(text, n)) FILTER (strlen(left(text, n)) <= 100) FROM (SELECT unnest(range(101)) AS n)) END AS head FROM documents WHERE text IS NOT NULL")
def b5_utf8_cut(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", utf8_cut("text", 100).alias("head"))


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 5 AS batch FROM orders")
def g5_batches(spark: SparkSession, d: str) -> DataFrame:
    return scoring.batches(table(spark, d, "orders"), 5, ["o_orderpriority"], "o_orderkey").select("o_orderkey", "batch")


@query(f"""SELECT row_index, length(CASE WHEN table_name <> '' THEN '来自表“' || table_name || '”。' || business_meaning ELSE business_meaning END) > 40 AS is_meaningful, 'length' AS reasoning, 'ok' AS status
FROM ({sql.ruled(SHEET_SQL)}) WHERE business_meaning <> '' AND len(issues) = 0""")
def k1_scorer(spark: SparkSession, d: str) -> DataFrame:
    """Meaning requests answered by a plain rule in batches of 10, reconciled."""
    def score(pdf):
        return pdf[["row_index"]].assign(is_meaningful=pdf["business_meaning"].str.len() > 40, reasoning="length")

    rows = verdicts(spark, d).withColumn("flag_issues", F.array().cast("array<string>")).withColumn("has_codes", F.lit(True)).withColumn("normalized", F.lit(""))
    sent = quality.meaning_requests(rows)
    got = scoring.run_scorer(sent, score, scoring.RESULTS["meaning"]).withColumn("arrival", F.lit(0))
    return scoring.reconcile(sent.select("row_index"), got).select("row_index", "is_meaningful", "reasoning", "status")


@query("SELECT item_id, CAST(64 AS INTEGER) AS n, 1.0::DOUBLE AS norm FROM benchmark WHERE text <> ''")
def k2_embedder(spark: SparkSession, d: str) -> DataFrame:
    """Item texts of the benchmark embedded once each: size and length of the vectors."""
    v = scoring.embed_distinct(table(spark, d, "benchmark").where("text != ''"), "text", scoring.hashing_embedder(64))
    return v.select("item_id", F.size("vector").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 3).alias("norm"))


@query()
def w1_quality_check(spark: SparkSession, d: str) -> DataFrame:
    """The whole quality check with rule-based enum normalisation and no model."""
    return jobs.quality_check(sheet(spark, d), ask_meaning=False)


@query(f"SELECT row_index, len(issues) = 0 AS rule_passed, array_to_string(issues, ' / ') AS issues FROM (SELECT row_index, list_filter([{', '.join(sql.ISSUES.values())}], lambda x: x IS NOT NULL) AS issues FROM ({sql.blanked(SHEET_SQL)}))")
def j1_intake(spark: SparkSession, d: str) -> DataFrame:
    """Row rules on the sheet as a stream of files, landed by batches in the shared folder."""
    import uuid

    from ..streaming import intake

    root = tables.shared_dir(spark)
    at = f"{root}/intake-{uuid.uuid4().hex}"
    s = sheet(spark, d)
    s.repartition(max(4, spark.sparkContext.defaultParallelism)).write.parquet(f"{at}/in")
    q = intake.start_intake(intake.read_sheets(spark, f"{at}/in", s.schema), f"{at}/out", f"{at}/state")
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").select("row_index", "rule_passed", F.array_join("rule_issues", " / ").alias("issues"))


@query("SELECT p_brand AS table_name, p_name AS field_name, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def j1_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Names that stand more than once, counted as files arrive, in four batches of a file for each core."""
    import uuid

    from ..streaming import intake

    at = f"{tables.shared_dir(spark)}/intake-{uuid.uuid4().hex}"
    s = sheet(spark, d).drop("table_name", "field_name")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("row_index"), F.col("p_brand").alias("table_name"), F.col("p_name").alias("field_name"))
    s = s.join(p, "row_index")
    cores = spark.sparkContext.defaultParallelism
    s.repartition(4 * cores).write.parquet(f"{at}/in")
    rows = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", cores).parquet(f"{at}/in")
    intake.start_intake(rows, f"{at}/out", f"{at}/state", counts=f"{at}/counts").awaitTermination()
    return intake.duplicate_names(spark, f"{at}/counts")
