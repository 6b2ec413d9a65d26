"""The shapes that the operators work on, derived from the given tables by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

K = "p_partkey"


def pick(key: str, n: int, values: list[str]) -> str:
    """values by key % n; the last one for the rest."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {key} % {n} {arms} ELSE '{values[-1]}' END"


_CLASS = pick(K, 9, ["数值类", "编码类", "代码枚举类", "日期时间类", "标志类", "文本类", "其他类", "", "编码类"])
_IS_ENUM_CLASS = f"{_CLASS} IN ('代码枚举类', '标志类')"
_ENUM_LISTS = pick(K, 31, ["1-是;0-否", "01-成功;02-失败;03-处理中", "1-男;女", "", "-", "A-冻结;A-解冻", "1-启用;2-停用", "1-是; 0-否 ", "0-无;1-有", "1-高;2-低", "1-转入;2-转出", "x-GB/T 12406;1-甲", "成功,失败", "01：成功 02：失败", "(1)成功 (2)失败", "01-甲,02-乙", "-1-初始化;1-完成", "5-唯一", "1-甲;2-甲;3-乙", "冻结-银行-CLOP;关闭-CLOR", "1-有效;2-无效"])

#: Column -> expression over part: an application sheet with faults of every kind.
SHEET = {
    "row_index": K,
    "table_name": f"CASE WHEN {K} % 23 = 0 THEN '' ELSE p_brand END",
    "field_name": f"CASE {K} % 11 WHEN 0 THEN p_name WHEN 4 THEN '' WHEN 5 THEN '无' WHEN 9 THEN p_name || '交易时间' ELSE p_name || {pick(K, 13, ['编号', '客户号', '交易日期', '启用标志', '类型代码', '金额', '机构编号', '柜员号', '属性KEY值5', '近60天交易笔数', '产品组编号', '时间戳', '名称'])} END",
    "field_type": _CLASS,
    "domain_type": pick(K, 19, ["n..(10)", "an!(8)", "i(5)", "i(8, 2)", "DATE", "timestamp", "anc..()", "c..(4)", "x..(3)", "", "nc!(3)", "TIME", "a..(6)", " i(8,2) ", "ac..(5)", "Datetime", "an..(12)", "n!(16)", "anc..(20)"]),
    "data_example": pick(K, 29, ["1234567890", "AB12CD34", "-123", "12345.67", "2024-01-05", "20240105123000", "客户", "N/A", "12:30:45", "", "1.2.3", "1-2", "abc", "２", "2024/1/5 12:30:45.12", "A1", "0000000000000001", "12", "客1号", "+.5", "12:30:4x", "2024-01-05T10:11:12.x", "123456789", "无示例", "一二三四五", "1234567；12345678", "3.14159", " 42 ", "ab1"]),
    "is_enum": f"CASE WHEN {K} % 37 = 0 THEN 'maybe' WHEN {K} % 41 = 0 THEN '' WHEN {_IS_ENUM_CLASS} THEN (CASE WHEN {K} % 7 = 0 THEN '否' ELSE '是' END) ELSE (CASE WHEN {K} % 17 = 0 THEN '是' ELSE '否' END) END",
    "business_meaning": f"CASE {K} % 16 WHEN 0 THEN '' WHEN 1 THEN '无' ELSE 'definition of ' || p_name || ' ' || p_type END",
    "enum_values": f"CASE WHEN {_IS_ENUM_CLASS} THEN {_ENUM_LISTS} WHEN {K} % 19 = 0 THEN '1-x;2-y' WHEN {K} % 29 = 0 THEN '无' WHEN {K} % 43 = 0 THEN '/' ELSE '' END",
    "business_caliber": pick(K, 3, ["取账户表，判断金额大于0，交易创建时间大于统计日减N天", "", "人工录入"]),
}
SHEET_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in SHEET.items()) + " FROM part"


def sheet(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").selectExpr(*[f"{e} AS {c}" for c, e in SHEET.items()])


C = "c_custkey"
#: A dictionary of standards with repeated ids over customer: the id repeats for every fifth customer.
DICTIONARY = {
    "pos": C,
    "std_id": f"'D' || lpad(CAST((CASE WHEN {C} % 5 = 0 THEN {C} // 2 ELSE {C} END) AS STRING), 7, '0')",
    "std_name": f"c_name || {pick(C, 7, ['编号', '名称', '类型代码', '启用标志', '日期', '金额', ' '])}",
    "std_name_en": f"CASE {C} % 3 WHEN 0 THEN 'STATUS CODE' WHEN 1 THEN 'Account type ' ELSE '' END",
    "phys_name": f"CASE {C} % 3 WHEN 0 THEN 'STS_CD' WHEN 1 THEN 'ACCOUNT_TYPE_OF_THE_CUSTOMER' ELSE 'ACT_' END",
    "std_type": pick(C, 6, ["数值类", "编码类", "代码枚举类", "日期时间类", "标志类", "文本类"]),
    "definition": f"CASE WHEN {C} % 11 = 0 THEN '  ' ELSE 'balance of ' || c_mktsegment || ' 客户' || CAST({C} % 100 AS STRING) END",
    "caliber": f"CASE WHEN {C} % 4 = 0 THEN '' ELSE 'caliber ' || CAST({C} % 9 AS STRING) END",
    "rule": pick(C, 36, ["1-a", "1-x", "1-是;0-否", "", "y", "", "", "", "01-成功;02-失败;03-处理中", "", "", "", "", "", "参考《GB/T 12406》", "", "", "", "", "", "1-男;2-女;0-未知", "", "", "", "", "", "AA-甲，BB-乙", "", "", "", "", "", "1、正常 2、冻结", "", "", "--"]),
    "domain_hint": pick(C, 10, ["机构号", "时间戳", "通用编号", "标志", "日期", "", "金额", "名称", "客户号", "编号"]),
    "domain_id": f"CASE WHEN {C} % 13 = 0 THEN '' ELSE 'CDE' || lpad(CAST({C} % 40 AS STRING), 5, '0') END",
    "domain_name": f"'域' || CAST({C} % 40 AS STRING)",
    "domain_type": pick(C, 5, ["n..(10)", "DATE", "i(8,2)", "anc..(20)", ""]),
    "enum_id": f"CASE WHEN {C} % 6 <> 2 OR {C} % 17 = 0 THEN '' ELSE 'ENM' || lpad(CAST({C} % 25 AS STRING), 5, '0') END",
}


def _spark(e: str) -> str:
    return e.replace("//", "DIV")


DICTIONARY_SQL = "SELECT " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in DICTIONARY.items()) + " FROM customer"


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").selectExpr(*[f"{_spark(e)} AS {c}" for c, e in DICTIONARY.items()])


S = "s_suppkey"
DOMAINS = {
    "pos": S,
    "domain_id": f"CASE WHEN {S} % 19 = 0 THEN ' ' ELSE 'CDE' || lpad(CAST({S} % 60 AS STRING), 5, '0') END",
    "domain_name": pick(S, 9, ["通用编号", "时间戳1", "标志", "日期", "金额", "客户号", "名称", "时间戳2", "编号"]),
    "domain_type": pick(S, 4, ["n..(10)", "DATE", "anc..(20)", "i(8,2)"]),
    "std_type": pick(S, 4, ["编码类", "日期时间类", "标志类", "文本类"]),
    "enum_id": f"CASE WHEN {S} % 2 = 0 THEN '' ELSE 'ENM' || lpad(CAST({S} % 25 AS STRING), 5, '0') END",
}
DOMAINS_SQL = "SELECT " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in DOMAINS.items()) + " FROM supplier"


def domains(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/supplier.parquet").selectExpr(*[f"{_spark(e)} AS {c}" for c, e in DOMAINS.items()])


#: Scorer results over conversations: rows repeat as conversations have several turns, every seventh is lacking.
RESULTS = {
    "row_index": "conv_id", "arrival": "turn", "verdict": "role", "is_ok": "turn % 2 = 0",
}
RESULTS_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in RESULTS.items()) + " FROM conversations WHERE conv_id % 7 <> 3"


def results(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").where("conv_id % 7 <> 3").selectExpr(*[f"{e} AS {c}" for c, e in RESULTS.items()])


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")
