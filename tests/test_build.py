"""The dictionary build in phases, against the outcome written by hand, and its going on from kept phases."""

from pyspark.sql import functions as F

from fieldwright.plans import build

COLS = "pos long, std_id string, std_name string, std_name_en string, phys_name string, std_type string, definition string, caliber string, rule string, domain_hint string, domain_id string, domain_name string, domain_type string, enum_id string"
ROWS = [
    (1, "S1", "开户日期", "OPEN DATE", "OPN_DT", "日期时间类", "d", "c1", "", "日期", "", "", "", ""),
    (2, "S2", "客户编号", "CUSTOMER NO", "CST_NO", "编码类", "d", "", "", "机构号", "", "", "", ""),
    (3, "S3", "启用标志", "ENABLED", "EN_FL", "标志类", "d", "", "1-是;0-否", "nothing", "", "", "", ""),
    (4, "S4", "交易金额", "AMOUNT", "AMT", "数值类", "d", "c4", "", "金额", "", "", "", ""),
    (5, "S5", "备注", "REMARK", "RMK", "文本类", "d", "", "", "名称", "", "", "", ""),
    (6, "S6", "账户状态", "ACCOUNT STATUS", "ACT_STS", "代码枚举类", "d", "c6", "1、正常 2、冻结", "", "", "", "", ""),
    (7, "S7", "币种代码", "CURRENCY CODE", "CCY_CD", "代码枚举类", "d", "", "参考《GB/T 12406》", "", "", "", "", ""),
    (8, "S8", "逾期标志", "OVERDUE", "OVD", "文本类", "d", "", "", "名称", "", "", "", ""),
    (9, "S9", "渠道代码", "CHANNEL CODE", "CHN_CD", "代码枚举类", "d", "", "unclear", "", "", "", "", ""),
]
DOMAINS = [(1, "D1", "日期", "DATE", "日期时间类", ""), (2, "D2", "通用编号", "n..(10)", "编码类", ""), (3, "D3", "标志", "n!(1)", "标志类", ""), (4, "D4", "金额", "i(8,2)", "数值类", "")]


def tables(spark):
    return spark.createDataFrame(ROWS, COLS), spark.createDataFrame(DOMAINS, "pos long, domain_id string, domain_name string, domain_type string, std_type string, enum_id string")


def test_the_build_in_phases(spark, tmp_path):
    dictionary, domains = tables(spark)
    proposed = spark.createDataFrame([("S4", "D4"), ("S5", "D4")], "std_id string, domain_id string")  # S5 is no number: its proposal does not fit
    rules = spark.createDataFrame([("S9", "A-柜面;BB-网银")], "std_id string, rule string")
    first = spark.createDataFrame([("S1", "", "new"), ("S6", "1-正常;2-冻结;3-销户", "")], "std_id string, new_rule string, new_caliber string")
    second = spark.createDataFrame([("S1", "", "newer")], "std_id string, new_rule string, new_caliber string")
    args = dict(proposed=proposed, rules=rules, corrections=[first, second], state=f"{tmp_path}/state")
    out = build.dictionary_build(dictionary, domains, path=f"{tmp_path}/out", **args)
    got = {r.std_id: (r.std_name, r.domain_id, r.domain_type, r.enum_id or "", r.rule, r.caliber, r.n_edits) for r in out["standards"].collect()}
    assert got == {
        "S1": ("开户日期", "D1", "DATE", "", "", "newer", 2), "S2": ("客户编号", "D2", "n..(10)", "", "", "", 0), "S3": ("启用标志", "D3", "n!(1)", "", "1-是;0-否", "", 0), "S4": ("交易金额", "D4", "i(8,2)", "", "", "c4", 0),
        "S6": ("账户状态代码", "CDE00001", "an..(2)", "ENM00001", "1-正常;2-冻结;3-销户", "", 2), "S7": ("币种代码", "CDE00002", "an..(20)", "ENM00002", "参考《GB/T 12406》", "", 0), "S9": ("渠道代码", "CDE00003", "an..(2)", "ENM00003", "A-柜面;BB-网银", "", 0),
    }
    assert sorted(map(tuple, out["details"].collect())) == [("ENM00001", "1", "正常"), ("ENM00001", "2", "冻结"), ("ENM00001", "3", "销户"), ("ENM00003", "A", "柜面"), ("ENM00003", "BB", "网银")]
    assert {r.domain_id for r in out["domains"].collect()} == {"D1", "D2", "D3", "D4", "CDE00001", "CDE00002", "CDE00003"}
    header = {r.enum_id: r.n_codes for r in spark.read.parquet(f"{tmp_path}/out/enum_header").collect()}
    assert header == {"ENM00001": 3, "ENM00002": 0, "ENM00003": 2}

    # a run that goes on reads the phases that are there, whatever it is given, and makes those that are not
    import shutil

    shutil.rmtree(f"{tmp_path}/state/corrected")
    again = build.dictionary_build(dictionary.limit(0), domains, corrections=[first], state=f"{tmp_path}/state", resume=True)["standards"]
    assert {r.std_id: r.caliber for r in again.collect()} == {i: "new" if i == "S1" else v[5] for i, v in got.items()}
    fresh = build.dictionary_build(dictionary.where("std_id = 'S1'"), domains)["standards"]
    assert [(r.std_id, r.n_edits) for r in fresh.collect()] == [("S1", 0)] and fresh.where(F.col("enum_id") != "").count() == 0
