"""Scalar rules against written cases."""

import random

import pytest
from pyspark.sql import functions as F

from fieldwright.functions import domain, enums, names, text
from fieldwright.operators import quality, retrieve


def column(spark, values, f, schema="v string"):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(f.alias("x")).collect()]


def test_parse_domain(spark):
    values = ["n..(10)", "an!(8)", " i(5) ", "i(8, 2)", "DATE", "timestamp", "anc..()", "n!()", "x..(3)", "", None, "i()", "ac..(007)"]
    got = column(spark, values, domain.parse_domain("v")["key"])
    assert got == ["n_var", "an_fix", "i_int", "i_dec", "date", "timestamp", "anc_var_nolimit", None, None, None, None, None, "ac_var"]


@pytest.mark.parametrize(
    ("kind", "sample", "ok"),
    [
        ("n..(4)", "1234", True), ("n..(4)", "12345", False), ("n..(4)", "12a", False), ("n!(4)", "123", False), ("a..(3)", "ab1", False), ("a..(3)", "客", False),
        ("an..(5)", "A1-_x", True), ("an..(5)", "客户", False), ("anc!(2)", "客1", True), ("c..(3)", "客户号", True), ("c..(3)", "客a", False), ("nc..(3)", "1客", True), ("nc..(3)", "a", False),
        ("ac..(3)", "客a", True), ("ac..(3)", "1", False), ("i(3)", "-123", True), ("i(3)", "1-2", True), ("i(3)", "1.0", False), ("i(3)", "+", False), ("i(1,3)", "1.2.3", True), ("i(2,1)", "12.34", False),
        ("i(2,1)", ".5", False), ("i(2,1)", "5.", True), ("DATE", "2024-1-5", True), ("DATE", "2024", False), ("DATE", "20240105.1", False), ("TIME", "12:30:45", True), ("TIME", "12:30:45.x", False),
        ("DATETIME", "20240105", False), ("DATETIME", "2024-01-05 10:11:12.123", True), ("TIMESTAMP", "202401051", True), ("DATETIME", "2024-01-05T10:11:12.", False), ("zz", "anything", True), ("n..(4)", "N/A", True),
        ("n..(4)", "  ", True), ("n..(4)", "２", False), ("anc..()", "x" * 500, True), (None, "x", True), ("n..(4)", None, True),
    ],
)
def test_sample_check(spark, kind, sample, ok):
    assert column(spark, [(kind, sample)], domain.sample_fault("k", "s"), "k string, s string") == [None] if ok else column(spark, [(kind, sample)], domain.sample_fault("k", "s"), "k string, s string") != [None]


def test_first_offending_character_is_named(spark):
    assert column(spark, [("n..(9)", "12客a")], domain.sample_fault("k", "s"), "k string, s string") == ["包含非法字符'客'（数字字符类仅允许数字）"]


def test_date_kind_prefers_date(spark):
    assert column(spark, ["2024-01-05", "12:30", "2024-01-05 10:11:12", "12:30:45", "无", "", None, "abc"], domain.date_kind("v")) == ["日期", "时间", "时间戳", "日期", None, None, None, None]


def test_strip_and_cells(spark):
    assert column(spark, ["　a　", "\n a \t", "NaN", None, "none ", "nat"], text.clean_cell("v")) == ["a", "a", "", "", "", ""]


def test_utf8_cut_never_splits_a_character(spark):
    values = ["abc", "客户号", "a客户", "é" * 10, "", "😀😀", "x�"]
    for most in range(1, 8):
        assert column(spark, values, text.utf8_cut("v", most)) == [v.encode()[:most].decode(errors="ignore") for v in values]


def test_enum_pairs(spark):
    pairs = lambda p: F.transform(p, lambda x: F.concat(x["code"], F.lit("="), x["value"]))
    assert column(spark, ["1-男; 2-女;;x", "-1-初始化", None, "a-b-c"], pairs(enums.pairs("v"))) == [["1=男", "2=女", "=x"], ["=1-初始化"], [], ["a=b-c"]]
    assert column(spark, ["1-男;x;GBT-1;2-参考《A》", ""], pairs(enums.valid_pairs("v"))) == [["1=男"], []]


def test_random_lists_against_a_plain_loop(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice("1a-; 男《x") for _ in range(rng.randrange(18))) for _ in range(300)]

    def loop(s):
        out = []
        for part in s.split(";"):
            part = part.strip()
            if part:
                code, cut, value = part.partition("-")
                out.append(f"{code.strip() if cut else ''}={value.strip() if cut else part}")
        return out

    got = column(spark, values, F.transform(enums.pairs("v"), lambda x: F.concat(x["code"], F.lit("="), x["value"])))
    assert got == [loop(s) for s in values]


def test_complementary(spark):
    values = [("通过", "不通过"), ("流入", "流出"), ("启用", "停用"), ("收款", "付款"), ("小", "大"), ("成立", "未成立"), ("甲", "乙")]
    assert column(spark, values, enums.complementary("a", "b"), "a string, b string") == [True, False, True, False, False, True, True]


def test_names(spark):
    assert column(spark, ["客户编号", "客户号", "客户", ""], names.name_variants("v")) == [["客户编号", "客户号"], ["客户号", "客户编号"], ["客户"], [""]]
    assert column(spark, ["创建时间", "交易时间戳", "委案日期", "登记"], names.datetime_name("v", F.lit("时间戳"))) == ["创建时间戳", "交易时间戳", "委案时间戳", "登记时间戳"]
    assert column(spark, ["数据权限代码KEY值5", "属性值5", "开卡日期", "123"], names.clean_name("v")["name"]) == ["数据权限代码", "属性", "开卡日期", "123"]


def test_key_item_note(spark):
    got = column(spark, [("机构编号", "1234567890"), ("机构编号", "12；1234567890"), ("产品组编号", "12345678"), ("客户号", ""), ("名称", "1")], quality.key_item_note("n", "s"), "n string, s string")
    assert [g is None for g in got] == [True, False, True, True, True]
    assert got[1].startswith("机构类字段数据示例长度为2位")


def test_json_array_out_of_a_fence(spark):
    s = 'text ```json\n[{"k": 1}, {"k": 2}]\n``` more'
    assert column(spark, [s, "none"], F.transform(text.json_array("v", "array<struct<k:int>>"), lambda x: x["k"])) == [[1, 2], None]


def test_tokens_of_both_scripts(spark):
    assert column(spark, ["Ab 12 客户号x", "户", None], retrieve.tokens("v")) == [["ab", "12", "x", "客户", "户号"], ["户"], []]
