"""Sources, sinks, reports and streaming on small tables."""

import pytest
from pyspark.sql import functions as F

from fieldwright.operators import dictionary as dic
from fieldwright.operators import report, retrieve
from fieldwright.plans import jobs
from fieldwright.sources import tables
from fieldwright.streaming import intake

SHEET = "row_index long, table_name string, field_name string, field_type string, domain_type string, data_example string, is_enum string, business_meaning string, enum_values string"
GOOD = [(0, "账户表", "客户编号", "编码类", "an!(16)", "0000000000000001", "否", "客户的编号", ""), (1, "账户表", "性别", "代码枚举类", "an..(2)", "1", "是", "客户的性别", "1-男;2-女")]


def test_sheet_from_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text('中文字段名(必填),字段所属类型(必填),业务口径\n客户号,编码类,"a\nb"\nNaN, 文本类 ,\n', encoding="utf-8")
    raw = tables.read_cells(spark, str(tmp_path / "s.csv"))
    rows = tables.load_sheet(raw, ["field_name", "field_type"], ["business_caliber", "enum_values"]).orderBy("row_index").collect()
    assert [tuple(r) for r in rows] == [(0, "客户号", "编码类", "a\nb", ""), (1, "", "文本类", "", "")]


@pytest.mark.parametrize("kind", ["json", "parquet"])
def test_sheet_from_other_formats(spark, tmp_path, kind):
    cells = spark.createDataFrame([("客户号", None, 5), ("nan", " 文本类 ", None)], "`中文字段名(必填)` string, `字段所属类型(必填)` string, `业务口径` int")
    cells.coalesce(1).write.format(kind).save(str(tmp_path / "s"))
    rows = tables.load_sheet(tables.read_cells(spark, str(tmp_path / "s"), kind), ["field_name", "field_type"], ["business_caliber"]).orderBy("row_index").collect()
    assert [tuple(r) for r in rows] == [(0, "客户号", "", "5"), (1, "", "文本类", "")]


def test_missing_column_is_named(spark):
    with pytest.raises(tables.MissingColumns, match="域类型"):
        tables.load_sheet(spark.createDataFrame([("a",)], "x string"), ["domain_type"])


def test_batches_written_again_change_nothing(spark, tmp_path):
    df = spark.range(250).withColumnRenamed("id", "row_index").withColumn("v", F.lit(1))
    path = str(tmp_path / "out")
    tables.write_batches(df, path, rows=100)
    tables.write_batches(df.where("row_index < 100").withColumn("v", F.lit(2)), path, rows=100)
    got = spark.read.parquet(path).groupBy("batch").agg(F.sum("v").alias("s"), F.count("*").alias("n")).orderBy("batch").collect()
    assert [tuple(r) for r in got] == [(0, 200, 100), (1, 100, 100), (2, 50, 50)]


def test_export_has_four_tables(spark, tmp_path):
    std = spark.createDataFrame([("B", "E1", "d", "1-a;2-b", "D1", "an..(2)"), ("A", "", "d", "", "D2", "i(3)")], "std_id string, enum_id string, domain_name string, rule string, domain_id string, domain_type string")
    details = std.where("enum_id != ''").select("enum_id", F.explode(F.array(F.lit("1"), F.lit("2"))).alias("code"))
    tables.export_dictionary(std, std.select("domain_id"), details, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/enum_header").select("enum_id", "n_codes").collect() == [("E1", 2)]
    files = [spark.read.parquet(f"{tmp_path}/{t}") for t in ("standards", "domains", "enum_detail")]
    assert [r.std_id for r in files[0].collect()] == ["A", "B"] and files[0].columns == std.columns
    assert {r.domain_id for r in files[1].collect()} == {"D1", "D2"} and sorted(map(tuple, files[2].collect())) == [("E1", "1"), ("E1", "2")]


def test_topk_in_blocks_equals_broadcast(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q, i = e.where("vec_id < 40").withColumnRenamed("vec_id", "q"), e.withColumnRenamed("vec_id", "i")
    args = dict(k=7, query_id="q", item_id="i", vec="embedding", by="label")
    a = retrieve.topk_cosine(q, i, **args).toPandas().sort_values(["q", "i"]).reset_index(drop=True)
    b = retrieve.topk_cosine(q, i, **args, query_rows=7, block_numbers=900).toPandas().sort_values(["q", "i"]).reset_index(drop=True)
    assert a[["q", "i"]].equals(b[["q", "i"]]) and len(a) == 280


def test_topk_of_nothing(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "q long, vector array<double>")
    none = spark.createDataFrame([], "i long, vector array<double>")
    assert retrieve.topk_cosine(q, none, 3, "q", "i").count() == 0


def test_quality_job(spark):
    bad = [(2, "账户表", "abc", "编码类", "an!(16)", "1", "否", "x", ""), (3, "账户表", "性别", "代码枚举类", "", "", "是", "", "1-男;2-女")]
    sheet = spark.createDataFrame(GOOD + bad, SHEET)
    got = {r.row_index: (r.check_result, r.fail_reason) for r in jobs.quality_check(sheet, ask_meaning=False).collect()}
    assert len(got) == 4 and got[0] == ("通过", "") and got[2][0] == "不通过" and "重复" in got[1][1] and "重复" in got[3][1] and "必填字段为空: 域类型, 数据示例, 业务定义" in got[3][1]


def test_quality_job_with_scorers(spark):
    def meaning(pdf):
        return pdf[["row_index"]].assign(is_meaningful=pdf["row_index"] == 0, reasoning="空泛")

    def antonym(pdf):
        return pdf[["row_index"]].assign(is_antonym=True, reasoning="")

    rows = {r.row_index: r for r in jobs.quality_check(spark.createDataFrame(GOOD, SHEET), meaning=meaning, antonym=antonym).collect()}
    assert rows[0].check_result == "通过" and (rows[1].check_result, rows[1].fail_reason) == ("不通过", "1. 空泛")


def test_stream_replay_changes_nothing(spark, tmp_path):
    spark.createDataFrame(GOOD, SHEET).repartition(2).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        q = intake.start_intake(intake.read_sheets(spark, f"{tmp_path}/in", SHEET), f"{tmp_path}/out", f"{tmp_path}/state")
        q.awaitTermination()
    spark.createDataFrame([(9, *GOOD[0][1:])], SHEET).write.mode("append").parquet(f"{tmp_path}/in")
    intake.start_intake(intake.read_sheets(spark, f"{tmp_path}/in", SHEET), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 3 and out.select("row_index").distinct().count() == 3
    assert {r.row_index for r in intake.duplicates_of(out.drop("batch_id")).collect()} == {0, 9}


def test_write_back_keeps_every_row(spark):
    sheet = spark.createDataFrame(GOOD, SHEET)
    out = tables.write_back(sheet, spark.createDataFrame([(1, "x")], "row_index long, check_result string"))
    assert {r.row_index: r.check_result for r in out.collect()} == {0: "", 1: "x"}


def test_comparison_reports_counts_and_columns(spark):
    a, b = spark.createDataFrame([(0, "1.0", 2)], "row_index long, x string, y int"), spark.createDataFrame([(0, " 1", 3), (1, "z", 1)], "row_index long, x string, y int")
    found, counts = report.compare(a.drop("y").withColumn("z", F.lit(1)), b, ["x", "y"])
    c = counts.first()
    assert found.count() == 0 and (c.n_actual, c.n_expected, c.missing_actual, c.missing_expected) == (1, 2, ["y"], [])


def test_overlay_blanks_an_omitted_caliber(spark):
    d = spark.createDataFrame([("A", "r", "c"), ("B", "r", "c")], "std_id string, rule string, caliber string")
    fix = spark.createDataFrame([("A", "", None)], "std_id string, new_rule string, new_caliber string")
    assert sorted(tuple(r) for r in dic.overlay(d, fix).collect()) == [("A", "r", "", 1), ("B", "r", "c", 0)]
    assert sorted(tuple(r) for r in dic.overlay(d, fix, keep_caliber_if_absent=True).collect()) == [("A", "r", "c", 0), ("B", "r", "c", 0)]
