"""Quoted CSV read by many tasks equals reading by one."""

import csv

import numpy as np
import pytest

from fieldwright.sources import quoted, tables


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_of(seed, n, wide=30):
    rng = np.random.default_rng(seed)
    bits = ["plain", "two words", "line\nend", 'a "quoted" word', "comma, here", "漢字", "", "\n\n", '"', "tail ", "semi;colon", "x" * 200]
    return [[str(i), "".join(bits[k] for k in rng.integers(0, len(bits), rng.integers(0, wide))), bits[int(rng.integers(0, len(bits)))], "end"] for i in range(n)]


def write(path, rows, end="\n"):
    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["key", "long\ncell", "other", "last"])
        w.writerows(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_tasks_read_what_one_reads(spark, small_splits, tmp_path, end):
    rows = rows_of(1, 1500)
    rows[700][1] = "long record\n" * 9000  # over several splits
    write(f"{tmp_path}/a.csv", rows, end)
    got = quoted.read_quoted_csv(spark, f"{tmp_path}/a.csv")
    assert got.columns == ["row_index", "key", "long\ncell", "other", "last"]
    lines = quoted._lines(spark, f"{tmp_path}/a.csv")
    assert lines.rdd.getNumPartitions() > 20
    found = sorted(map(tuple, got.collect()))
    assert [r[0] for r in found] == list(range(1500)) and [r[1] for r in found] == [r[0] for r in rows]
    assert [tuple(c or "" for c in r[1:]) for r in found] == [tuple(r) for r in rows]
    if end != "\n":  # Spark's reader leaves the carriage returns of such files in their last cells
        return
    plain = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", "-1").csv(f"{tmp_path}/a.csv")
    assert sorted(tuple(c or "" for c in r) for r in plain.collect()) == sorted(tuple(c or "" for c in r[1:]) for r in found)


def test_files_of_a_folder_are_numbered_on(spark, small_splits, tmp_path):
    a, b, c = rows_of(2, 300), rows_of(3, 1), rows_of(4, 300)
    for name, rows in (("a", a), ("b", b), ("c", c)):
        write(f"{tmp_path}/{name}.csv", rows)
    (tmp_path / "d.csv").write_text("\n\n")
    (tmp_path / "e.csv").write_text('key,"long\ncell",other,last\n')
    got = sorted(map(tuple, quoted.read_quoted_csv(spark, str(tmp_path), columns=["key", "text", "other", "last"]).collect()))
    assert [r[0] for r in got] == list(range(601)) and [(r[1], r[2] or "") for r in got] == [(r[0], r[1]) for r in [*a, *b, *c]]


def test_a_sheet_from_many_tasks(spark, small_splits, tmp_path):
    write(f"{tmp_path}/a.csv", rows_of(5, 200))
    cells = quoted.read_quoted_csv(spark, f"{tmp_path}/a.csv", columns=["key", "text", "other", "last"])
    sheet = tables.load_sheet(cells, ["key", "text"], ["missing"], {"key": ["key"], "text": ["other", "text"], "missing": ["gone"]}, key="row_index")
    assert sorted((r.row_index, r.key) for r in sheet.collect()) == [(i, str(i)) for i in range(200)]
