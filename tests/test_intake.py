"""Names counted while files arrive, replays included, and variants by a table of synonyms."""

from pyspark.sql import functions as F

from fieldwright.operators import mapping
from fieldwright.streaming import intake

ROWS = "row_index long, table_name string, field_name string"


def batch(spark, n):
    return spark.createDataFrame([(n * 10 + i, "t " if i % 2 else "t", ["a", "b", f"only{n}", "", f"pair{(n + i) // 3}"][i % 5]) for i in range(6)], ROWS)


def test_a_replay_counts_once(spark, tmp_path):
    path, all_rows = f"{tmp_path}/counts", None
    for n in range(9):
        intake.count_names(batch(spark, n), path, n, merged=3)
        if n in (2, 4, 5):  # the batch runs again, also after its counts have been added up
            intake.count_names(batch(spark, n), path, n, merged=3)
        all_rows = batch(spark, n) if all_rows is None else all_rows.unionByName(batch(spark, n))
        if n % 4 == 3 or n == 8:
            want = {(r.t, r.f) for r in intake.duplicates_of(all_rows).select(F.trim("table_name").alias("t"), F.trim("field_name").alias("f")).collect()}
            got = {(r.table_name, r.field_name): r.n for r in intake.duplicate_names(spark, path).collect()}
            assert set(got) == want and got["t", "a"] == 2 * (n + 1) and ("t", "") not in got
    assert len(list((tmp_path / "counts").iterdir())) <= 2 + 2 * 3 + 1


def test_nothing_counted_yet(spark, tmp_path):
    assert intake.duplicate_names(spark, f"{tmp_path}/none").count() == 0


def test_variants_by_ten_thousand_groups(spark):
    groups = [(g, p, f"{g}{'abc'[p]}") for g in range(10_000) for p in range(3)] + [(20_000, 0, "编号"), (20_000, 1, " 号 "), (20_001, 0, "alone"), (20_002, 0, "x"), (20_002, 1, ""), (20_003, 0, "7a"), (20_003, 1, "seven")]
    fields = [(0, "客户编号"), (1, "客户号"), (2, "name1234b"), (3, "name7a"), (4, "alone"), (5, "x"), (6, ""), (7, None), (8, "号"), (9, "no suffix")] + [(i, "hot号") for i in range(10, 400)]
    got: dict = {}
    for r in mapping.name_variants_by(spark.createDataFrame(fields, "row_index long, field_name string"), spark.createDataFrame(groups, "group_id long, pos int, suffix string")).collect():
        got.setdefault(r.row_index, {})[r.variant_pos] = r.variant
    plain = {i: [v[k] for k in sorted(v)] for i, v in got.items()}
    want = {0: ["客户编号", "客户号"], 1: ["客户号", "客户编号"], 2: ["name1234b", "name1234a", "name1234c"], 3: ["name7a", "nameseven"], 4: ["alone"], 5: ["x"], 6: [""], 7: [None], 8: ["号", "编号"], 9: ["no suffix"]}
    assert {i: plain[i] for i in range(10)} == want and all(plain[i] == ["hot号", "hot编号"] for i in range(10, 400))


def test_a_batch_is_many_tasks(spark, sf, tmp_path, monkeypatch):
    """The intake queries land each batch by several tasks, so that more cores shorten it."""
    from fieldwright.queries import QUERIES
    from fieldwright.sources import tables

    monkeypatch.setattr(tables, "shared_dir", lambda spark: str(tmp_path))
    QUERIES["j1_duplicates"](spark, sf).count()
    landed = [list(b.glob("*.parquet")) for b in tmp_path.glob("intake-*/out/batch_id=*")]
    assert len(landed) == 4 and all(len(files) > 1 for files in landed)
