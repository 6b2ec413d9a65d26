"""Every registered query with SQL gives what DuckDB gives."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from fieldwright import queries as base

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df: pd.DataFrame) -> pd.DataFrame:
    def cell(v):
        if v is None or v is pd.NA or isinstance(v, float) and np.isnan(v):
            return ""
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = [cell(v) for v in df[c].astype(object)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(base.ORACLE_SQL))
def test_query_matches_sql(spark, sf, duck, name):
    got, want = plain(base.QUERIES[name](spark, sf).toPandas()), plain(duck.execute(base.ORACLE_SQL[name]).df())
    assert len(want) > 0
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("name", ["g4_ids", "i3_domains"])
def test_ids_of_six_digits(spark, sf, tmp_path, name):
    """More than 99,999 enum standards: the queries cut numbers as their SQL does, the operator's ids stay unique."""
    from fieldwright.operators import dictionary as dic
    from fieldwright.queries import derive

    n = 6 * 100_050
    spark.range(n).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "1 AS c_nationkey", "0D AS c_acctbal", "'BUILDING' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet(f"{sf}/supplier.parquet").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = plain(base.QUERIES[name](spark, str(tmp_path)).toPandas()), plain(con.execute(base.ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want)
    own = dic.new_enum_domains(derive.dictionary(spark, str(tmp_path)).where("std_type = '代码枚举类'"))
    assert own.select("domain_id").distinct().count() == own.count() == 100_050


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
