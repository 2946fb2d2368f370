"""Parts whose keys go beyond five digits share their tickers' letters, and so the ids of signals."""

import duckdb
import pytest

from tidemark import registry

Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", ["join26_annotated_tickers", "dml07_reclassify", "dml08_reextract"])
def test_equals_sql(spark, tmp_path, name):
    twins = [(k, 10 * k + -9 * k % 365) for k in range(10_000, 12_000) if -9 * k % 365 < 10]  # of one ticker and one day
    keys = [k for pair in twins for k in pair] + [k * 2 for k in range(10_000, 10_040)] + list(range(40))
    rows = [(k, f"name {k % 90}", f"brand{k % 7}", k % 365 % 31) for k in sorted(set(keys))]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    df = Q[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
