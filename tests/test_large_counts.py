"""Report queries on tables whose counts need a mark between thousands."""

import duckdb
from pyspark.sql import functions as F

from tidefut.jobs import registry

from .test_futures import SF


def test_unknown_columns_with_counts_beyond_thousand(spark, tmp_path):
    few = spark.read.parquet(f"{SF}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber").limit(30)
    many = few.crossJoin(spark.range(1100)).withColumn("l_orderkey", F.col("l_orderkey") + 100_000 * F.col("id")).drop("id")
    many.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in registry.queries()["unknown_columns"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as con:
        con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
        want = set(con.execute(registry.oracle_sql()["unknown_columns"]).fetchall())
    assert any(r[4] and len(r[4]) > 4 for r in want)
    assert got == want
