"""Daily futures quotes derived from the driver's ``lineitem`` table, in SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEMPLATE = """
SELECT date, root,
  concat(root, substr('FGHJKMNQUVXZ', CAST(mi % 12 AS INT) + 1, 1),
         lpad(CAST(CAST(floor(mi / 12.0) AS INT) % 100 AS VARCHAR(4)), 2, '0')) AS ticker,
  min_by(px, k) AS open, max(px) AS high, min(px) AS low, max_by(px, k) AS close,
  CAST(sum(q) AS DOUBLE) AS volume_qty, CAST(sum(px * q) AS DOUBLE) AS volume, count(*) AS trade_count
FROM (SELECT CAST({day} AS DATE) AS date,
  CASE l_suppkey % 6 WHEN 0 THEN 'DOL' WHEN 1 THEN 'WIN' WHEN 2 THEN 'CCM'
                     WHEN 3 THEN 'BGI' WHEN 4 THEN 'ICF' ELSE 'DI1' END AS root,
  CAST(year({day}) * 12 + month({day}) - 1 + l_partkey % 3 AS INT) AS mi,
  1000 + CAST(CAST(floor(l_extendedprice) AS BIGINT) % 257 AS DOUBLE) / 4 AS px, l_quantity AS q,
  ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 2000 + l_suppkey AS k FROM {source}) b
GROUP BY date, root, mi
"""

DAILY = TEMPLATE.format(day="l_shipdate", source="lineitem")
WEEKLY = TEMPLATE.format(day="date_trunc('week', l_shipdate)", source="lineitem")


def quotes(spark: SparkSession, sf_dir: str, weekly: bool = False) -> DataFrame:
    day = "date_trunc('week', l_shipdate)" if weekly else "l_shipdate"
    return spark.sql(TEMPLATE.format(day=day, source="{lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
