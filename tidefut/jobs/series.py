"""Continuous series that are kept on storage and grow by days.

A folder of tables: ``days`` (series, date, front contract, listed prices; by series and year), ``rolls``, and ``segments``, what
prices are multiplied by from one roll until the next. Stored days bear no factor, so a new day leaves the stored ones alone: it
adds itself, and where it rolls, a segment; the factors of a series' segments are a few numbers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import continuous as C
from ..sources import store

ROLLS = "series string, from_ticker string, to_ticker string, switch_date date, bridge_date date, from_close double, to_close double, backward_factor double, forward_factor double"


def append_days(spark: SparkSession, quotes: DataFrame, folder: str, series: dict[str, list[str]], days_before_roll: float = 5, months: str | list[str] | None = None, rules=None) -> None:
    """Takes the days of ``quotes`` into the series below ``folder``; days that are stored already are replaced.

    Only the (series, year) partitions of these days are rewritten, and only rolls from a series' first new day on are
    found again. Staged first, so a run that failed may be run again.
    """
    if "maturity" not in quotes.columns and {"ticker", "date"} <= set(quotes.columns):
        quotes = C.with_calendar(quotes, rules)
    n, letters = C.validate_quotes(quotes, days_before_roll, months, rows=False)
    stage = f"{folder}/staging/{uuid.uuid4().hex}"

    def staged(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{stage}/{name}")
        return spark.read.schema(df.schema).parquet(f"{stage}/{name}")

    year = F.year("date").alias("year")
    new = staged(C.trading_days(C.select_universe(quotes, series, letters, dated=False), n), "new")
    cut = new.groupBy("series").agg(F.min("date").alias("cut"))
    firsts = {r["series"]: r["cut"] for r in cut.collect()}  # a row for each series of the argument
    if not firsts:
        store.delete_folder(spark, stage)
        return
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema) + ", year int"
    stored = store.read_table(spark, f"{folder}/days", schema)
    touched = new.select("series", year).distinct()
    years = [r["year"] for r in touched.select("year").distinct().collect()]  # names the partitions to read
    kept = stored.where(F.col("year").isin(years)).join(F.broadcast(touched), ["series", "year"], "left_semi").drop("year").join(new.select("series", "date"), ["series", "date"], "left_anti")
    rows = staged(kept.unionByName(new).withColumn("year", F.year("date")), "days")
    rows.repartition("series", "year").sortWithinPartitions("series", "year", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("series", "year").parquet(f"{folder}/days")
    days = store.read_table(spark, f"{folder}/days").where(F.col("series").isin(list(firsts)))
    ticker = F.col("front.ticker").alias("ticker")
    # the day before a series' first new one stands for all earlier days
    narrow = days.select("series", "date", "year", ticker).join(F.broadcast(cut), "series")
    last = narrow.where("date < cut").groupBy("series").agg(F.max(F.struct("date", "ticker")).alias("x")).select("series", "x.*")
    since = narrow.where(F.col("year") >= min(firsts.values()).year).where("date >= cut").select("series", "date", "ticker")
    rolls = C.roll_schedule(C.detect_rolls(last.unionByName(since)), days.drop("year"))
    before = store.read_table(spark, f"{folder}/rolls", ROLLS).join(F.broadcast(cut), "series", "left").where("cut is null or switch_date < cut").drop("cut")
    rolls = staged(before.unionByName(rolls), "rolls")
    rolls.write.mode("overwrite").parquet(f"{folder}/rolls")
    C.factor_segments(rolls).write.mode("overwrite").parquet(f"{folder}/segments")
    store.delete_folder(spark, stage)


def stored_series(spark: SparkSession, folder: str, names: list[str] | None = None, start: str | None = None, end: str | None = None, backward: bool = True) -> DataFrame:
    """Adjusted rows of the series named (all by default), from the partitions of these series and years."""
    days = store.years_between(store.read_table(spark, f"{folder}/days"), start, end)
    if names is not None:
        days = days.where(F.col("series").isin(names))
    for bound, keep in ((start, lambda d: F.col("date") >= d), (end, lambda d: F.col("date") <= d)):
        days = days.where(keep(F.lit(bound).cast("date"))) if bound else days
    return C.adjusted_rows(days.select("series", "date", "front.*"), store.read_table(spark, f"{folder}/segments"), backward)
