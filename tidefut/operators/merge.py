"""Deduplication, sessions and day replacement of bulletin tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def dedupe_contract_rows(df: DataFrame) -> DataFrame:
    """One row for each date and ticker: the largest contract code, then the latest arrival. Partial aggregation first."""
    order = [F.coalesce("contract_code", F.lit("")), *([F.col("arrival_seq")] if "arrival_seq" in df.columns else [])]
    row = F.max_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.struct(*order)).alias("r")
    return df.groupBy(F.col("date").alias("_d"), F.col("ticker").alias("_t")).agg(row).select("r.*")


def union_by_name(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def contract_keys(df: DataFrame) -> DataFrame:
    code = S.contract_code(F.col("contract_code"))
    return df.withColumn("contract_code", code).withColumn("ticker", S.ticker_of(F.col("contract_code"), F.col("root")))


def prepare_root_rows(df: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """What a root's table holds: codes and tickers in their one form, without skipped days, one row for each date and ticker."""
    rows = contract_keys(df) if "contract_code" in df.columns else df
    return dedupe_contract_rows(rows if skip is None else without_days(rows, skip))


def without_days(df: DataFrame, days: DataFrame) -> DataFrame:
    return df.join(days.select("root", "date").distinct(), ["root", "date"], "left_anti")


def promote(df: DataFrame, names: list[str]) -> DataFrame:
    """Entries of the map ``extras`` as text columns of their own, beside what these columns hold already."""
    if not names or "extras" not in df.columns:
        return df
    cols = {n: F.coalesce(F.col(f"`{n}`"), F.col("extras")[n]) if n in df.columns else F.col("extras")[n] for n in names}
    return df.withColumns(cols).withColumn("extras", F.map_filter("extras", lambda k, _: ~k.isin(names)))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    counts = df.agg(*(F.count(F.col(c)).alias(c) for c in df.columns)).first().asDict()
    return df.select([c for c in df.columns if counts[c]])


def target_sessions(bounds: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """(root, date) of the weekdays from ``start`` to ``end`` of each root, without skipped days."""
    days = bounds.select("root", F.explode(F.sequence("start", "end")).alias("date")).where(S.is_business_day(F.col("date")))
    return without_days(days, skip) if skip is not None else days


def missing_sessions(sessions: DataFrame, reports: DataFrame) -> DataFrame:
    return without_days(sessions, reports)


def resume_dates(reports: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    rows = without_days(reports, skip) if skip is not None else reports
    return rows.groupBy("root").agg(F.date_add(F.max("date"), 1).alias("resume"))


def merge_days(current: DataFrame, additions: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Days in ``additions`` replace the same days of ``current``; skipped days go from both."""
    kept = without_days(current, additions)
    return prepare_root_rows(kept.unionByName(additions, allowMissingColumns=True), skip)


def refresh_aggregate(existing: DataFrame, roots: DataFrame, selected: list[str]) -> DataFrame:
    """The selected roots' rows from ``roots``, all others from ``existing``."""
    old = existing.where(~F.col("root").isin(selected))
    return old.unionByName(roots.where(F.col("root").isin(selected)), allowMissingColumns=True)


def normalize_old_tickers(df: DataFrame) -> DataFrame:
    new = S.old_ticker(F.col("ticker"))
    old_root = F.substring("ticker", 1, 3)
    mapped = F.coalesce(S.lookup(S.OLD_ROOTS, F.col("root")), F.when(F.col("root") == old_root, F.substring(new, 1, 3)), F.col("root"))
    out = df.withColumn("_new", new).withColumn("root", F.when(F.col("_new").isNotNull(), mapped).otherwise(F.col("root")))
    cols = {c: F.coalesce("_new", c) for c in ("ticker", "contract_code") if c in df.columns}
    return out.withColumns(cols).drop("_new")
