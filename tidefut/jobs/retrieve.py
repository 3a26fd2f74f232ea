"""Retrieval of bulletin rows: by ticker or by root, in a date range, treated."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.maturity import estimate_maturity
from ..operators.merge import normalize_old_tickers
from ..operators.treatments import resolve_treatment
from ..sources import store
from .update import STORED, promoted_names

#: Tickers that are named one by one in a scan's filter; more are matched by a join.
NAMED_TICKERS = 1_000


def filter_date_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive; open start, today as the default end. A start after the end is an error."""
    until = end or dt.date.today().isoformat()
    if start and dt.date.fromisoformat(start) > dt.date.fromisoformat(until):
        raise ValueError("start is after end")
    out = df.where(F.col("date") <= F.lit(until).cast("date"))
    return out.where(F.col("date") >= F.lit(start).cast("date")) if start else out


def get_contracts(df: DataFrame, tickers: list[str], start: str | None = None, end: str | None = None, treatment="ohlcv_drop0", ordered: bool = False) -> DataFrame:
    """Rows of the tickers, treated. An empty table, and tickers of which the table has none, are errors."""
    wanted = [t.strip().upper() for t in tickers]
    rows = df.where(F.col("ticker").isin(wanted))
    if rows.isEmpty():
        raise ValueError("the table is empty" if df.isEmpty() else f"no rows of {', '.join(wanted)}")
    out = filter_date_range(rows, start, end).transform(resolve_treatment(treatment))
    return out.orderBy("date", "ticker") if ordered else out


def stored_bulletins(spark: SparkSession, folder: str, roots: list[str] | None = None, start: str | None = None, end: str | None = None, extras: bool = False) -> DataFrame:
    """Rows of a store (``jobs.update``) from the partitions of these roots and years; columns without a canonical name where they were promoted, all of them with ``extras``."""
    rows = store.read_bulletins(spark, f"{folder}/bulletins", roots, start, end, promoted_names(spark, folder), STORED)
    return filter_date_range(rows if extras else rows.drop("extras"), start, end)


def get_stored_bulletins(spark: SparkSession, folder: str, roots: list[str] | None = None, start: str | None = None, end: str | None = None, **options) -> DataFrame:
    """``get_bulletins`` from a store's partitions. As there, roots are those stored, before old tickers are mapped."""
    named = [r.strip().upper() for r in roots] if roots else None
    return get_bulletins(stored_bulletins(spark, folder, named, start, end), roots, start, end, **options)


def get_stored_contracts(spark: SparkSession, folder: str, tickers: list[str] | DataFrame, start: str | None = None, end: str | None = None, treatment="ohlcv_drop0", ordered: bool = False) -> DataFrame:
    """``get_contracts`` from a store's partitions, for a list of tickers or a table with a column ``ticker``.

    A stored ticker begins with its root, so its beginnings tell which roots to read; a date range tells the
    years. Up to ``NAMED_TICKERS`` tickers are named in the scan's filter; for more, the roots are those of the store that
    a ticker begins with, and the rows are matched by a semi join. An empty store, and tickers of which it has none, are errors.
    """
    if not isinstance(tickers, DataFrame):
        tickers = spark.createDataFrame([(t,) for t in tickers], "ticker string")
    wanted = tickers.select(F.upper(F.btrim("ticker", F.lit(S.SPACE))).alias("ticker")).where("ticker <> ''").distinct()
    few = [r["ticker"] for r in wanted.limit(NAMED_TICKERS + 1).collect()]
    if len(few) <= NAMED_TICKERS:
        roots = sorted({t[:n] for t in few for n in range(1, len(t) + 1)})
        rows = stored_bulletins(spark, folder, roots, start, end).where(F.col("ticker").isin(few))
    else:
        begin = wanted.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("ticker")), lambda n: F.substring("ticker", F.lit(1), n))).alias("root")).distinct()
        # a row for each root that the store has
        have = store.read_table(spark, f"{folder}/bulletins").select("root").distinct().join(begin, "root", "left_semi")
        rows = stored_bulletins(spark, folder, [r["root"] for r in have.collect()], start, end).join(wanted, "ticker", "left_semi")
    if rows.isEmpty():
        anywhere = store.read_table(spark, f"{folder}/bulletins", STORED).select("ticker")
        if anywhere.isEmpty():
            raise ValueError("the table is empty")
        if anywhere.join(wanted, "ticker", "left_semi").isEmpty():
            raise ValueError(f"no rows of {', '.join(few[:10])}{' and others' if len(few) > 10 else ''}")
    out = rows.transform(resolve_treatment(treatment))
    return out.orderBy("date", "ticker") if ordered else out


def get_bulletins(df: DataFrame, roots: list[str] | None = None, start: str | None = None, end: str | None = None, treatment="clean_data", ordered: bool = False) -> DataFrame:
    """The root filter comes before old tickers are mapped. An empty table is an error, a root without rows is not."""
    if df.isEmpty():
        raise ValueError("the table is empty")
    if roots:
        df = df.where(F.col("root").isin([r.strip().upper() for r in roots]))
    out = normalize_old_tickers(filter_date_range(df, start, end)).transform(resolve_treatment(treatment, aggregate=True))
    out = estimate_maturity(out) if "ticker" in out.columns else out
    return out.orderBy("date", "root", "ticker") if ordered else out
