"""Continuous series of many roots at once: front contracts, rolls, bridges, ratio adjustment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.maturity import with_calendar
from ..sources.folders import new_path

PRICES = ["open", "high", "low", "close"]


@dataclass
class Series:
    """The adjusted rows and the tables behind them."""

    rows: DataFrame
    active: DataFrame
    rolls: DataFrame
    spec: DataFrame


NUMERIC = ["open", "high", "low", "close", "volume", "volume_qty", "settlement_price", "average_price"]


def _names(values) -> list[str]:
    """Trimmed, in upper case, each once; blanks go."""
    return list(dict.fromkeys(v.strip().upper() for v in values if v and v.strip()))


def validate_quotes(df: DataFrame, days_before_roll: float, months: str | list[str] | None = None, rows: bool = True) -> tuple[int, list[str] | None]:
    """The whole days before a roll and the month letters (None: all); wrong arguments and tables without a needed column or a row are errors."""
    missing = {"date", "root", "ticker", "maturity", "close"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    if isinstance(days_before_roll, bool) or not isinstance(days_before_roll, (int, float)) or days_before_roll != days_before_roll:
        raise ValueError("days_before_roll must be one number")
    if int(days_before_roll) < 0:
        raise ValueError("days_before_roll must not be negative")
    letters = None if months is None else _names([months] if isinstance(months, str) and months.strip().upper() == "ALL" else months)
    if letters == []:
        raise ValueError("months must name one month letter at least")
    if rows and df.isEmpty():
        raise ValueError("no quotes")
    return int(days_before_roll), None if letters == ["ALL"] else letters


def select_universe(quotes: DataFrame, series: dict[str, list[str]], months: list[str] | None = None, dated: bool = True) -> DataFrame:
    """Rows of each series' roots (the main one and those added), numbers as doubles, ``days_to_maturity`` added.

    With ``dated``, rows without a date or a maturity are left out.
    """
    roots = [(s, r) for s, rs in series.items() for r in _names(rs)]
    pairs = quotes.sparkSession.createDataFrame(roots, "series string, root string")
    named = quotes.withColumns({c: F.upper(F.btrim(F.col(c), F.lit(" \t\r\n"))) for c in ("root", "ticker")})
    numbers = {c: F.col(c).try_cast("double") for c, kind in quotes.dtypes if c in NUMERIC and kind != "double"}
    out = named.withColumns(numbers).join(F.broadcast(pairs), "root")  # a row for each argument
    out = out.where("date is not null and maturity is not null") if dated else out.where("date is not null")
    if months:
        # the longest root of the series that a ticker begins with comes before its month
        rest = F.col("ticker")
        for r in sorted({r for _, r in roots}, key=len):
            own = F.col("series").isin([s for s, x in roots if x == r])
            rest = F.when(own & F.col("ticker").startswith(r), F.substring("ticker", len(r) + 1, 1_000)).otherwise(rest)
        out = out.where(F.substring(rest, 1, 1).isin(months))
    return out.withColumn("days_to_maturity", F.datediff("maturity", "date"))


def trading_days(universe: DataFrame, days_before_roll: int) -> DataFrame:
    """(series, date, front, listed): the front contract's row, and ticker and price of every contract listed that day.

    The front is the nearest contract beyond the roll limit, else the nearest alive, else the least expired. Rows
    without a maturity are left out by the aggregates' own filters: as a filter of rows, the maturity's
    expression would be copied below whatever aggregation the quotes come from. A day lists a bounded number of contracts.
    """
    dtm = F.col("days_to_maturity")
    tier = F.when((dtm > days_before_roll) & (dtm >= 0), 0).when(dtm >= 0, 1).otherwise(2)
    own = [c for c in universe.columns if c not in ("series", "date")]
    # of several prices of one day the least; of several kinds of price the first that is known
    prices = [F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("close", "settlement_price", "average_price") if c in universe.columns]
    rows = universe.select("series", "date", "maturity", F.struct(*own).alias("row"), F.struct(tier.alias("tier"), F.abs(dtm).alias("away"), "ticker").alias("rank"), F.struct("ticker", *prices).alias("price"))
    days = rows.groupBy("series", "date").agg(F.expr("min_by(row, rank) FILTER (WHERE maturity IS NOT NULL)").alias("front"), F.expr("collect_list(price) FILTER (WHERE maturity IS NOT NULL)").alias("listed"))
    return days.where("front is not null")


def pick_front_contract(universe: DataFrame, days_before_roll: int) -> DataFrame:
    """For each series and day the front contract's row."""
    return trading_days(universe, days_before_roll).select("series", "date", "front.*")


def detect_rolls(front: DataFrame) -> DataFrame:
    w = Window.partitionBy("series").orderBy("date")
    prev = front.select("series", "date", "ticker", F.lag("ticker").over(w).alias("from_ticker"))
    return prev.where("from_ticker is not null and ticker <> from_ticker").select("series", "from_ticker", F.col("ticker").alias("to_ticker"), F.col("date").alias("switch_date"))


def listed_price(listed: Column, ticker: Column, kinds: list[str]) -> Column:
    """A contract's price of the day: of several rows the least of the first kind that is known."""
    own = F.filter(listed, lambda x: x["ticker"] == ticker)
    least = lambda c: F.array_min(F.transform(own, lambda x: x[c]))
    return F.coalesce(*(least(c) for c in kinds))


def roll_schedule(rolls: DataFrame, days: DataFrame) -> DataFrame:
    """Each roll with the last day, up to the switch, on which both contracts have rows, and the ratio of their prices there.

    One pass in order of dates over the days on which a roll's two contracts are listed and the rolls among them: each
    roll takes the last such day that came before it.
    """
    kinds = [f.name for f in days.schema["listed"].dataType.elementType if f.name != "ticker"]
    key = ["series", "from_ticker", "to_ticker"]
    tickers = F.array_distinct(F.transform("listed", lambda x: x["ticker"]))
    listed = days.select("series", "date", "listed", tickers.alias("tickers"), F.explode(tickers).alias("from_ticker"))
    both = listed.join(rolls.select(*key).distinct(), ["series", "from_ticker"]).where(F.array_contains("tickers", F.col("to_ticker")))
    price = lambda c: listed_price(F.col("listed"), F.col(c), kinds)
    bridge = F.struct(F.col("date").alias("bridge_date"), price("from_ticker").alias("from_close"), price("to_ticker").alias("to_close"))
    common = both.select(*key, "date", bridge.alias("bridge"), F.lit(0).alias("is_roll"))
    asked = rolls.select(*key, F.col("switch_date").alias("date"), F.lit(None).cast(common.schema["bridge"].dataType).alias("bridge"), F.lit(1).alias("is_roll"))
    w = Window.partitionBy(*key).orderBy("date", "is_roll").rowsBetween(Window.unboundedPreceding, 0)
    found = common.unionByName(asked).withColumn("bridge", F.last("bridge", ignorenulls=True).over(w)).where("is_roll = 1").select(*key, F.col("date").alias("switch_date"), "bridge.*")
    usable = lambda q: F.when((q > 0) & (q < float("inf")), q)  # noqa: E731  NaN is greater than any number
    ratio = lambda x, y: F.coalesce(usable(F.try_divide(x, y)), F.lit(1.0))
    return found.withColumns({"backward_factor": ratio("to_close", "from_close"), "forward_factor": ratio("from_close", "to_close")})


def factor_segments(rolls: DataFrame) -> DataFrame:
    """(series, from_date, to_date, backward_factor, forward_factor): what prices are multiplied by from one roll until the next.

    The first segment of a series has no from_date, the last one no to_date; a series without rolls has no segment.
    """
    starts = rolls.select("series", F.col("switch_date").alias("from_date"), "backward_factor", "forward_factor")
    first = rolls.select("series").distinct().select("series", F.lit(None).cast("date").alias("from_date"), F.lit(1.0).alias("backward_factor"), F.lit(1.0).alias("forward_factor"))
    w = Window.partitionBy("series").orderBy(F.asc_nulls_first("from_date"))
    after, upto = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
    return starts.unionByName(first).select(
        "series", "from_date", F.lead("from_date").over(w).alias("to_date"),
        F.coalesce(F.product("backward_factor").over(after), F.lit(1.0)).alias("backward_factor"), F.product("forward_factor").over(upto).alias("forward_factor"),
    )


def with_factor(rows: DataFrame, segments: DataFrame, backward: bool) -> DataFrame:
    """Adds ``factor``, by a join of days and segments within each month; days before the first roll and from the last one on need no month."""
    own = segments.select("series", "from_date", "to_date", F.col("backward_factor" if backward else "forward_factor").alias("own"))
    ends = own.groupBy("series").agg(
        F.min("to_date").alias("first"), F.max("from_date").alias("last"),
        F.max(F.when(F.col("from_date").isNull(), F.col("own"))).alias("before"), F.max(F.when(F.col("to_date").isNull(), F.col("own"))).alias("since"),
    )
    month = lambda d: F.trunc(d, "MM")
    closed = own.where("from_date is not null and to_date is not null")
    months = closed.select("*", F.explode(F.sequence(month("from_date"), month("to_date"), F.expr("interval 1 month"))).alias("month"))
    months = months.select(F.col("series").alias("s"), F.col("month").alias("m"), "from_date", "to_date", "own")
    out = rows.join(ends, "series", "left")
    between = (F.col("date") >= F.col("first")) & (F.col("date") < F.col("last"))
    within = (F.col("series") == F.col("s")) & (month("date") == F.col("m")) & (F.col("date") >= F.col("from_date")) & (F.col("date") < F.col("to_date"))
    out = out.join(months, within, "left")
    factor = F.when(F.col("date") < F.col("first"), F.col("before")).when(between, F.col("own")).otherwise(F.col("since"))
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), F.coalesce(factor, F.lit(1.0)).alias("factor"))


def adjusted_rows(front: DataFrame, segments: DataFrame, backward: bool) -> DataFrame:
    """Prices of the front contracts times their factors; volumes as they are."""
    rows = with_factor(front, segments, backward)
    have = [c for c in PRICES if c in rows.columns]
    extra = [F.col(c).alias(a) for c, a in (("volume", "Volume"), ("volume_qty", "Volume_Qty")) if c in rows.columns]
    return rows.select("series", "date", *((F.col(c) * F.col("factor")).alias(c.capitalize()) for c in have), *extra)


def adjust(quotes: DataFrame, series: dict[str, list[str]], days_before_roll: float = 5, months: str | list[str] | None = None, backward: bool = True, rules=None) -> Series:
    """The daily table (series, date, front, listed) is written once; fronts, rolls, bridges and rows are read from it.

    Quotes without a maturity get it from the calendar of their contracts, by ``rules`` (``functions.maturity``).
    """
    if "maturity" not in quotes.columns and {"ticker", "date"} <= set(quotes.columns):
        quotes = with_calendar(quotes, rules)
    n, letters = validate_quotes(quotes, days_before_roll, months, rows=False)
    spark, series = quotes.sparkSession, {s: _names(rs) for s, rs in series.items()}
    days = trading_days(select_universe(quotes, series, letters, dated=False), n)
    path = new_path(spark, "trading-days")
    days.write.parquet(path)
    days = spark.read.schema(days.schema).parquet(path)
    if days.isEmpty():
        raise ValueError("no quotes of these roots and months")
    front = days.select("series", "date", "front.*")
    rolls = roll_schedule(detect_rolls(front), days)
    out = adjusted_rows(front, factor_segments(rolls), backward)
    spec = spark.createDataFrame([("backward" if backward else "forward", s, ",".join(r), n, ",".join(letters) if letters else "ALL") for s, r in series.items()], "method string, series string, roots string, days_before_roll int, maturities string")
    return Series(out, front.select("series", "date", "root", "ticker", "maturity", "days_to_maturity"), rolls, spec)


def build_backward_adjusted(quotes: DataFrame, series: dict[str, list[str]], **options) -> Series:
    return adjust(quotes, series, backward=True, **options)


def build_forward_adjusted(quotes: DataFrame, series: dict[str, list[str]], **options) -> Series:
    return adjust(quotes, series, backward=False, **options)


def contract_specs(df: DataFrame) -> DataFrame:
    """Cost and size columns for the roots that have a specification; null for the others."""
    # fixed values
    spec = df.sparkSession.createDataFrame([("CCM", 0.07, 10.0, 0.01, 450.0, "USD")], "spec_root string, slippage double, fees double, tick_size double, multiplier double, currency string")
    return df.join(F.broadcast(spec), F.substring("ticker", 1, 3) == F.col("spec_root"), "left").drop("spec_root")  # roots of three letters
