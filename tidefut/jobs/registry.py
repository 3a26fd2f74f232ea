"""Registered queries over the driver tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.maturity import contract_calendar, estimate_maturity
from ..operators import continuous as C
from ..operators import merge as M
from ..operators import treatments as T
from ..sources.folders import new_path
from . import retrieve as R
from .quotes import DAILY, WEEKLY, quotes
from .report_queries import QUERIES
from .series import append_days, stored_series

ROOTS = ("DOL", "WIN", "CCM", "BGI", "ICF", "DI1")
SERIES = {r: [r] for r in ROOTS}

# ---- SQL fragments of the oracles ------------------------------------------------------

_DAYS = "CAST(CASE isodow({d}) {cases} ELSE 0 END AS INT)"
_LAST = "CAST(make_date(y, m, 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE)"
_MATURITY = f"""
(SELECT t.*, CASE rule
   WHEN 'last_bd' THEN {_LAST} - {_DAYS.format(d=_LAST, cases="WHEN 6 THEN 1 WHEN 7 THEN 2")}
   WHEN 'first_bd' THEN make_date(y, m, 1) + {_DAYS.format(d="make_date(y, m, 1)", cases="WHEN 6 THEN 2 WHEN 7 THEN 1")}
   WHEN 'wed' THEN make_date(y, m, 15) + {_DAYS.format(d="make_date(y, m, 15)", cases="WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 4 THEN -1 WHEN 5 THEN -2 WHEN 6 THEN -3 WHEN 7 THEN 3")}
   WHEN 'before' THEN make_date(y, m, 15) - {_DAYS.format(d="make_date(y, m, 15)", cases="WHEN 1 THEN 3 WHEN 7 THEN 3 WHEN 6 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1")}
   END AS maturity
 FROM (SELECT ticker, CASE max(root) WHEN 'DOL' THEN 'last_bd' WHEN 'BGI' THEN 'last_bd' WHEN 'WIN' THEN 'wed' WHEN 'CCM' THEN 'before' WHEN 'ICF' THEN 'before' WHEN 'DI1' THEN 'first_bd' END AS rule,
     CAST(CASE WHEN CAST(right(ticker, 2) AS INT) <= 40 THEN 2000 ELSE 1900 END + CAST(right(ticker, 2) AS INT) AS BIGINT) AS y, CAST(instr('FGHJKMNQUVXZ', substr(ticker, 4, 1)) AS BIGINT) AS m FROM q GROUP BY ticker) t)
"""


def _dated(source: str) -> str:
    return f"q AS ({source}), mat AS {_MATURITY}, qm AS (SELECT q.*, mat.maturity FROM q JOIN mat USING (ticker))"


def _series_sql(backward: bool, final: str, series: dict[str, list[str]] | None = None, source: str = WEEKLY, where: str = "TRUE", price: str = "close") -> str:
    """The continuous series, by windows and joins over the weekly quotes."""
    frame = "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING" if backward else "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    members = ", ".join(f"('{s}', '{r}')" for s, rs in (series or SERIES).items() for r in rs)
    ratio = "CASE WHEN isfinite({a} / {b}) AND {a} / {b} > 0 THEN {a} / {b} ELSE 1.0 END"
    return f"""
WITH {_dated(source)}, m(series, root) AS (VALUES {members}),
u AS (SELECT series, qm.*, {price} AS p, date_diff('day', date, maturity) AS dtm FROM qm JOIN m USING (root) WHERE {where}),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series, date ORDER BY CASE WHEN dtm > 5 THEN 0 WHEN dtm >= 0 THEN 1 ELSE 2 END, abs(dtm), ticker) AS rn FROM u) WHERE rn = 1),
r AS (SELECT * FROM (SELECT series, date AS switch_date, ticker AS to_ticker, lag(ticker) OVER (PARTITION BY series ORDER BY date) AS from_ticker FROM f) WHERE from_ticker <> to_ticker),
b AS (SELECT r.series, r.switch_date, max(x.date) AS bridge_date FROM r JOIN u x ON x.series = r.series AND x.ticker = r.from_ticker AND x.date <= r.switch_date
      JOIN u y ON y.series = r.series AND y.ticker = r.to_ticker AND y.date = x.date GROUP BY r.series, r.switch_date),
s AS (SELECT r.series, r.from_ticker, r.to_ticker, r.switch_date, b.bridge_date, x.p AS from_close, y.p AS to_close,
        coalesce({ratio.format(a="y.p", b="nullif(x.p, 0)")}, 1.0) AS backward_factor, coalesce({ratio.format(a="x.p", b="nullif(y.p, 0)")}, 1.0) AS forward_factor
      FROM r LEFT JOIN b ON b.series = r.series AND b.switch_date = r.switch_date
      LEFT JOIN u x ON x.series = r.series AND x.ticker = r.from_ticker AND x.date = b.bridge_date LEFT JOIN u y ON y.series = r.series AND y.ticker = r.to_ticker AND y.date = b.bridge_date),
a AS (SELECT f.*, coalesce(product(coalesce(s.{"backward" if backward else "forward"}_factor, 1.0)) OVER (PARTITION BY f.series ORDER BY f.date {frame}), 1.0) AS factor
      FROM f LEFT JOIN s ON s.series = f.series AND s.switch_date = f.date)
{final}"""


_PRICES_SQL = "SELECT series, date, " + ", ".join(f"round({c} * factor, 4) AS {c}_adj" for c in C.PRICES) + ", volume AS Volume, volume_qty AS Volume_Qty FROM a"
_ROLLS_SQL = "SELECT series, from_ticker, to_ticker, switch_date, bridge_date, from_close, to_close, round(backward_factor, 6) AS backward_factor, round(forward_factor, 6) AS forward_factor FROM s"
_ACTIVE_SQL = "SELECT series, date, root, ticker, maturity, CAST(dtm AS INT) AS days_to_maturity FROM f"


def _prices(series: C.Series) -> DataFrame:
    return series.rows.select("series", "date", *(F.round(F.col(c.capitalize()), 4).alias(f"{c}_adj") for c in C.PRICES), "Volume", "Volume_Qty")


def _rolls(series: C.Series) -> DataFrame:
    return series.rolls.withColumns({c: F.round(c, 6) for c in ("backward_factor", "forward_factor")})


# ---- queries -----------------------------------------------------------------------------

_FOUND: dict[str, tuple[Callable, str]] = {}


def register(sql: str):
    def keep(f):
        _FOUND[f.__name__] = (f, sql)
        return f

    return keep


def dated(spark: SparkSession, sf_dir: str, weekly: bool = False) -> DataFrame:
    return estimate_maturity(quotes(spark, sf_dir, weekly))


@register(_series_sql(True, _PRICES_SQL))
def backward_adjusted(spark, sf_dir):
    return _prices(C.build_backward_adjusted(dated(spark, sf_dir, True), SERIES))


@register(_series_sql(False, _PRICES_SQL))
def forward_adjusted(spark, sf_dir):
    return _prices(C.build_forward_adjusted(dated(spark, sf_dir, True), SERIES))


@register(_series_sql(True, _ROLLS_SQL))
def roll_schedule(spark, sf_dir):
    return _rolls(C.build_backward_adjusted(dated(spark, sf_dir, True), SERIES))


@register(_series_sql(True, _ACTIVE_SQL))
def active_contracts(spark, sf_dir):
    return C.build_backward_adjusted(dated(spark, sf_dir, True), SERIES).active


#: Series of a main root and added ones, one root in two series; names as users may write them.
MANY = {"grain": ["CCM", "ICF"], "money": ["DOL", "DI1", "WIN"], "beef": ["BGI", "CCM"]}
_TYPED = {s: [f" {r.lower()}" for r in rs] for s, rs in MANY.items()}
_SOME_MONTHS = "substr(ticker, 4, 1) IN ('F', 'H', 'K', 'N', 'U', 'X', 'Z')"


@register(_series_sql(False, _PRICES_SQL, MANY, where=_SOME_MONTHS))
def many_roots_adjusted(spark, sf_dir):
    q = dated(spark, sf_dir, True).withColumns({"root": F.concat(F.lower("root"), F.lit(" ")), "close": F.col("close").cast("string")})
    return _prices(C.build_forward_adjusted(q, _TYPED, months=["f", "h ", "K", "n", "u", "x", "z"]))


@register(_series_sql(True, _ACTIVE_SQL, MANY, where=_SOME_MONTHS))
def many_roots_active(spark, sf_dir):
    return C.build_backward_adjusted(dated(spark, sf_dir, True), _TYPED, months="FHKNUXZ").active


def _in_appends(spark, sf_dir, backward: bool) -> DataFrame:
    """The first year, three more, some of these again and later weeks with other prices, then these and all that is left; read back by partitions."""
    folder = new_path(spark, "series")
    q, day = dated(spark, sf_dir, True), F.col("date")
    other = q.withColumns({c: F.col(c) + 1 for c in C.PRICES})
    parts = [q.where(day < "1996-01-01"), q.where((day >= "1996-01-01") & (day < "1999-01-01")), other.where((day >= "1998-06-01") & (day < "2000-06-01")), q.where(day >= "1998-06-01")]
    for part in parts:
        append_days(spark, part, folder, SERIES)
    rows = stored_series(spark, folder, backward=backward)
    return rows.select("series", "date", *(F.round(F.col(c.capitalize()), 4).alias(f"{c}_adj") for c in C.PRICES), "Volume", "Volume_Qty")


@register(_series_sql(True, _PRICES_SQL))
def backward_in_appends(spark, sf_dir):
    return _in_appends(spark, sf_dir, True)


@register(_series_sql(False, _PRICES_SQL))
def forward_in_appends(spark, sf_dir):
    return _in_appends(spark, sf_dir, False)


#: A user's own rules, as rows (root, base, weekday, roll, offset); the other roots keep theirs.
OWN_RULES = [("win", "18", 5, None, 0), ("DOL ", "first", None, "forward", 2), ("DI1", "last", None, "back", -3)]
_WEEKDAYS = "(SELECT x, row_number() OVER (ORDER BY x) AS k FROM (SELECT CAST(unnest(range(DATE '1990-01-01', DATE '2009-12-31', INTERVAL 1 DAY)) AS DATE) AS x) c0 WHERE isodow(x) < 6)"
_OWN_MATURITY = f"""own AS (SELECT qm.* EXCLUDE (maturity), CASE root WHEN 'WIN' THEN (SELECT max(x) FROM {_WEEKDAYS} w WHERE isodow(x) = 5 AND abs(x - make_date(y, m, 18)) <= 3)
  WHEN 'DOL' THEN (SELECT w.x FROM {_WEEKDAYS} w WHERE k = (SELECT min(k) + 2 FROM {_WEEKDAYS} v WHERE v.x >= make_date(y, m, 1)))
  WHEN 'DI1' THEN (SELECT w.x FROM {_WEEKDAYS} w WHERE k = (SELECT max(k) - 3 FROM {_WEEKDAYS} v WHERE v.x <= {_LAST})) ELSE maturity END AS maturity
  FROM (SELECT DISTINCT ticker, root, maturity, CAST(CASE WHEN CAST(right(ticker, 2) AS INT) <= 40 THEN 2000 ELSE 1900 END + CAST(right(ticker, 2) AS INT) AS BIGINT) AS y, CAST(instr('FGHJKMNQUVXZ', substr(ticker, 4, 1)) AS BIGINT) AS m FROM qm) qm)"""


@register(_series_sql(True, _ACTIVE_SQL).replace("u AS (SELECT series, qm.*", f"{_OWN_MATURITY}, qo AS (SELECT qm.* REPLACE (own.maturity AS maturity) FROM qm JOIN own USING (ticker)),\nu AS (SELECT series, qm.*").replace("FROM qm JOIN m USING (root)", "FROM qo qm JOIN m USING (root)"))
def active_by_own_rules(spark, sf_dir):
    """Maturities by a table of rules, from the calendar of contracts, for quotes that have none."""
    rules = spark.createDataFrame(OWN_RULES, "root string, base string, weekday int, roll string, offset int")
    return C.build_backward_adjusted(quotes(spark, sf_dir, True), SERIES, rules=rules).active


_ODD = f"""SELECT q0.* REPLACE (CASE trade_count % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST('nan' AS DOUBLE) WHEN 2 THEN 0.0 WHEN 3 THEN CAST('infinity' AS DOUBLE) ELSE close END AS close),
  CASE WHEN day(date) % 3 = 0 THEN open END AS settlement_price, CASE WHEN day(date) % 2 = 0 THEN high END AS average_price FROM ({WEEKLY}) q0"""


@register(_series_sql(True, _ROLLS_SQL, source=_ODD, price="coalesce(CASE WHEN isnan(close) THEN NULL ELSE close END, settlement_price, average_price)"))
def rolls_by_other_prices(spark, sf_dir):
    """Closing prices are unknown, zero or not finite on many days; the settlement's or the average price stands in for unknown ones."""
    n, day = F.col("trade_count") % 6, F.dayofmonth("date")
    close = F.when(n == 0, F.lit(None).cast("double")).when(n == 1, float("nan")).when(n == 2, 0.0).when(n == 3, float("inf")).otherwise(F.col("close"))
    other = {"settlement_price": F.when(day % 3 == 0, F.col("open")), "average_price": F.when(day % 2 == 0, F.col("high").cast("string"))}
    return _rolls(C.build_backward_adjusted(dated(spark, sf_dir, True).withColumns({"close": close, **other}), SERIES))


@register(f"WITH q AS ({WEEKLY}) SELECT 'forward' AS method, series, roots, 7 AS days_before_roll, 'F,Z' AS maturities, count(*) AS n_quotes FROM (VALUES ('grain', 'CCM,ICF'), ('money', 'DOL,DI1,WIN'), ('beef', 'BGI,CCM')) v(series, roots) JOIN q ON contains(roots, q.root) GROUP BY series, roots")
def series_specs(spark, sf_dir):
    q = dated(spark, sf_dir, True)
    spec = C.build_forward_adjusted(q, _TYPED, days_before_roll=7.9, months=["F", " z"]).spec
    used = q.groupBy("root").agg(F.count("*").alias("n"))
    return spec.join(used, F.array_contains(F.split("roots", ","), F.col("root"))).groupBy(*spec.columns).agg(F.sum("n").alias("n_quotes"))


@register(f"WITH q AS ({DAILY}) SELECT v.*, n FROM (VALUES ('good', FALSE), ('all months', FALSE), ('no close', TRUE), ('no rows', TRUE), ('days below zero', TRUE), ('no days', TRUE), ('no month', TRUE)) v(what, rejected), (SELECT count(*) AS n FROM q)")
def validated_quotes(spark, sf_dir):
    """Which tables and arguments the series builders reject."""
    q = dated(spark, sf_dir)
    cases = {"good": (q, 5, "FZ"), "all months": (q, 0, "all"), "no close": (q.drop("close"), 5, None), "no rows": (q.where("date is null"), 5, None), "days below zero": (q, -1, None), "no days": (q, None, None), "no month": (q, 5, [" "])}

    def rejected(case) -> bool:
        try:
            C.validate_quotes(*case)
        except ValueError:
            return True
        return False

    found = spark.createDataFrame([(what, rejected(case)) for what, case in cases.items()], "what string, rejected boolean")
    return found.crossJoin(q.agg(F.count("*").alias("n")))


@register(f"WITH {_dated(DAILY)} SELECT date, root, ticker, maturity FROM qm")
def estimated_maturity(spark, sf_dir):
    return dated(spark, sf_dir).select("date", "root", "ticker", "maturity")


@register(f"WITH {_dated(DAILY)} SELECT DISTINCT root, ticker, CAST(year(date) AS INT) AS ref_year, maturity FROM qm")
def contract_maturities(spark, sf_dir):
    return contract_calendar(quotes(spark, sf_dir))


@register(
    f"""WITH q AS ({DAILY}) SELECT date, ticker, CASE WHEN trade_count % 5 = 0 THEN NULL ELSE close * CASE WHEN trade_count % 3 = 0 THEN -1 ELSE 1 END END AS value FROM q"""
)
def localized_numbers(spark, sf_dir):
    q = quotes(spark, sf_dir)
    text = F.concat(F.expr("cast(floor(close / 1000) as bigint)"), F.lit("."), F.lpad(F.expr("cast(cast(floor(close) as bigint) % 1000 as string)"), 3, "0"), F.lit(","), F.lpad(F.expr("cast(cast(round((close - floor(close)) * 100) as bigint) as string)"), 2, "0"))
    n = F.col("trade_count")
    text = F.when(n % 5 == 0, F.lit(" &nbsp; ")).when(n % 3 == 0, F.concat(F.lit("\t"), text, F.lit("-"))).otherwise(F.concat(text, F.lit("+ ")))
    return q.select("date", "ticker", S.pt_number(text).alias("value"))


@register(
    """WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem),
c AS (SELECT CAST(unnest(range(DATE '1990-01-01', DATE '2000-12-31' + INTERVAL 1 YEAR, INTERVAL 1 DAY)) AS DATE) AS x),
w AS (SELECT x, row_number() OVER (ORDER BY x) AS k FROM c WHERE isodow(x) < 6),
p AS (SELECT date, isodow(date) < 6 AS is_business_day, (SELECT count(*) FROM w WHERE x <= date) AS upto, (SELECT count(*) FROM w WHERE x < date) AS below FROM d)
SELECT date, is_business_day, (SELECT x FROM w WHERE k = upto + 3) AS next_3, (SELECT x FROM w WHERE k = below - 6) AS previous_7 FROM p"""
)
def business_days(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_shipdate").cast("date").alias("date")).distinct()
    x = F.col("date")
    return d.select("date", S.is_business_day(x).alias("is_business_day"), S.next_business_day(x, 3).alias("next_3"), S.previous_business_day(x, 7).alias("previous_7"))


@register(
    f"""WITH q AS (SELECT DISTINCT ticker FROM ({DAILY}) x)
SELECT ticker, substr(ticker, 1, 3) AS root_guess, substr(ticker, 4, 1) AS letter, CAST(instr('FGHJKMNQUVXZ', substr(ticker, 4, 1)) AS INT) AS month,
  CAST(CASE WHEN CAST(right(ticker, 2) AS INT) <= 40 THEN 2000 ELSE 1900 END + CAST(right(ticker, 2) AS INT) AS INT) AS year, substr(ticker, 4, 1) AS code FROM q"""
)
def parsed_tickers(spark, sf_dir):
    t = F.col("ticker")
    part = lambda i: S.ticker_part(t, i)
    q = quotes(spark, sf_dir).select("ticker").distinct()
    return q.select("ticker", part(1).alias("root_guess"), part(2).alias("letter"), S.month_number(part(2)).alias("month"), S.contract_year(part(3)).alias("year"), S.month_code(t, list(ROOTS)).alias("code"))


@register(f"WITH q AS ({DAILY}) SELECT date, root, ticker, close FROM q")
def old_tickers(spark, sf_dir):
    """Old cattle and grain contracts get their old names, month names in two languages; all others stay as they are."""
    names = {"F": "JAN", "G": "FEV", "H": "MAR", "J": "ABR", "K": "MAI", "M": "JUN", "N": "JUL", "Q": "AGO", "U": "SET", "V": "OUT", "X": "NOV", "Z": "DEZ"}
    english = names | {"G": "FEB", "J": "APR", "K": "MAY", "Q": "AUG", "U": "SEP", "V": "OCT", "Z": "DEC"}
    letter = F.substring("ticker", 4, 1)
    old_root = F.when(F.col("root") == "BGI", "BOI").otherwise("ICN")
    month = F.when(F.dayofmonth("date") % 2 == 0, S.lookup(names, letter)).otherwise(S.lookup(english, letter))
    is_old = F.expr("root in ('BGI', 'CCM') and year(date) < 2000 and right(ticker, 2) >= '90'")
    q = quotes(spark, sf_dir)
    q = q.select("date", F.when(is_old, old_root).otherwise(F.col("root")).alias("root"), F.when(is_old, F.concat(old_root, month, F.substring("ticker", 6, 1))).otherwise(F.col("ticker")).alias("ticker"), "close")
    return M.normalize_old_tickers(q)


@register(
    """WITH d AS (SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS y, CAST(month(l_shipdate) AS INT) AS m FROM lineitem),
e AS (SELECT y, m, make_date(y, m, 1) AS a, CAST(make_date(y, m, 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS z, make_date(y, m, 15) AS mid FROM d),
c AS (SELECT CAST(unnest(range(DATE '1990-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS x)
SELECT y, m, (SELECT min(x) FROM c WHERE x >= a AND isodow(x) < 6) AS first_bd, (SELECT max(x) FROM c WHERE x <= z AND isodow(x) < 6) AS last_bd,
  (SELECT max(x) FROM c WHERE x <= mid AND isodow(x) < 6) AS upto_mid, (SELECT x FROM c WHERE x < mid AND isodow(x) < 6 AND isodow(mid) < 6 ORDER BY x DESC LIMIT 1 OFFSET 1) AS two_before_weekday_mid,
  (SELECT x FROM c WHERE isodow(x) = 3 AND abs(x - mid) <= 3) AS wednesday FROM e"""
)
def month_days(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m")).distinct()
    y, m = F.col("y"), F.col("m")
    weekday = S.is_business_day(F.make_date(y, m, F.lit(15)))
    return d.select(
        "y", "m", S.first_business_day(y, m).alias("first_bd"), S.last_business_day(y, m).alias("last_bd"), S.business_day_before(y, m, 15, 0).alias("upto_mid"),
        F.when(weekday, S.business_day_before(y, m, 15, 2)).alias("two_before_weekday_mid"), S.nearest_weekday(y, m, 15, 3).alias("wednesday"),
    )


_DUP = f"""q AS ({DAILY}), dup AS (SELECT date, root, ticker, concat(ticker, CASE WHEN i = 1 AND trade_count % 2 = 0 THEN 'B' ELSE '' END) AS contract_code, i AS arrival_seq, close + i AS close FROM q, (SELECT unnest(range(0, 3)) AS i) r)"""


@register(f"WITH {_DUP} SELECT date, ticker, contract_code, CAST(arrival_seq AS BIGINT) AS arrival_seq, close FROM (SELECT *, row_number() OVER (PARTITION BY date, ticker ORDER BY contract_code DESC, arrival_seq DESC) AS rn FROM dup) WHERE rn = 1")
def deduplicated_rows(spark, sf_dir):
    q = quotes(spark, sf_dir).withColumn("arrival_seq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    code = F.when((F.col("arrival_seq") == 1) & (F.col("trade_count") % 2 == 0), F.concat("ticker", F.lit("B"))).otherwise(F.col("ticker"))
    rows = q.select("date", "ticker", code.alias("contract_code"), "arrival_seq", (F.col("close") + F.col("arrival_seq")).alias("close"))
    return M.dedupe_contract_rows(rows)


_SESSIONS_SQL = f"""q AS ({DAILY}), rep AS (SELECT DISTINCT root, date FROM q), bounds AS (SELECT root, min(date) AS lo, max(date) AS hi FROM rep GROUP BY root),
ses AS (SELECT root, CAST(unnest(range(lo, hi + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM bounds)"""


@register(f"WITH {_SESSIONS_SQL} SELECT root, date FROM ses WHERE isodow(date) < 6 AND day(date) <> 13 AND (root, date) NOT IN (SELECT (root, date) FROM rep)")
def missing_sessions(spark, sf_dir):
    reports = quotes(spark, sf_dir).select("root", "date").distinct()
    bounds = reports.groupBy("root").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    skip = M.target_sessions(bounds).where(F.dayofmonth("date") == 13)
    return M.missing_sessions(M.target_sessions(bounds, skip), reports)


@register(f"WITH q AS ({DAILY}) SELECT root, CAST(max(date) + INTERVAL 1 DAY AS DATE) AS resume FROM q WHERE day(date) <> 13 GROUP BY root")
def resume_dates(spark, sf_dir):
    q = quotes(spark, sf_dir)
    return M.resume_dates(q, q.where(F.dayofmonth("date") == 13))


@register(
    f"""WITH q AS ({DAILY}), cur AS (SELECT * FROM q WHERE month(date) < 10), add AS (SELECT * REPLACE (close + 1 AS close) FROM q WHERE month(date) >= 9 AND month(date) < 12)
SELECT date, root, ticker, close FROM (SELECT date, root, ticker, close FROM cur WHERE (root, date) NOT IN (SELECT (root, date) FROM add) UNION ALL SELECT date, root, ticker, close FROM add) WHERE day(date) <> 13"""
)
def merged_days(spark, sf_dir):
    q = quotes(spark, sf_dir).withColumn("contract_code", F.col("ticker"))
    additions = q.where("month(date) >= 9 and month(date) < 12").withColumn("close", F.col("close") + 1)
    skip = q.where(F.dayofmonth("date") == 13)
    return M.merge_days(q.where("month(date) < 10"), additions, skip).select("date", "root", "ticker", "close")


@register(f"WITH q AS ({DAILY}) SELECT date, root, ticker, CASE WHEN root IN ('WIN', 'DI1') THEN close * 2 ELSE close END AS close FROM q")
def refreshed_aggregate(spark, sf_dir):
    q = quotes(spark, sf_dir).select("date", "root", "ticker", "close")
    return M.refresh_aggregate(q, q.withColumn("close", F.col("close") * 2), ["WIN", "DI1"])


def holes(spark, sf_dir) -> DataFrame:
    """Quotes with zero and unknown prices by modulus."""
    n = F.col("trade_count") + F.dayofmonth("date")
    cols = {c: F.when(n % 4 == 0, 0.0).when((n % 7 == 0) & F.lit(c != "open"), F.lit(None)).otherwise(F.col(c)) for c in C.PRICES}
    return quotes(spark, sf_dir).withColumns(cols)


_HOLES = f"""h AS (SELECT * REPLACE ({", ".join(f"CASE WHEN (trade_count + day(date)) % 4 = 0 THEN 0.0 {'' if c == 'open' else 'WHEN (trade_count + day(date)) % 7 = 0 THEN NULL'} ELSE {c} END AS {c}" for c in C.PRICES)}) FROM ({DAILY}) q)"""
_OHLCV = 'date, ticker, open AS o, high AS h, low AS l, close AS c, volume AS v'


def _short(df: DataFrame) -> DataFrame:
    return df.select("date", "ticker", *(F.col(a).alias(b) for a, b in zip(("Open", "High", "Low", "Close", "Volume"), "ohlcv", strict=True)))


@register(f"WITH {_HOLES} SELECT {_OHLCV} FROM h WHERE NOT coalesce(open = 0 AND high = 0 AND low = 0 AND close = 0, FALSE)")
def ohlcv_without_zeros(spark, sf_dir):
    return _short(T.treat_ohlcv_drop0(holes(spark, sf_dir)))


@register(
    f"""WITH {_HOLES}, z AS (SELECT date, ticker, volume, {", ".join(f"CASE WHEN coalesce(open = 0 AND high = 0 AND low = 0 AND close = 0, FALSE) THEN NULL ELSE {c} END AS {c}" for c in C.PRICES)} FROM h)
SELECT date, ticker, {", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c[0]}" for c in C.PRICES)}, volume AS v FROM z"""
)
def ohlcv_carried_forward(spark, sf_dir):
    return _short(T.treat_ohlcv_locf(holes(spark, sf_dir)))


_ZEROED = f"""{_HOLES}, z AS (SELECT date, ticker, volume, {", ".join(f"CASE WHEN coalesce(open = 0 AND high = 0 AND low = 0 AND close = 0, FALSE) THEN NULL ELSE {c} END AS {c}" for c in C.PRICES)} FROM h)"""


@register(f"""WITH {_ZEROED} SELECT date, ticker, {", ".join(f"first_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c[0]}" for c in C.PRICES)}, volume AS v FROM z""")
def ohlcv_carried_back_in_blocks(spark, sf_dir):
    """The next known price, each series in blocks."""
    return _short(T.treat_ohlcv_locf(holes(spark, sf_dir), from_last=True, blocked=True))


@register(
    f"""WITH {_HOLES}, d AS (SELECT date, {", ".join(f"max({c}) AS {c}" for c in C.PRICES)} FROM (SELECT date, {", ".join(f"CASE WHEN day(date) % {k} = 0 THEN {c} END AS {c}" for k, c in enumerate(C.PRICES, 2))} FROM h) GROUP BY date)
SELECT date, {", ".join(f"last_value(CASE WHEN coalesce(open = 0 AND high = 0 AND low = 0 AND close = 0, FALSE) THEN NULL ELSE {c} END IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c[0]}" for c in C.PRICES)} FROM d"""
)
def one_series_carried_forward(spark, sf_dir):
    """One series without a key, most of whose prices are unknown."""
    some = {c: F.max(F.when(F.dayofmonth("date") % k == 0, F.col(c))).alias(c) for k, c in enumerate(C.PRICES, 2)}
    out = T.treat_ohlcv_locf(holes(spark, sf_dir).groupBy("date").agg(*some.values()))
    return out.select("date", *(F.col(a).alias(b) for a, b in zip(("Open", "High", "Low", "Close"), "ohlc", strict=True)))


@register(f"WITH {_HOLES}, q AS (SELECT * FROM h), mat AS {_MATURITY} SELECT h.date, h.root, h.ticker, open, high, low, close, volume, volume_qty, maturity FROM h JOIN mat USING (ticker) WHERE h.root IN ('WIN', 'BGI') AND h.date >= DATE '1995-01-01' AND h.date <= DATE '1997-12-31' AND open <> 0 AND high <> 0 AND low <> 0 AND close <> 0")
def clean_bulletins(spark, sf_dir):
    return R.get_bulletins(holes(spark, sf_dir), ["win", " BGI "], "1995-01-01", "1997-12-31", "clean_data_drop0")


@register(f"WITH {_HOLES} SELECT {_OHLCV} FROM h WHERE ticker IN ('WINM96', 'DI1F97') AND date >= DATE '1996-02-01' AND NOT coalesce(open = 0 AND high = 0 AND low = 0 AND close = 0, FALSE)")
def contracts_by_ticker(spark, sf_dir):
    return _short(R.get_contracts(holes(spark, sf_dir), ["winm96", "DI1F97"], start="1996-02-01"))


def _drawdown(rows):
    """A user's function of one contract's rows: the fall of the close from its highest so far, and the days since the contract's first."""
    return rows.assign(fall=rows["close"] - rows["close"].cummax(), age=[(d - rows["date"].iloc[0]).days for d in rows["date"]])[["date", "ticker", "fall", "age"]]


@register(f"WITH q AS ({DAILY}) SELECT date, ticker, close - max(close) OVER (PARTITION BY ticker ORDER BY date) AS fall, date_diff('day', min(date) OVER (PARTITION BY ticker), date) AS age FROM q")
def grouped_treatment(spark, sf_dir):
    """A treatment by a user's function for each contract."""
    own = T.grouped_treatment(_drawdown, "date date, ticker string, fall double, age long")
    return R.get_bulletins(quotes(spark, sf_dir), treatment=lambda df: own(df.select("date", "ticker", "close"))).drop("maturity")


@register(f"WITH q AS (SELECT DISTINCT root, ticker FROM ({DAILY}) x) SELECT root, ticker, CASE WHEN root = 'CCM' THEN 450.0 END AS multiplier, CASE WHEN root = 'CCM' THEN 'USD' END AS currency FROM q")
def specified_contracts(spark, sf_dir):
    q = quotes(spark, sf_dir).select("root", "ticker").distinct()
    return C.contract_specs(q).select("root", "ticker", "multiplier", "currency")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backward_adjusted(spark, sf_dir)


def queries() -> dict[str, Callable]:
    return {name: f for name, (f, _) in (_FOUND | QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (_FOUND | QUERIES).items()}
