"""Golden dates and rows, and every registered query against its SQL on the smallest tables."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tidefut.functions import scalars as S
from tidefut.functions.maturity import estimate_maturity
from tidefut.jobs import registry
from tidefut.jobs import retrieve as R
from tidefut.operators import continuous as C
from tidefut.operators import merge as M
from tidefut.operators import treatments as T

SF = "/root/testdata/sf0.001"


def test_maturities(spark):
    rows = [("WINM24", dt.date(2024, 4, 2)), ("DI1M24", dt.date(2024, 4, 2)), ("BGIF99", dt.date(1998, 12, 30)), ("XYZ", dt.date(2024, 1, 1))]
    got = {r.ticker: r.maturity for r in estimate_maturity(spark.createDataFrame(rows, "ticker string, date date")).collect()}
    assert got == {"WINM24": dt.date(2024, 6, 12), "DI1M24": dt.date(2024, 6, 3), "BGIF99": dt.date(1999, 1, 29), "XYZ": None}


def test_pt_number(spark):
    cases = {"120.000": 120000.0, "1.234,5-": -1234.5, "0,73+": 0.73, "": None, "&nbsp;": None, "1d": None, " 12,345\n": 12.345, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", S.pt_number(F.col("t")).alias("v"))
    assert {r.t: r.v for r in df.collect()} == cases


def test_names_and_dates(spark):
    row = spark.range(1).select(S.sanitize_name(F.lit(" PREÇO ABERT. (1) ")), S.parse_date(F.lit("31/02/2024")), S.parse_date(F.lit("02/04/2024"))).first()
    assert tuple(row) == ("preco_abert_1", None, dt.date(2024, 4, 2))


def test_weekend_is_no_session(spark):
    b = spark.createDataFrame([("A", dt.date(2025, 1, 3), dt.date(2025, 1, 6))], "root string, start date, end date")
    assert sorted(r.date.isoformat() for r in M.target_sessions(b).collect()) == ["2025-01-03", "2025-01-06"]


def test_merging_twice_changes_nothing(spark):
    cur = spark.createDataFrame([("A", dt.date(2025, 1, 3), "AF25", "AF25", 1.0)], "root string, date date, ticker string, contract_code string, close double")
    add = cur.withColumn("close", F.lit(2.0))
    once = M.merge_days(cur, add)
    assert [r.close for r in once.collect()] == [2.0] == [r.close for r in M.merge_days(once, add).collect()]


def test_unknown_treatment():
    with pytest.raises(ValueError):
        T.resolve_treatment("nothing")


QUOTES = "date date, root string, ticker string, maturity date, close double"


def quote(day, ticker, close, root="AAA", maturity=dt.date(2025, 2, 10)):
    return (dt.date(2025, 1, day), root, ticker, maturity, close)


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), 0.0, None, -3.0])
def test_rolls_without_a_usable_price_change_nothing(spark, odd):
    later = dt.date(2025, 3, 10)
    rows = [quote(6, "AAAG25", 10.0), quote(6, "AAAH25", 11.0, maturity=later), quote(7, "AAAH25", 12.0, maturity=later), quote(7, "AAAG25", odd)]
    rows = [(d, r, t, dt.date(2025, 1, 10) if t == "AAAG25" else m, c) for d, r, t, m, c in rows]
    built = C.build_backward_adjusted(spark.createDataFrame(rows, QUOTES), {"s": [" aaa "]}, days_before_roll=3)
    assert [(r.from_ticker, r.to_ticker, r.backward_factor, r.forward_factor) for r in built.rolls.collect()] == [("AAAG25", "AAAH25", 1.0, 1.0)]
    assert {r.date.day: r.Close for r in built.rows.collect()} == {6: 10.0, 7: 12.0}


def test_series_arguments(spark):
    good = spark.createDataFrame([quote(6, "AAAG25", 10.0, root="aaa ")], QUOTES)
    assert C.build_forward_adjusted(good, {"s": ["AAA"]}).rows.count() == 1
    for bad, options in [(good.limit(0), {}), (good.drop("maturity"), {}), (good, {"days_before_roll": -1}), (good, {"days_before_roll": float("nan")}), (good, {"months": []}), (good, {"months": " "})]:
        with pytest.raises(ValueError):
            C.build_backward_adjusted(bad, {"s": ["AAA"]}, **options)


def test_retrieval_errors(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 2), "AAA", "AAAG25", 1.0)], "date date, root string, ticker string, close double")
    assert R.get_contracts(df, [" aaag25"]).count() == 1
    for call in (lambda: R.get_contracts(df, ["nothing"]), lambda: R.get_contracts(df.limit(0), ["AAAG25"]), lambda: R.get_bulletins(df.limit(0)), lambda: R.filter_date_range(df, start="2999-01-01"), lambda: R.filter_date_range(df, "2024-02-01", "2024-01-01")):
        with pytest.raises(ValueError):
            call()
    assert R.get_bulletins(df, ["none"]).count() == 0


def test_filling_by_other_keys(spark):
    rows = [(dt.date(2024, 1, d), k, c) for k in "ab" for d, c in [(1, 1.0 if k == "a" else None), (2, None), (3, 3.0)]]
    df = spark.createDataFrame(rows, "date date, market string, close double")
    got = {(r.date.day, r.market): r.Close for r in T.treat_ohlcv_locf(df, keys=["market"]).collect()}
    assert got == {(1, "a"): 1.0, (2, "a"): 1.0, (3, "a"): 3.0, (1, "b"): None, (2, "b"): None, (3, "b"): 3.0}
    back = {(r.date.day, r.market): r.Close for r in T.treat_ohlcv_locf(df, keys=["market"], from_last=True).collect()}
    assert back[(1, "b")] == 3.0 and T.treat_ohlcv_locf(df, keys=["market"], leading="drop").count() == 4


def test_offsets_are_the_weekday_rules(spark):
    """The literal table of maturities against the weekday functions."""
    months = spark.sql("select explode(sequence(date'1999-01-01', date'2030-12-01', interval 1 month)) as d").selectExpr("year(d) as y", "month(d) as m")
    y, m = F.col("y"), F.col("m")
    rule = {"DOL": S.last_business_day(y, m), "DI1": S.first_business_day(y, m), "WIN": S.nearest_weekday(y, m, 15, 3), "CCM": S.business_day_before(y, m, 15, 1)}
    for root, want in rule.items():
        ticker = F.concat(F.lit(root), F.substring(F.lit(S.MONTH_LETTERS), m, F.lit(1)), F.lpad((y % 100).cast("string"), 2, "0"))
        rows = estimate_maturity(months.select(ticker.alias("ticker"), want.alias("want"), F.make_date(y, m, F.lit(1)).alias("date")))
        assert rows.where("maturity <> want or maturity is null").count() == 0, root


@pytest.mark.parametrize("name", ["localized_numbers", "deduplicated_rows", "missing_sessions", "merged_days", "ohlcv_carried_forward", "clean_bulletins", "active_contracts", "many_roots_adjusted", "many_roots_active", "rolls_by_other_prices", "series_specs", "validated_quotes", "old_tickers", "month_days", "ohlcv_carried_back_in_blocks", "one_series_carried_forward", "backward_in_appends", "active_by_own_rules", "grouped_treatment"])
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("lineitem", "part"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = db.sql(registry.oracle_sql()[name]).df()
    norm = lambda v: v if isinstance(v, str) else None if v is None or v != v else f"{v:.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:10]
    key = lambda rows: sorted(str([norm(x) for x in r]) for r in rows)
    assert key(tuple(r[c] for c in cols) for r in got.collect()) == key(tuple(x if str(x) != "NaT" else None for x in r) for r in want[cols].itertuples(index=False))
