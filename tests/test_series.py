"""Series: carrying forward in blocks, factors as segments, days appended to stored series; rules of maturity; grouped treatments."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidefut.functions.maturity import Rule, contract_calendar, estimate_maturity, maturity_rules, with_calendar
from tidefut.jobs import series as J
from tidefut.operators import continuous as C
from tidefut.operators import treatments as T

START = dt.date(2020, 1, 1)


@pytest.fixture
def many_blocks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("from_last", [False, True])
@pytest.mark.parametrize("keyed", [False, True])
def test_blocks_give_what_a_window_gives(spark, many_blocks, from_last, keyed):
    """One series of most rows, small ones, one that knows nothing, one without a name."""
    rng = random.Random(4)
    rows, own = [], {"a": 300, "b": 3, "c": 40, None: 25} if keyed else {"a": 400}
    for key, n in own.items():
        for k in range(n):
            values = [None if key == "c" or rng.random() < 0.97 else float(rng.randint(1, 9)) for _ in range(2)]
            rows.append((START + dt.timedelta(days=k), key, *values, float(k)))
    df = spark.createDataFrame(rows, "date date, ticker string, open double, close double, volume double")
    df = df if keyed else df.drop("ticker")
    got = T.treat_ohlcv_locf(df, from_last=from_last, blocked=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan
    seen, want = {}, []
    for date, key, *values, volume in sorted(rows, key=lambda r: (str(r[1]), r[0]), reverse=from_last):
        known = seen.setdefault(key, [None, None])
        seen[key] = [v if v is not None else k for v, k in zip(values, known, strict=True)]
        want.append((date, *([key] if keyed else []), *seen[key], volume))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    blocks = spark.read.parquet(got.inputFiles()[0].rsplit("/", 1)[0]).select("block__").distinct().count()
    assert blocks > 1


def quotes_of(seed, days, names=("AAAG20", "AAAH20", "AAAJ20", "AAAK20")):
    rng = random.Random(seed)
    out = []
    for k in range(days):
        date = START + dt.timedelta(days=k)
        for i, t in enumerate(names):
            if rng.random() < 0.7:
                out.append((date, "AAA", t, START + dt.timedelta(days=12 * i + 8), rng.choice([None, 0.0, *[float(rng.randint(90, 110))] * 8])))
    return out


QUOTES = "date date, root string, ticker string, maturity date, close double"


def by_hand(rows, n):
    """(date: (ticker, backward close, forward close)) and the rolls."""
    days = {}
    for r in rows:
        days.setdefault(r[0], []).append(r)
    front = {}
    for d, listed in days.items():
        rank = lambda r, d=d: (0 if (r[3] - d).days > n else 1 if (r[3] - d).days >= 0 else 2, abs((r[3] - d).days), r[2])
        front[d] = min(listed, key=rank)
    order = sorted(front)
    rolls = {}
    for before, d in zip(order, order[1:], strict=False):
        a, b = front[before][2], front[d][2]
        if a == b:
            continue
        bridge = max((x for x in order if x <= d and {a, b} <= {r[2] for r in days[x]}), default=None)
        price = lambda t, bridge=bridge: next(r[4] for r in days[bridge] if r[2] == t)
        pa, pb = (price(a), price(b)) if bridge else (None, None)
        rolls[d] = (pb / pa, pa / pb) if pa and pb else (1.0, 1.0)
    out = {}
    for d in order:
        back = math.prod(f for x, (f, _) in rolls.items() if x > d)
        forth = math.prod(f for x, (_, f) in rolls.items() if x <= d)
        c = front[d][4]
        out[d] = (None if c is None else round(c * back, 8), None if c is None else round(c * forth, 8))
    return out, rolls


def closes(df):
    return {r.date: None if r.Close is None else round(r.Close, 8) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_segments_and_bridges_by_hand(spark, seed):
    rows = quotes_of(seed, 50)
    q = spark.createDataFrame(rows, QUOTES)
    want, rolls = by_hand(rows, 5)
    back, forth = (f(q, {"s": ["AAA"]}) for f in (C.build_backward_adjusted, C.build_forward_adjusted))
    assert len(rolls) > 3 and {r.switch_date for r in back.rolls.collect()} == set(rolls)
    assert closes(back.rows) == {d: b for d, (b, _) in want.items()} and closes(forth.rows) == {d: f for d, (_, f) in want.items()}
    segments = sorted(C.factor_segments(back.rolls).collect(), key=lambda r: r.from_date or dt.date.min)
    assert len(segments) == len(rolls) + 1 and [s.to_date for s in segments] == [s.from_date for s in segments[1:]] + [None]


def test_appended_days(spark, tmp_path, monkeypatch):
    """Day by day, with a fault between two tables, an older day corrected, and a series that has no new day."""
    rows = quotes_of(3, 40)
    folder, series = f"{tmp_path}/series", {"s": ["AAA"], "other": ["BBB"]}
    add = lambda some: J.append_days(spark, spark.createDataFrame(some, QUOTES), folder, series)
    day = lambda a, b: [r for r in rows if a <= (r[0] - START).days < b]
    add(day(0, 20) + [(*r[:1], "BBB", r[2].replace("AAA", "BBB"), *r[3:]) for r in day(0, 5)])
    real = C.roll_schedule
    monkeypatch.setattr(C, "roll_schedule", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        add(day(20, 35))
    monkeypatch.setattr(C, "roll_schedule", real)
    add(day(20, 35))
    add([(*r[:4], 95.0) for r in day(22, 24)])
    rows = [(*r[:4], 95.0) if 22 <= (r[0] - START).days < 24 else r for r in rows]
    add(day(35, 40))
    add(day(40, 50))  # no quotes
    want, rolls = by_hand(rows, 5)
    for backward in (True, False):
        assert closes(J.stored_series(spark, folder, ["s"], backward=backward)) == {d: w[not backward] for d, w in want.items()}
    cut = J.stored_series(spark, folder, ["s"], "2020-01-10", "2020-01-20")
    assert closes(cut) == {d: b for d, (b, _) in want.items() if dt.date(2020, 1, 10) <= d <= dt.date(2020, 1, 20)}
    filters = cut._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "series" in filters and "year" in filters
    assert J.stored_series(spark, folder).where("series = 'other'").count() == len({r[0] for r in rows if (r[0] - START).days < 5})


def test_rules_of_the_user(spark):
    months = spark.sql("select explode(sequence(date'1999-01-01', date'2012-12-01', interval 1 month)) as date")
    rules = {"X1": Rule("first", roll="forward", offset=2), "X2": Rule("last", roll="back", offset=-3), "X3": Rule(18, weekday=5), "X4": Rule(10), "X5": Rule(28, roll="forward"), "X6": Rule("last", weekday=0)}
    table = spark.createDataFrame([(f" {k.lower()}", str(r.base), r.weekday, r.roll, r.offset) for k, r in rules.items()], "root string, base string, weekday int, roll string, offset int")
    letter = F.substring(F.lit("FGHJKMNQUVXZ"), F.month("date"), F.lit(1))
    df = months.select("date", F.explode(F.array(*map(F.lit, rules))).alias("root")).select("date", "root", F.concat(F.lit("ABC"), letter, F.date_format("date", "yy")).alias("ticker"))
    got = {(r.root, r.date): r.maturity for r in estimate_maturity(df, table).collect()}

    def moved(day, step):
        while day.weekday() > 4:
            day += dt.timedelta(days=step)
        return day

    def by_steps(rule, first):
        last = (first + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)
        day = last if rule.base == "last" else first if rule.base == "first" else first.replace(day=rule.base)
        if rule.weekday is not None:
            day = next(x for k in (0, 1, -1, 2, -2, 3, -3) if (x := day + dt.timedelta(days=k)).isoweekday() % 7 == rule.weekday)
        day = moved(day, 1 if rule.roll == "forward" else -1) if rule.roll else day
        step = 1 if rule.offset > 0 else -1
        for _ in range(abs(rule.offset)):
            day = moved(day + dt.timedelta(days=step), step)
        return day

    assert got == {(k, d): by_steps(rules[k], d) for k, d in got} and len(got) == 6 * 14 * 12
    joined = with_calendar(df.withColumn("ref_year_", F.lit(1)), table)
    assert joined.columns == ["date", "root", "ticker", "ref_year_", "maturity"] and {(r.root, r.date): r.maturity for r in joined.collect()} == got
    assert contract_calendar(df, rules).count() == len(got)
    for bad in (lambda: Rule(31), lambda: Rule("middle"), lambda: Rule(1, roll="up"), lambda: maturity_rules({"A": "none"}), lambda: maturity_rules(table.unionByName(table.withColumn("offset", F.lit(9))))):
        with pytest.raises(ValueError):
            bad()


def test_grouped_treatments(spark):
    df = spark.createDataFrame([(START + dt.timedelta(days=k), t, float(k)) for t, n in (("a", 5), ("b", 2), (None, 1)) for k in reversed(range(n))], "date date, ticker string, close double")
    total = T.grouped_treatment(lambda g: g.assign(total=g["close"].cumsum())[["ticker", "date", "total"]], "ticker string, date date, total double", most=5)
    got = {(r.ticker, (r.date - START).days): r.total for r in df.transform(T.resolve_treatment(total)).collect()}
    assert got == {**{("a", k): k * (k + 1) / 2 for k in range(5)}, ("b", 0): 0.0, ("b", 1): 1.0, (None, 0): 0.0}
    with pytest.raises(ValueError, match="a has 5 rows"):
        T.grouped_treatment(lambda g: g, "date date, ticker string, close double", most=4)(df)
    with pytest.raises(ValueError, match="missing"):
        total(df.drop("ticker"))
