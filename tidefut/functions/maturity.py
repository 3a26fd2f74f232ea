"""Contract maturities from weekday rules; no holidays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scalars as S
from .sizes import broadcast_if_small

#: Rules that a table of rules may have.
MOST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """A day of the contract's month.

    ``base`` is "first", "last" or a day of the month up to 28; ``weekday`` (0 is Sunday) moves it to the nearest such
    day; a ``roll`` of "back" or "forward" leaves weekends; then ``offset`` weekdays are counted, before it if negative.
    """

    base: str | int
    weekday: int | None = None
    roll: str | None = None
    offset: int = 0

    def __post_init__(self):
        day = self.base in ("first", "last") or isinstance(self.base, int) and 1 <= self.base <= 28
        if not day or self.weekday not in (None, *range(7)) or self.roll not in (None, "back", "forward") or abs(self.offset) > 250:
            raise ValueError(f"no rule of maturity: {self}")

    @property
    def at_end(self) -> bool:
        return self.base == "last"

    def offsets(self) -> list[int]:
        """Days from the month's first day (its last one for "last") by that day's weekday, Monday first."""
        out = []
        for first in range(7):
            day = self.base - 1 if isinstance(self.base, int) else 0
            if self.weekday is not None:
                day += ((self.weekday - 1) - (first + day) + 3) % 7 - 3
            weekday = (first + day) % 7
            if self.roll and weekday > 4:
                day += 4 - weekday if self.roll == "back" else 7 - weekday
            step = 1 if self.offset > 0 else -1
            for _ in range(abs(self.offset)):
                day += step
                while (first + day) % 7 > 4:
                    day += step
            out.append(day)
        return out


NAMED = {"last_bd": Rule("last", roll="back"), "first_bd": Rule("first", roll="forward"), "nearest_wed15": Rule(15, weekday=3), "bd_before_15": Rule(15, roll="back", offset=-1)}
# fixed values: the rule of each root
RULES = {"DOL": "last_bd", "BGI": "last_bd", "WIN": "nearest_wed15", "CCM": "bd_before_15", "ICF": "bd_before_15", "DI1": "first_bd"}


def maturity_rules(rules: dict[str, str | Rule] | DataFrame | None = None) -> dict[str, Rule]:
    """The rule of each root: those known, and the user's in place of them or beside them.

    The user's are named rules or ``Rule``s by root, or a table (root, base, weekday, roll, offset) of bounded size; of two rows
    of one root neither is preferred, so that is an error.
    """
    if isinstance(rules, DataFrame):
        rows = rules.select(S.normalize_root(F.col("root")).alias("root"), F.col("base").cast("string"), F.col("weekday").cast("int"), "roll", F.coalesce(F.col("offset").cast("int"), F.lit(0)).alias("offset")).distinct().limit(MOST_RULES + 1).collect()
        if len(rows) > MOST_RULES or len({r["root"] for r in rows}) < len(rows):
            raise ValueError("a table of rules has one row for each root, and not too many")
        rules = {r["root"]: Rule(int(r["base"]) if r["base"].strip().isdigit() else r["base"].strip().lower(), r["weekday"], r["roll"], r["offset"]) for r in rows}
    found = RULES | {k.strip().upper(): v for k, v in (rules or {}).items()}
    unknown = [v for v in found.values() if not isinstance(v, Rule) and v not in NAMED]
    if unknown:
        raise ValueError(f"unknown rule {unknown[0]!r}; known: {', '.join(NAMED)}")
    return {k: NAMED.get(v, v) if isinstance(v, str) else v for k, v in found.items()}


def estimate_maturity(df: DataFrame, rules: dict[str, str | Rule] | DataFrame | None = None) -> DataFrame:
    """Adds ``maturity``; null where ticker or root tell none. Column expressions only, no shuffle.

    The rules of all roots are one literal table of day offsets, so the expression stays small
    enough for code generation wherever the optimizer copies it to.
    """
    if "ticker" not in df.columns:
        return df
    known = maturity_rules(rules)
    t = F.upper("ticker")
    root = F.expr("substring(upper(ticker), 1, length(ticker) - 3)")
    if "root" in df.columns:
        root = F.coalesce(S.normalize_root(F.col("root")), root)
    number = F.array_position(F.lit(list(known)), root)
    year = S.contract_year(F.right(t, F.lit(2)).try_cast("int"), F.col("date") if "date" in df.columns else None)
    month = F.position(F.expr("left(right(upper(ticker), 3), 1)"), F.lit(S.MONTH_LETTERS))
    first = F.when(t.rlike(S.TICKER_FORM) & (number > 0), F.make_date(year, month, F.lit(1)))
    base = F.when(F.get(F.lit([int(r.at_end) for r in known.values()]), (number - 1).cast("int")) == 1, F.last_day(first)).otherwise(first)
    days = F.get(F.lit([d for r in known.values() for d in r.offsets()]), ((number - 1) * 7 + F.weekday(base)).cast("int"))
    return df.withColumn("maturity", F.date_add(base, days))


def contract_calendar(df: DataFrame, rules: dict[str, str | Rule] | DataFrame | None = None) -> DataFrame:
    """One maturity for each root, ticker and reference year."""
    years = df.select("root", "ticker", F.year("date").alias("ref_year")).distinct()
    dated = years.withColumn("date", F.make_date("ref_year", F.lit(1), F.lit(1)))
    return estimate_maturity(dated, rules).select("root", "ticker", "ref_year", "maturity")


def with_calendar(df: DataFrame, rules: dict[str, str | Rule] | DataFrame | None = None) -> DataFrame:
    """Adds ``maturity`` as ``estimate_maturity`` does, computed once for each contract and year and joined back; sent to all tasks where the calendar is small."""
    if "root" not in df.columns:
        return estimate_maturity(df, rules)
    key = ["root", "ticker", "ref_year"]
    calendar = contract_calendar(df, rules).where("maturity is not null")
    return df.withColumn("ref_year", F.year("date")).join(broadcast_if_small(calendar), key, "left").select(*(F.col(f"`{c}`") for c in df.columns), "maturity")
