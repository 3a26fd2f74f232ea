"""Column functions: localized numbers, names, tickers and weekday arithmetic. Nulls in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: contract month letters, month names in two languages
MONTH_LETTERS = "FGHJKMNQUVXZ"
MONTH_NAMES = {
    "JAN": "F", "FEB": "G", "FEV": "G", "MAR": "H", "APR": "J", "ABR": "J", "MAY": "K", "MAI": "K", "JUN": "M",
    "JUL": "N", "AUG": "Q", "AGO": "Q", "SEP": "U", "SET": "U", "OCT": "V", "OUT": "V", "NOV": "X", "DEC": "Z", "DEZ": "Z",
}
OLD_ROOTS = {"BOI": "BGI", "ICN": "CCM"}

SPACE = " \t\r\n"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_ACCENTED = "ÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑáàâãäåéèêëíìîïóòôõöúùûüçñ"
_PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUCNaaaaaaeeeeiiiiooooouuuucn"


def lookup(values: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def pt_number(col: Column) -> Column:
    """Text such as ``1.234,5-`` as a double; blanks, ``&nbsp;`` and other text are null."""
    t = F.btrim(col, F.lit(SPACE))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[+-]$", ""), r"\.", ""), ",", ".")
    plain = F.btrim(plain, F.lit(SPACE))
    value = F.when(plain.rlike(_NUMBER), plain.try_cast("double"))
    return F.when(t.endswith("-"), -F.abs(value)).otherwise(value)


def fold_accents(col: Column) -> Column:
    return F.translate(col, _ACCENTED, _PLAIN)


def sanitize_name(col: Column) -> Column:
    t = F.regexp_replace(fold_accents(F.btrim(col, F.lit(SPACE))), "[^A-Za-z0-9]+", "_")
    return F.lower(F.btrim(t, F.lit("_")))


def normalize_root(col: Column) -> Column:
    t = F.upper(F.btrim(col, F.lit(SPACE)))
    return F.when(t != "", t)


def parse_date(col: Column) -> Column:
    """ISO or day/month/year; impossible dates are null."""
    t = F.btrim(col, F.lit(SPACE))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
    return F.coalesce(iso, F.when(t.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(t, "dd/MM/yyyy")))


def contract_code(col: Column) -> Column:
    t = F.regexp_replace(F.upper(col), r"\s+", "")
    return F.when(t != "", t)


def ticker_of(code: Column, root: Column) -> Column:
    return F.when(code.startswith(root), code).otherwise(F.concat(root, code))


TICKER_FORM = f"^([A-Z0-9]{{3,4}})([{MONTH_LETTERS}])([0-9]{{2}})$"


def ticker_part(ticker: Column, part: int) -> Column:
    """1: root, 2: month letter, 3: two-digit year; null where the ticker has another form."""
    t = F.regexp_extract(ticker, TICKER_FORM, part)
    return F.when(t != "", t)


def month_number(letter: Column) -> Column:
    return lookup({m: i + 1 for i, m in enumerate(MONTH_LETTERS)}, letter)


def contract_year(yy: Column, ref: Column | None = None) -> Column:
    """Century of a two-digit year: near the reference date, or by a fixed pivot without one."""
    y = yy.cast("int")
    pivot = F.when(y <= 40, y + 2000).otherwise(y + 1900)
    if ref is None:
        return pivot
    r = F.year(ref)  # the only year with these digits from 49 years before to 50 years after
    return F.coalesce(r - 49 + F.pmod(y - r + 49, F.lit(100)), pivot)


def month_code(ticker: Column, roots: list[str]) -> Column:
    """What follows the longest matching root, first character; the ticker's own first one without a match."""
    rest = ticker
    for root in sorted(set(roots), key=lambda r: (len(r), r)):
        rest = F.when(ticker.startswith(root), F.substring(ticker, len(root) + 1, 1_000)).otherwise(rest)
    first = F.substring(rest, 1, 1)
    return F.when(first != "", first)


def weekday0(d: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(d) - 1


def is_business_day(d: Column) -> Column:
    return F.coalesce(F.dayofweek(d).between(2, 6), F.lit(False))


def roll_back(d: Column) -> Column:
    """The day itself, or the Friday before a weekend."""
    return F.date_add(d, -F.when(F.dayofweek(d) == 1, 2).when(F.dayofweek(d) == 7, 1).otherwise(0))


def next_business_day(d: Column, n: Column | int = 1) -> Column:
    """The n-th weekday strictly after d."""
    n = F.lit(n) if isinstance(n, int) else n
    base = roll_back(d)
    steps = F.weekday(base) + n
    return F.date_add(base, (n + 2 * F.floor(steps / 5)).cast("int"))


def previous_business_day(d: Column, n: Column | int = 1) -> Column:
    """The n-th weekday strictly before d."""
    n = F.lit(n) if isinstance(n, int) else n
    ahead = F.date_add(d, F.when(F.dayofweek(d) == 1, 1).when(F.dayofweek(d) == 7, 2).otherwise(0))
    steps = 4 - F.weekday(ahead) + n
    return F.date_add(ahead, (-(n + 2 * F.floor(steps / 5))).cast("int"))


def first_business_day(y: Column, m: Column) -> Column:
    d = F.make_date(y, m, F.lit(1))
    return F.date_add(d, F.when(F.dayofweek(d) == 1, 1).when(F.dayofweek(d) == 7, 2).otherwise(0))


def last_business_day(y: Column, m: Column) -> Column:
    return roll_back(F.last_day(F.make_date(y, m, F.lit(1))))


def business_day_before(y: Column, m: Column, day: int, offset: int) -> Column:
    d = roll_back(F.make_date(y, m, F.lit(day)))
    return previous_business_day(d, offset) if offset > 0 else d


def nearest_weekday(y: Column, m: Column, day: int, weekday: int) -> Column:
    t = F.make_date(y, m, F.lit(day))
    return F.date_add(t, F.pmod(F.lit(weekday + 3) - weekday0(t), F.lit(7)) - 3)


def old_ticker(ticker: Column) -> Column:
    """New form of a ticker such as ``BOIOUT8``; null for all others."""
    form = r"^([A-Z]{3})([A-Z]{3})(\d)$"
    root, letter = F.regexp_extract(ticker, form, 1), lookup(MONTH_NAMES, F.regexp_extract(ticker, form, 2))
    return F.concat(F.coalesce(lookup(OLD_ROOTS, root), root), letter, F.lit("9"), F.regexp_extract(ticker, form, 3))
