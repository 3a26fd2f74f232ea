"""Named treatments of bulletin rows: projections, row filters and fills."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from ..functions import names as N
from ..functions import scalars as S
from ..functions.sizes import broadcast_if_small
from ..sources.folders import new_path

OHLC = ["Open", "High", "Low", "Close"]
# fixed values: series column of each canonical name
SERIES = {"open": "Open", "high": "High", "low": "Low", "close": "Close", "volume": "Volume", "contracts_traded": "Volume_Qty"}


def number(df: DataFrame, name: str):
    """A number column as a double; text by the localized rules."""
    col = F.col("`" + name.replace("`", "``") + "`")
    return col.cast("double") if isinstance(df.schema[name].dataType, NumericType) else S.pt_number(col)


def treat_raw(df: DataFrame) -> DataFrame:
    return df


def _renamed(df: DataFrame, name_of: Callable[[str], str], numeric: Callable[[str, str], bool]) -> DataFrame:
    """Columns under new names (the first of each), those that ``numeric(old, new)`` picks as doubles."""
    first: dict[str, str] = {}
    for c in df.columns:
        first.setdefault(name_of(c), c)
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    return df.select([(number(df, c) if numeric(c, n) else F.col(quoted(c))).alias(n) for n, c in first.items()])


def treat_regular(df: DataFrame) -> DataFrame:
    """Localized numbers as doubles; names stay."""
    return _renamed(df, lambda c: c, lambda c, _: N.sanitize(c) in N.NUMERIC)


def treat_standard(df: DataFrame) -> DataFrame:
    """Localized numbers as doubles, canonical names, the first of equal names."""
    counts = ("contracts_traded", "open_interest", "close_interest", "volume")
    return _renamed(df, N.canonical, lambda c, n: N.sanitize(c) in N.NUMERIC or n in counts)


def treat_agg_standard(df: DataFrame) -> DataFrame:
    """The aggregate's flavour: sanitized names, no canonical ones."""
    return _renamed(df, lambda c: N.sanitize(c) or c, lambda _, n: n in N.NUMERIC)


def treat_ohlcv(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """date, ticker (or ``keys``) and the series columns that are there, as doubles; rows without a date go."""
    df = treat_standard(df)
    have = [c for c in SERIES if c in df.columns]
    keys = ["date", *(keys or [c for c in ("ticker",) if c in df.columns])]
    return df.where("date is not null").select(*keys, *(number(df, c).alias(SERIES[c]) for c in have))


def _all_zero(df: DataFrame, cols: list[str], eps: float):
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.coalesce(F.abs(F.col(c)) <= eps, F.lit(False))
    return cond


def treat_ohlcv_drop0(df: DataFrame, cols: list[str] | None = None, eps: float = 0.0) -> DataFrame:
    """Drops rows whose prices are all known and zero."""
    out = treat_ohlcv(df)
    cols = [c for c in cols or OHLC if c in out.columns]
    return out.where(~_all_zero(out, cols, eps)) if cols else out


def carried_over(df: DataFrame, cols: list[str], keys: list[str], from_last: bool = False) -> DataFrame:
    """The last (or next) known value of each column, by date, in blocks: for series that are too long for one task each, or a single one.

    Rows are dealt by ranges of keys and date and written with the number of their block. Each block is filled by
    itself; what it knows at its end (a row for each series and block) is carried to the series' next blocks, and joined back
    to the rows that have nothing before them in their own.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, "carried-blocks")
    block, known, one = "block__", "known__", "one__"
    dealt = df.repartitionByRange(*keys, "date").withColumn(block, F.spark_partition_id())
    dealt.write.parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)
    keyed = rows.withColumn(one, F.lit(0))
    w = Window.partitionBy(block, *keys).orderBy("date")
    frame = w.rowsBetween(0, Window.unboundedFollowing) if from_last else w.rowsBetween(Window.unboundedPreceding, 0)
    filled = keyed.withColumns({c: (F.first if from_last else F.last)(c, ignorenulls=True).over(frame) for c in cols})
    pick = F.min_by if from_last else F.max_by
    ends = keyed.groupBy(one, *keys, block).agg(*(pick(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in cols))
    # a series has few blocks: one array holds what they know
    series = ends.groupBy(one, *keys).agg(F.sort_array(F.collect_list(F.struct(block, *cols)), asc=not from_last).alias(known))

    def before(c: str):
        """What the blocks before a row's own know last."""
        values = F.transform(F.slice(known, F.lit(1), F.col("at__")), lambda x: x[c])
        return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1))

    carry = series.select(*keys, known, F.posexplode(known).alias("at__", "own__"))
    carry = carry.select(*keys, F.col(f"own__.{block}").alias(block), *(before(c).alias(f"{c}__") for c in cols))
    carry = carry.select(F.struct(*keys, block).alias(one), *(f"{c}__" for c in cols))
    same = F.struct(*keys, block)
    out = filled.drop(one).join(broadcast_if_small(carry), same.eqNullSafe(F.col(one)), "left")
    return out.select(*(F.coalesce(c, f"{c}__").alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns))


def treat_ohlcv_locf(df: DataFrame, zero_to_na_first: bool = True, cols: list[str] | None = None, from_last: bool = False, eps: float = 0.0, leading: str = "keep", keys: list[str] | None = None, blocked: bool | None = None) -> DataFrame:
    """Carries the last (or next) known price of each ticker; volumes stay as they are.

    Rows without a ticker are one series; ``keys`` names columns that tell series apart instead. With ``blocked`` (by
    default where there is nothing to tell series apart) a series is carried on in blocks by many tasks.
    """
    out = treat_ohlcv(df, keys)
    keys = keys or [c for c in ("ticker",) if c in out.columns]
    cols = [c for c in cols or OHLC if c in out.columns]
    if zero_to_na_first and cols:
        zero = _all_zero(out, cols, eps)
        out = out.select([F.when(~zero, F.col(c)).alias(c) if c in cols else F.col(c) for c in out.columns])
    if cols and (not keys if blocked is None else blocked):
        out = carried_over(out, cols, keys, from_last)
    elif cols:
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date")
        frame = w.rowsBetween(0, Window.unboundedFollowing) if from_last else w.rowsBetween(Window.unboundedPreceding, 0)
        pick = F.first if from_last else F.last
        out = out.withColumns({c: pick(c, ignorenulls=True).over(frame) for c in cols})
    return out.dropna("all", subset=cols) if leading == "drop" and cols else out


# fixed values: names in the clean table, and columns that it leaves out
CLEAN = {
    "contr_negoc": "volume_qty", "contract_negoc": "volume_qty", "contracts_traded": "volume_qty", "vol": "volume",
    "preco_abert": "open", "preco_min": "low", "preco_max": "high", "ult_preco": "close",
}
CLEAN_DROPPED = [
    "contract_code", "vencto", "contr_abert_1", "open_interest", "contr_fech_2", "close_interest", "num_negoc", "trade_count",
    "preco_med", "average_price", "ajuste", "settlement_price", "var_ptos", "change_points", "ult_of_compra", "last_bid", "ult_of_venda", "last_ask",
]


def treat_clean_data(df: DataFrame) -> DataFrame:
    """Sanitized names and numbers without the redundant columns, volumes and prices under short names."""
    out = treat_agg_standard(df).drop(*CLEAN_DROPPED)
    return _renamed(out, lambda c: CLEAN.get(c, c), lambda *_: False)


def treat_clean_data_drop0(df: DataFrame, cols: tuple[str, ...] = ("volume_qty", "volume", "open", "low", "high", "close")) -> DataFrame:
    """Keeps rows whose volumes and prices are all known and not zero."""
    out = treat_clean_data(df)
    for c in cols:
        if c in out.columns:
            out = out.where(F.coalesce(F.col(c).try_cast("double") != 0, F.lit(False)))
    return out


TREATMENTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "raw": treat_raw, "regular": treat_regular, "standard": treat_standard, "standard_xts": treat_ohlcv,
    "ohlcv": treat_ohlcv, "ohlcv_xts": treat_ohlcv, "ohlcv_drop0": treat_ohlcv_drop0, "ohlcv_locf": treat_ohlcv_locf,
    "ohlcv_drop0_xts": treat_ohlcv_drop0, "ohlcv_locf_xts": treat_ohlcv_locf,
}
#: Looked up first for the aggregate table.
AGGREGATE_TREATMENTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "standard": treat_agg_standard, "clean_data": treat_clean_data, "clean_data_drop0": treat_clean_data_drop0,
}


#: Rows of one group that a grouped treatment may hold at once.
GROUP_ROWS = 1_000_000


def grouped_treatment(function: Callable, schema: str, keys: tuple[str, ...] = ("ticker",), most: int = GROUP_ROWS) -> Callable[[DataFrame], DataFrame]:
    """A treatment from a user's function of one group's rows (a pandas frame, by date) to rows of the schema declared.

    Groups are dealt out by Spark; one of more than ``most`` rows is an error, told before any group is treated, as a task
    holds a whole group. Columns of the keys that are missing are an error too.
    """

    def treat(df: DataFrame) -> DataFrame:
        missing = set(keys) - set(df.columns)
        if missing:
            raise ValueError(f"missing columns: {sorted(missing)}")
        large = df.groupBy(*keys).count().where(F.col("count") > most).first()
        if large:
            raise ValueError(f"{', '.join(str(large[k]) for k in keys)} has {large['count']} rows; a group may have {most}")
        by_date = (lambda rows: function(rows.sort_values("date", kind="stable", ignore_index=True))) if "date" in df.columns else function
        return df.groupBy(*keys).applyInPandas(by_date, schema)

    return treat


def resolve_treatment(name: str | Callable[[DataFrame], DataFrame], aggregate: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A treatment by its name in any case (``_tibble`` names are the same data), or the callable given."""
    if callable(name):
        return name
    known = TREATMENTS | AGGREGATE_TREATMENTS if aggregate else TREATMENTS
    found = known.get(name.strip().lower().removesuffix("_tibble"))
    if found is None:
        raise ValueError(f"unknown treatment {name!r}; known: {', '.join(sorted(known))}")
    return found
