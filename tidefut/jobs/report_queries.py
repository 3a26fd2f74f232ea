"""Queries over report pages rendered from the quotes: the parser must give the quotes back.

By the day of the month, a page has no data (0), doesn't list its root (7), has its prices in a
script (5), or has plain tables below a two-row header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import merge as M
from ..operators import treatments as T
from ..sources import reports as P
from ..sources import store
from ..sources.folders import new_path
from ..streaming.arrivals import ingest_arrivals
from . import retrieve as R
from . import update as U
from .quotes import DAILY, WEEKLY, quotes

QUERIES: dict[str, tuple] = {}


def register(sql: str):
    def keep(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return keep


def localized(number: Column, places: int = 2) -> Column:
    return F.translate(F.format_number(number, places), ",.", ".,")


def _row(*cells) -> Column:
    return F.concat(F.lit("<tr>"), *(x for c in cells for x in (F.lit("<td>"), c if isinstance(c, Column) else F.lit(c), F.lit("</td>"))), F.lit("</tr>"))


def rendered(spark: SparkSession, sf_dir: str, more: Column | int = 0, weekly: bool = False, own: bool = False) -> DataFrame:
    """One page for each root and day (or week); a page lists the few contracts of its day. ``more`` is added to closing prices; ``own`` adds a column of a name unknown so far, whose texts hold the plain count."""
    day = F.dayofmonth("date") % 10
    code = F.when(F.dayofmonth("date") % 2 == 0, F.col("ticker")).otherwise(F.substring("ticker", 4, 3))
    q = quotes(spark, sf_dir, weekly).withColumn("close", F.col("close") + more)
    q = q.select("date", "root", "ticker", code.alias("code"), *(localized(F.col(c)).alias(c) for c in ("open", "low", "high", "close", "volume")), *(localized(F.col(c), 0).alias(c) for c in ("volume_qty", "trade_count")), F.concat(F.lit("m"), F.col("trade_count")).alias("margin"))
    cell = F.struct("ticker", _row(F.col("code")).alias("c"), _row(F.concat(F.lit(" "), F.lower("code"), F.lit("&nbsp;")), "5", F.col("trade_count"), F.col("volume_qty"), F.col("volume"), *([F.col("margin")] if own else [])).alias("v"), _row(*(F.col(c) for c in ("code", "open", "low", "high", "close")), "0,50-").alias("p"))
    page = q.groupBy("root", "date").agg(F.sort_array(F.collect_list(cell)).alias("rows"), F.first(F.date_format("date", "dd/MM/yyyy")).alias("day"))
    body = lambda part: F.array_join(F.transform("rows", lambda r: r[part]), "")
    reverse = lambda part: F.array_join(F.transform(F.reverse("rows"), lambda r: r[part]), "")
    prices = F.concat(F.lit("<table>"), _row("VENCTO", "Cotacoes"), _row("VENCTO", "PRECO ABERT.", "PRECO MIN.", "PRECO MAX.", "ULT. PRECO", "VAR. PTOS."), reverse("p"), F.lit("</table>"))
    scripted = F.concat(F.lit("<div id=MercadoFut2></div><script>var T = '';\nT = T + '<table>"), _row("VENCTO", "PREÇO ABERT.", "PREÇO MIN.", "PREÇO MAX.", "ÚLT. PREÇO", "VAR. PTOS.<sup></sup"), F.lit("';\nT = T + '"), reverse("p"), F.lit("</table>';\nMercadoFut2.innerHTML = T;</script>"))
    choices = F.concat(F.lit("<select id='comboMerc1'><option value='0'>-</option><option value='"), F.when(day == 7, "XXX").otherwise(F.col("root")), F.lit("  '>"), F.lower(F.when(day == 7, "XXX").otherwise(F.col("root"))), F.lit(" : name</option></select>"))
    tables = F.concat(
        F.lit("<div id='MercadoFut0'><table>"), _row("VENCTO"), body("c"), F.lit("</table></div><div id='MercadoFut1'><table>"),
        _row("VENCTO", "CONTR. ABERT.(1)", "NUM. NEGOC.", "CONTR. NEGOC.", "VOL.", *(["MARGEM (7)"] if own else [])), reverse("v"), F.lit("</table></div>"),
        F.when(day == 5, scripted).otherwise(F.concat(F.lit("<div id='MercadoFut2'>"), prices, F.lit("</div>"))),
    )
    html = F.when(day == 0, F.lit("<p>Não há &nbsp;dados para a\ndata &nbsp; consultada</p>")).otherwise(F.concat(choices, tables, F.lit("<table><tr><td>ATUALIZADO EM "), F.col("day"), F.lit("</td></tr></table>")))
    path = F.concat_ws("/", F.lit("reports"), "root", F.concat("root", F.lit("_"), F.col("date").cast("string"), F.lit(".html")))
    return page.select(path.alias("path"), "root", "date", F.encode(html, "ISO-8859-1").alias("content"))


_GOOD = "day(date) % 10 NOT IN (0, 7)"
_ROWS = "date, root, ticker, open, low, high, close, volume, volume_qty AS contracts_traded, CAST(trade_count AS DOUBLE) AS trade_count"


@register(f"WITH q AS ({DAILY}) SELECT {_ROWS}, 5.0 AS open_interest, -0.5 AS change_points FROM q WHERE {_GOOD}")
def parsed_reports(spark, sf_dir):
    rows = P.bulletin_rows(P.parse_reports(rendered(spark, sf_dir)))
    return rows.select("date", "root", "ticker", "open", "low", "high", "close", "volume", "contracts_traded", "trade_count", "open_interest", "change_points")


@register(f"WITH q AS (SELECT DISTINCT root, date FROM ({DAILY}) x) SELECT concat(root, '_', CAST(date AS VARCHAR), '.html') AS filename, root, date FROM q WHERE NOT {_GOOD}")
def no_data_registry(spark, sf_dir):
    return P.no_data_reports(P.parse_reports(rendered(spark, sf_dir)))


@register(
    f"""WITH q AS (SELECT DISTINCT root, date FROM ({DAILY}) x)
SELECT root, date, day(date) % 10 = 0 AS no_data, day(date) % 10 <> 7 AS root_available, CASE day(date) % 10 WHEN 0 THEN '' WHEN 7 THEN '-,0,XXX' ELSE concat('-,0,', root) END AS options, date AS report_date FROM q"""
)
def flagged_reports(spark, sf_dir):
    flags = P.flag_reports(rendered(spark, sf_dir).withColumn("date", F.when(F.dayofmonth("date") % 10 == 0, F.col("date")).otherwise(F.date_add("date", 1))))
    day = F.col("report_date")
    return flags.select("root", day.alias("date"), "no_data", "root_available", F.array_join(F.sort_array("root_options"), ",").alias("options"), "report_date")


_SKIP = "day(date) <> 13"


@register(f"WITH q AS ({DAILY}) SELECT date, root, ticker, close FROM q WHERE {_SKIP} AND (month(date) < 6 OR {_GOOD})")
def updated_roots(spark, sf_dir):
    q = quotes(spark, sf_dir).withColumn("contract_code", F.col("ticker")).withColumnRenamed("volume_qty", "contracts_traded")
    skip = q.where(F.dayofmonth("date") == 13).select("root", "date").distinct()
    return U.update_roots(rendered(spark, sf_dir), q.where(F.month("date") < 6), skip).bulletins.select("date", "root", "ticker", "close")


@register(f"WITH q AS ({DAILY}) SELECT date, root, ticker, close FROM q WHERE {_SKIP} AND {_GOOD}")
def rebuilt_roots(spark, sf_dir):
    pages = rendered(spark, sf_dir)
    return U.rebuild_roots(pages, pages.where(F.dayofmonth("date") == 13)).bulletins.select("date", "root", "ticker", "close")


@register(f"WITH q AS (SELECT DISTINCT root, date FROM ({DAILY}) x) SELECT root, date FROM q WHERE {_SKIP} AND month(date) >= 6")
def pending_reports(spark, sf_dir):
    pages = quotes(spark, sf_dir).select("root", "date").distinct()
    return U.pending_reports(pages, pages.where(F.month("date") < 6), pages.where(F.dayofmonth("date") == 13))


@register(f"WITH q AS (SELECT DISTINCT root, date FROM ({DAILY}) x) SELECT root, date FROM q WHERE month(date) >= 6 OR day(date) % 3 = 0")
def stale_reports(spark, sf_dir):
    pages = quotes(spark, sf_dir).select("root", "date").distinct()
    version = F.when(F.dayofmonth("date") % 3 == 0, P.PARSER_VERSION - 1).otherwise(P.PARSER_VERSION)
    return store.stale_reports(pages, pages.where(F.month("date") < 6).withColumn("parser_version", version))


def _texts(spark, sf_dir) -> DataFrame:
    """Quotes under headers of the bulletins, numbers as localized text."""
    q = quotes(spark, sf_dir)
    as_text = {"PREÇO ABERT.": localized(F.col("open")), "ULT. PRECO": F.concat(localized(F.col("close")), F.lit("-")), "CONTR. ABERT.(1)": localized(F.col("trade_count"), 0), "contr": localized(F.col("volume_qty"), 0)}
    return q.select("date", "ticker", *(v.alias(k) for k, v in as_text.items()))


@register(f"WITH q AS ({DAILY}) SELECT date, ticker, open AS first, -close AS last, CAST(trade_count AS DOUBLE) AS n, CAST(volume_qty AS BIGINT) AS contr FROM q")
def regular_treatment(spark, sf_dir):
    out = T.treat_regular(_texts(spark, sf_dir))
    contr = F.regexp_replace("contr", r"\.", "").cast("long")
    return out.select("date", "ticker", F.col("`PREÇO ABERT.`").alias("first"), F.col("`ULT. PRECO`").alias("last"), F.col("`CONTR. ABERT.(1)`").alias("n"), contr.alias("contr"))


@register(f"WITH q AS ({DAILY}) SELECT date, ticker, open, -close AS close, CAST(trade_count AS DOUBLE) AS open_interest, volume_qty AS contracts_traded FROM q")
def standard_treatment(spark, sf_dir):
    return T.treat_standard(_texts(spark, sf_dir))


@register(f"WITH q AS ({DAILY}) SELECT date, ticker, open AS preco_abert, -close AS ult_preco, CAST(trade_count AS DOUBLE) AS contr_abert_1, CAST(volume_qty AS BIGINT) AS contr FROM q")
def aggregate_standard_treatment(spark, sf_dir):
    return T.treat_agg_standard(_texts(spark, sf_dir)).withColumn("contr", F.regexp_replace("contr", r"\.", "").cast("long"))


@register(f"WITH q AS ({DAILY}) SELECT date, ticker, close FROM q")
def filled_columns(spark, sf_dir):
    q = quotes(spark, sf_dir).select("date", "ticker", "close").withColumn("nothing", F.lit(None).cast("double"))
    return M.drop_empty_columns(q)


@register(f"WITH q AS ({DAILY}) SELECT date, ticker, CASE WHEN root = 'WIN' THEN open END AS open, CASE WHEN root <> 'WIN' THEN close END AS close FROM q")
def united_tables(spark, sf_dir):
    q = quotes(spark, sf_dir)
    return M.union_by_name([q.where("root = 'WIN'").select("date", "ticker", "open"), q.where("root <> 'WIN'").select("close", "ticker", "date")])


@register(f"WITH q AS ({DAILY}) SELECT date, ticker, root, ticker AS contract_code FROM q WHERE day(date) % 2 = 0 UNION ALL SELECT date, ticker, root, right(ticker, 3) AS contract_code FROM q WHERE day(date) % 2 = 1")
def contract_keys(spark, sf_dir):
    q = quotes(spark, sf_dir)
    code = F.when(F.dayofmonth("date") % 2 == 0, F.lower("ticker")).otherwise(F.concat(F.lit(" "), F.substring("ticker", 4, 1), F.lit("\t"), F.substring("ticker", 5, 2)))
    return M.contract_keys(q.select("date", "root", code.alias("contract_code"))).select("date", "ticker", "root", "contract_code")


@register(f"WITH q AS (SELECT DISTINCT date FROM ({DAILY}) x) SELECT date, date AS iso, date AS br, CAST(NULL AS DATE) AS none FROM q")
def parsed_dates(spark, sf_dir):
    q = quotes(spark, sf_dir).select("date").distinct()
    x = F.col("date")
    return q.select("date", S.parse_date(x.cast("string")).alias("iso"), S.parse_date(F.concat(F.lit(" "), F.date_format(x, "dd/MM/yyyy"))).alias("br"), S.parse_date(F.concat(F.lit("31/02/"), F.year(x))).alias("none"))


@register("SELECT DISTINCT p_type AS raw, concat(replace(lower(p_type), ' ', '_'), '_1') AS name, upper(p_type) AS root FROM part")
def sanitized_names(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_type").distinct()
    return p.select(F.col("p_type").alias("raw"), S.sanitize_name(F.concat(F.lit(" \t"), F.col("p_type"), F.lit(" (1)."))).alias("name"), S.normalize_root(F.concat(F.lit(" "), F.lower("p_type"), F.lit("\n"))).alias("root"))


@register(f"WITH q AS ({DAILY}) SELECT date, root, ticker, greatest(ticker, substr(ticker, 4)) AS contract_code, CASE WHEN ticker > substr(ticker, 4) THEN close ELSE close - 1 END AS close FROM q WHERE {_SKIP}")
def prepared_rows(spark, sf_dir):
    """Each row twice, with its code in two forms."""
    q = quotes(spark, sf_dir)
    short = q.select("date", "root", F.concat(F.lit(" "), F.lower(F.substring("ticker", 4, 3))).alias("contract_code"), (F.col("close") - 1).alias("close"))
    whole = q.select("date", "root", F.col("ticker").alias("contract_code"), "close")
    skip = q.where(F.dayofmonth("date") == 13).select("root", "date").distinct()
    return M.prepare_root_rows(short.unionByName(whole), skip).select("date", "root", "ticker", "contract_code", "close")


@register(f"WITH q AS ({DAILY}) SELECT date, ticker, close FROM q")
def raw_treatment(spark, sf_dir):
    return T.resolve_treatment(" RAW")(quotes(spark, sf_dir).select("date", "ticker", "close"))


@register(f"WITH q AS ({DAILY}) SELECT date, ticker, close, CASE WHEN trade_count % 4 = 0 THEN 0.0 ELSE close END AS other FROM q WHERE trade_count % 4 <> 0 UNION ALL SELECT date, ticker, close, -1.0 AS other FROM q")
def resolved_treatments(spark, sf_dir):
    """Treatments by name in any case, and one given as a function."""
    q = quotes(spark, sf_dir)
    zero = F.col("trade_count") % 4 == 0
    named = T.resolve_treatment("OHLCV_drop0_tibble")(q.select("date", "ticker", F.when(zero, 0.0).otherwise(F.col("close")).alias("close")))
    own = T.resolve_treatment(lambda df: df.withColumn("other", F.lit(-1.0)))(q.select("date", "ticker", "close"))
    return named.select("date", "ticker", F.col("Close").alias("close"), F.col("Close").alias("other")).unionByName(own)


@register(f"WITH q AS (SELECT DISTINCT root, date FROM ({DAILY}) x) SELECT concat(root, '_', CAST(date AS VARCHAR), '.html') AS filename, root, date FROM q WHERE day(date) IN (13, 14)")
def stored_registry(spark, sf_dir):
    """Written, extended by days some of which it has, and read back with lines of another form beside it."""
    days = quotes(spark, sf_dir).select("root", "date").distinct()
    name = F.concat("root", F.lit("_"), F.col("date").cast("string"), F.lit(".html")).alias("filename")
    first = days.where(F.dayofmonth("date") == 13).select(name)
    one, two = new_path(spark, "registry"), new_path(spark, "registry")
    store.write_no_data_registry(None, first.unionByName(first), one)
    more = days.where(F.dayofmonth("date").isin(13, 14)).select(name).unionByName(spark.createDataFrame([("# note",), (" ",), ("other.html",)], "filename string"))
    store.write_no_data_registry(store.read_no_data_registry(spark, one), more, two)
    return store.read_no_data_registry(spark, one, two)


@register(f"WITH q AS ({DAILY}) SELECT date, root, ticker, CASE WHEN root = 'WIN' AND year(date) = 1996 THEN close + 1 ELSE close END AS close FROM q")
def stored_bulletins(spark, sf_dir):
    """All roots written, then one year of one root replaced."""
    q = quotes(spark, sf_dir).select("date", "root", "ticker", "close")
    path = new_path(spark, "bulletins")
    store.write_bulletins(q, path)
    store.write_bulletins(q.where("root = 'WIN' and year(date) = 1996").withColumn("close", F.col("close") + 1), path)
    return store.read_bulletins(spark, path)


@register(f"WITH q AS ({DAILY}) SELECT root, date, ticker FROM q WHERE {_GOOD} AND {_SKIP}")
def stored_days(spark, sf_dir):
    """Parsed pages by root and day; some days are written a second time."""
    path = new_path(spark, "parsed")
    pages = rendered(spark, sf_dir)
    store.write_parsed_days(P.parse_reports(pages.where(F.month("date") < 7)), path)
    store.write_parsed_days(P.parse_reports(pages.where(F.month("date") >= 6)), path)
    rows = store.collect_parsed_days(spark, path, pages.where(F.dayofmonth("date") == 13))
    return P.bulletin_rows(rows).select("root", "date", "ticker")


@register(f"WITH q AS ({DAILY}) SELECT date, root, ticker, CASE WHEN month(date) = 3 THEN close + 1 ELSE close END AS close FROM q WHERE {_SKIP} AND {_GOOD} AND root <> 'ICF'")
def stored_update(spark, sf_dir):
    """The store over two runs: half of the pages; then days (all of one root among them) that are skipped by now, the other pages, and some pages again, corrected."""
    folder = new_path(spark, "store")
    U.update_store(spark, rendered(spark, sf_dir).where(F.month("date") < 6), folder)
    pages = rendered(spark, sf_dir, F.when(F.month("date") < 6, 1).otherwise(0))
    days = quotes(spark, sf_dir).select("root", "date").distinct()
    skip = days.where((F.dayofmonth("date") == 13) | (F.col("root") == "ICF"))
    name = F.concat("root", F.lit("_"), F.col("date").cast("string"), F.lit(".html")).alias("filename")
    skip.select(name, "root", "date").write.mode("append").parquet(f"{folder}/no_data")
    U.update_store(spark, pages, folder, refresh=days.where(F.month("date") == 3))
    return store.read_bulletins(spark, f"{folder}/bulletins").select("date", "root", "ticker", "close")


@register(f"WITH q AS ({DAILY}) SELECT date, root, ticker, close FROM q WHERE {_SKIP} AND {_GOOD} AND month(date) >= 4")
def rebuilt_store(spark, sf_dir):
    """All pages stored, then rebuilt from fewer pages."""
    folder = new_path(spark, "store")
    pages = rendered(spark, sf_dir)
    U.update_store(spark, pages, folder)
    skip = pages.where(F.dayofmonth("date") == 13).select("root", "date")
    name = F.concat("root", F.lit("_"), F.col("date").cast("string"), F.lit(".html")).alias("filename")
    skip.select(name, "root", "date").write.mode("append").parquet(f"{folder}/no_data")
    U.rebuild_store(spark, pages.where(F.month("date") >= 4), folder)
    return store.read_bulletins(spark, f"{folder}/bulletins").select("date", "root", "ticker", "close")


def _skip_rows(days: DataFrame) -> DataFrame:
    return days.select(F.concat("root", F.lit("_"), F.col("date").cast("string"), F.lit(".html")).alias("filename"), "root", "date")


@register(f"WITH q AS ({DAILY}) SELECT date, root, ticker, close FROM q WHERE {_GOOD} AND day(date) NOT IN (13, 14) AND NOT (root = 'ICF' AND month(date) = 2)")
def store_in_three_runs(spark, sf_dir):
    """Some pages; the other pages, and days to skip; then one day that the registry gives free again, and others to skip. Each run reads what it changes."""
    folder = new_path(spark, "store")
    pages = rendered(spark, sf_dir)
    days = pages.select("root", "date")
    U.update_store(spark, pages.where(F.month("date") < 6), folder, run="one")
    free = F.dayofmonth("date") == 15
    _skip_rows(days.where(F.dayofmonth("date").isin(13, 15))).write.mode("append").parquet(f"{folder}/no_data")
    U.update_store(spark, pages, folder, run="two")
    kept = spark.read.parquet(f"{folder}/no_data").where(~free)
    more = _skip_rows(days.where((F.dayofmonth("date") == 14) | ((F.col("root") == "ICF") & (F.month("date") == 2))))
    kept.unionByName(more).write.parquet(f"{folder}/no_data_next")
    spark.read.parquet(f"{folder}/no_data_next").write.mode("overwrite").parquet(f"{folder}/no_data")
    for _ in range(2):  # the second time changes nothing
        U.update_store(spark, pages, folder, run="three")
    return R.stored_bulletins(spark, folder).select("date", "root", "ticker", "close")


@register(f"WITH q AS ({WEEKLY}) SELECT date, root, ticker, open, low, high, close, volume_qty AS contracts_traded FROM q WHERE {_GOOD}")
def arrived_pages(spark, sf_dir):
    """Pages written to storage under their names and taken by a stream: half of them, then all that came later; a committed batch once more."""
    raw, folder, checkpoint = new_path(spark, "raw"), new_path(spark, "store"), new_path(spark, "checkpoint")
    pages = rendered(spark, sf_dir, weekly=True)
    for part in (F.month("date") < 7, F.month("date") >= 7):
        store.write_reports(pages.where(part), raw)
        ingest_arrivals(spark, raw, folder, checkpoint, files_per_batch=2_000).awaitTermination()
    run = spark.read.parquet(f"{folder}/commits").agg(F.min("run")).first()[0]
    U.update_store(spark, store.read_reports(spark, raw), folder, run=run)
    return R.stored_bulletins(spark, folder).select("date", "root", "ticker", "open", "low", "high", "close", "contracts_traded")


@register(f"WITH q AS ({WEEKLY}) SELECT root, date, count(*) AS n_rows, CAST(sum(close + CASE WHEN month(date) < 7 THEN 1 ELSE 0 END) * 4 AS BIGINT) AS quarters, FALSE AS stale FROM q WHERE {_GOOD} GROUP BY root, date")
def compacted_days(spark, sf_dir):
    """Parsed in three runs, some days twice; compacted, the log still has each day's last state, and no page is stale."""
    folder = new_path(spark, "store")
    pages = rendered(spark, sf_dir, weekly=True)
    half = F.month("date") < 7
    for run, some, refresh in (("one", pages.where(half), None), ("two", pages, None), ("three", rendered(spark, sf_dir, 1, weekly=True).where(half), pages.where(half))):
        U.update_store(spark, some, folder, refresh, run=run)
    U.compact_store(spark, folder)
    stale = store.stale_reports(pages.select("root", "date"), U.day_states(spark, folder)).withColumn("stale", F.lit(True))
    rows = P.bulletin_rows(store.collect_parsed_days(spark, f"{folder}/parsed"))
    counted = rows.groupBy("root", "date").agg(F.count("*").alias("n_rows"), (F.sum("close") * 4).cast("long").alias("quarters"))
    return counted.join(stale, ["root", "date"], "full").select("root", "date", "n_rows", "quarters", F.coalesce("stale", F.lit(False)).alias("stale"))


@register(f"WITH q AS ({DAILY}) SELECT date, ticker, open AS o, close AS c, volume AS v, 'named' AS how FROM q WHERE ticker IN ('WINM96', 'DI1F97') AND date BETWEEN DATE '1996-02-01' AND DATE '1996-12-31' UNION ALL SELECT date, ticker, open, close, volume, 'joined' FROM q WHERE root IN ('WIN', 'BGI') AND date >= DATE '1996-01-01'")
def stored_contracts(spark, sf_dir):
    """Contracts by ticker from the partitions of their roots and years: a short list, and a table of tickers with many that the store lacks."""
    folder = new_path(spark, "store")
    q = quotes(spark, sf_dir)
    store.write_bulletins(q.withColumnRenamed("volume_qty", "contracts_traded"), f"{folder}/bulletins")
    short = lambda df, how: df.select("date", "ticker", F.col("Open").alias("o"), F.col("Close").alias("c"), F.col("Volume").alias("v"), F.lit(how).alias("how"))
    named = R.get_stored_contracts(spark, folder, [" winm96", "DI1F97", "nothing"], "1996-02-01", "1996-12-31")
    many = q.where("root in ('WIN', 'BGI')").select(F.lower("ticker").alias("ticker")).union(spark.range(2 * R.NAMED_TICKERS).selectExpr("concat('ZZZ', id)"))
    return short(named, "named").unionByName(short(R.get_stored_contracts(spark, folder, many, start="1996-01-01"), "joined"))


@register(f"WITH q AS ({WEEKLY}) SELECT date, root, ticker, close, CASE WHEN month(date) >= 4 THEN concat('m', trade_count) END AS margin FROM q WHERE {_GOOD}")
def unknown_columns(spark, sf_dir):
    """A column that no canonical name fits appears in later pages, is promoted, comes with further pages, and is read back from all of them."""
    folder = new_path(spark, "store")
    old, new = (rendered(spark, sf_dir, weekly=True, own=own) for own in (False, True))
    U.update_store(spark, old.where("month(date) < 4"), folder)
    U.update_store(spark, new.where("month(date) between 4 and 8"), folder)
    U.promote_extras(spark, folder, 0.1)
    U.update_store(spark, new.where("year(date) > 1993 and month(date) > 8"), folder)
    U.update_store(spark, new.where("month(date) > 8"), folder)
    rows = R.stored_bulletins(spark, folder)
    return rows.select("date", "root", "ticker", "close", F.col("margem_7").alias("margin"))
