"""Report pages: golden pages, round trips, registry, store and streaming ingest."""

import datetime as dt

import pytest

from tidefut.functions import names as N
from tidefut.jobs import registry, report_queries, update
from tidefut.operators import treatments as T
from tidefut.sources import page_tables as H
from tidefut.sources import reports as P
from tidefut.sources import store
from tidefut.streaming.arrivals import ingest_arrivals

from .test_futures import test_query_matches_sql as matches_sql

# fixed values: element identifiers, header texts and the date's stamp
PAGE = """<html><body><div id='MercadoFut0'><table><tr><td>VENCTO</td></tr><tr><td>DOLN23</td></tr><tr><td>DOLQ23</td></tr></table></div>
<div id='MercadoFut1'><table><tr><td>VENCTO</td><td>CONTR. ABERT.(1)</td><td>NUM. NEGOC.</td><td>CONTR. NEGOC.</td><td>VOL.</td></tr>
<tr><td>DOLN23</td><td>72.310</td><td>417</td><td>6.640</td><td>33.987</td></tr><tr><td>DOLQ23</td><td>95</td><td>0</td><td>0</td><td>0</td></tr></table></div>
<div id='MercadoFut2'><table><tr><td rowspan='2'>VENCTO</td><td colspan='5'>Cotacoes</td></tr>
<tr><td>VENCTO</td><td>PRECO ABERT.</td><td>PRECO MIN.</td><td>PRECO MAX.</td><td>ULT. PRECO</td><td>AJUSTE</td></tr>
<tr><td>DOLN23</td><td>5.010,50</td><td>4.987,00</td><td>5.043,50</td><td>5.031,00</td><td>5.029,25</td></tr></table></div>
<td>ATUALIZADO EM 15/03/2023</td></body></html>"""
NOTICE = "<html><p>Não há &nbsp;dados para a\ndata &nbsp; consultada</p></html>"
CHOICES = "<select id='comboMerc1' name='cboMercadoria'><option value='0'>x</option><option value='ICF  '>ICF  : a</option><option value='BGI  '>BGI  : b</option></select>"
DAY = dt.date(2023, 3, 1)


def pages(spark, *items):
    rows = [(f"/x/{root}_2023-03-{i + 1:02}.html", root, dt.date(2023, 3, i + 1), None if html is None else html.encode("cp1252")) for i, (root, html) in enumerate(items)]
    return spark.createDataFrame(rows, "path string, root string, date date, content binary")


def test_golden_page(spark):
    rows = {r.ticker: r for r in P.bulletin_rows(P.parse_reports(pages(spark, (" dol", PAGE)))).collect()}
    row = rows["DOLN23"]
    got = (row.date, row.root, row.open, row.low, row.high, row.close, row.settlement_price, row.open_interest, row.volume)
    assert got == (dt.date(2023, 3, 15), "DOL", 5010.5, 4987.0, 5043.5, 5031.0, 5029.25, 72310.0, 33987.0)
    assert (rows["DOLQ23"].open_interest, rows["DOLQ23"].open) == (95.0, None)


def test_pages_without_data(spark):
    parsed = P.parse_reports(pages(spark, ("DOL", NOTICE), ("CCM", CHOICES), ("BGI", CHOICES), ("DOL", None), ("DOL", ""), ("DOL", PAGE), ("XYZ", "<div id=MercadoFut0><table><tr><td>A</td></tr><tr><td>1</td></tr></table></div>")))
    assert {r.date.day: r.status for r in parsed.collect()} == {1: "no_data", 2: "no_data", 3: "no_data", 4: "no_data", 5: "no_data", 6: "ok", 7: "error"}
    assert P.no_data_reports(parsed).count() == 5 and P.bulletin_rows(parsed).count() == 2


def test_flags(spark):
    r = P.flag_reports(pages(spark, ("CCM", CHOICES))).first()
    assert (r.no_data, r.root_options, r.root_available, r.report_date) == (False, ["0", "ICF", "BGI", "X"], False, DAY)
    assert P.flag_reports(pages(spark, ("CCM", NOTICE))).first().no_data


def test_scripted_table_with_broken_tags():
    cells = "<table><tr><td>AJUSTE ANTER. <sup>(3)</sup</td><td>AJUSTE CORRIG. <sup>(4)</sup</td><td>PRECO ABERT.</td><td>PRECO MIN.</td></tr><tr><td>4.118,75</td><td>4.120,10</td><td>4.101,00</td><td>0,000</td></tr></table>"
    html = f"<div id='MercadoFut2'></div><script>\nvar W = '';\nW = W + '{cells}';\nMercadoFut2.innerHTML = W;\n</script>"
    assert H.page_tables(html) == [(["AJUSTE ANTER. (3)", "AJUSTE CORRIG. (4)", "PRECO ABERT.", "PRECO MIN."], [["4.118,75", "4.120,10", "4.101,00", "0,000"]])]


def test_headers():
    assert N.spread(["contract_code", "preco_med_ult_precoajuste_var_ptos_ult_of_comprault_of_venda"]) == ["contract_code", "average_price"]
    long = "ULT. PRECOAJUSTE\t\t\tVAR. PTOS. ULT. OF. COMPRAULT. OF. VENDA"
    assert N.spread(["contract_code", long, "V8", "V9", "V10", "V11"])[1:] == ["close", "settlement_price", "change_points", "last_bid", "last_ask"]
    assert H.tidy([["VENCTO", long, "", "", "", ""], ["F25", "1", "2", "3", "4", "5"]])[0] == ["VENCTO", "ULT. PRECO", "AJUSTE", "VAR. PTOS.", "ULT. OF. COMPRA", "ULT. OF. VENDA"]
    assert H.tidy([["A", "B", "C", "A"], ["1", "2", "3"]]) == (["A", "B", "C"], [["1", "2", "3"]])
    assert H.tidy([["A"]]) is None and H.tidy([]) is None


def test_truncated_names(spark):
    df = spark.createDataFrame([("ICFU22", "1.205", "30.417", "29.900", "7.654.321")], "ticker string, contr string, abert_1 string, fech_2 string, num string")
    r = T.treat_standard(df).first()
    assert (r.contracts_traded, r.open_interest, r.close_interest, r.volume) == (1205.0, 30417.0, 29900.0, 7654321.0)


def test_clean_data(spark):
    df = spark.createDataFrame([("A", "AF25", "1", 2.0, 0.0, 1.0, 3.0)], "root string, ticker string, contract_code string, contracts_traded double, open double, close double, previous_settlement double")
    assert T.treat_clean_data(df).columns == ["root", "ticker", "volume_qty", "open", "close", "previous_settlement"]
    assert T.treat_clean_data_drop0(df).count() == 0


def test_registry_round_trip(spark, tmp_path):
    first = spark.createDataFrame([("ABC_2021-08-09.html",), ("ABC_2021-08-09.html",), ("nonsense",)], "filename string")
    store.write_no_data_registry(None, first, f"{tmp_path}/a")
    old = store.read_no_data_registry(spark, f"{tmp_path}/a")
    assert [tuple(r) for r in old.collect()] == [("ABC_2021-08-09.html", "ABC", dt.date(2021, 8, 9))]
    store.write_no_data_registry(old, spark.createDataFrame([("win_2021-08-10.html",), ("ABC_2021-08-09.html",)], "filename string"), f"{tmp_path}/b")
    assert store.read_no_data_registry(spark, f"{tmp_path}/b").count() == 2
    assert store.read_no_data_registry(spark, f"{tmp_path}/a", f"{tmp_path}/b", root=" win ").count() == 1


def tickers(spark, folder):
    return sorted((r.root, r.ticker) for r in store.read_bulletins(spark, f"{folder}/bulletins").collect())


def test_store_takes_new_days_and_leaves_old_ones(spark, tmp_path):
    folder = f"{tmp_path}/store"
    update.update_store(spark, pages(spark, ("DOL", NOTICE), ("DOL", PAGE)), folder)
    assert tickers(spark, folder) == [("DOL", "DOLN23"), ("DOL", "DOLQ23")]
    other = PAGE.replace("DOL", "WIN").replace("15/03/2023", "16/03/2023")
    for _ in range(2):
        update.update_store(spark, pages(spark, ("DOL", NOTICE), ("DOL", PAGE), ("WIN", other)), folder)
    assert tickers(spark, folder) == [("DOL", "DOLN23"), ("DOL", "DOLQ23"), ("WIN", "WINN23"), ("WIN", "WINQ23")]
    assert store.collect_parsed_days(spark, f"{folder}/parsed").select("root", "date").distinct().count() == 2
    assert spark.read.parquet(f"{folder}/no_data").count() == 1


def test_store_loses_skipped_days_and_emptied_years(spark, tmp_path):
    """A day is skipped after it was stored: it goes at the next run, with or without new pages, and so does its year."""
    folder = f"{tmp_path}/store"
    day = lambda d, root="DOL": PAGE.replace("DOL", root).replace("15/03/2023", f"{d:02}/03/2023")
    first = pages(spark, ("DOL", day(1)), ("WIN", day(2, "WIN")), ("WIN", day(3, "WIN")))
    update.update_store(spark, first, folder)
    skip = spark.createDataFrame([("DOL_2023-03-01.html", "DOL", dt.date(2023, 3, 1)), ("WIN_2023-03-02.html", "WIN", dt.date(2023, 3, 2))], "filename string, root string, date date")
    skip.write.mode("append").parquet(f"{folder}/no_data")
    update.update_store(spark, first, folder)
    assert tickers(spark, folder) == [("WIN", "WINN23"), ("WIN", "WINQ23")]
    assert not (tmp_path / "store/bulletins/root=DOL/year=2023").exists()
    # a corrected page of a stored day comes in only when asked for
    corrected = pages(spark, ("DOL", day(1)), ("WIN", day(2, "WIN")), ("WIN", day(3, "WIN").replace("5.031,00", "5.032,00")))
    update.update_store(spark, corrected, folder)
    close = lambda: {r.close for r in store.read_bulletins(spark, f"{folder}/bulletins").where("ticker = 'WINN23'").collect()}
    assert close() == {5031.0}
    update.update_store(spark, corrected, folder, refresh=corrected.select("root", "date"))
    assert close() == {5032.0}


def test_one_bad_page_does_not_stop_the_others(spark, monkeypatch):
    from tidefut.sources import page_tables

    real = page_tables.page_rows
    monkeypatch.setattr(page_tables, "page_rows", lambda html: real(html) if "bad" not in html else 1 // 0)
    frames = P._parse(iter([__import__("pandas").DataFrame([("a", "DOL", DAY, DAY, True, b"bad"), ("b", "DOL", DAY, DAY, True, PAGE.encode())])]))
    assert [(r.path, r.status) for f in frames for r in f.itertuples()] == [("a", "error"), ("b", "ok"), ("b", "ok")]


def test_arriving_files(spark, tmp_path):
    folder = tmp_path / "raw" / "DOL"
    folder.mkdir(parents=True)
    (folder / "DOL_2023-03-15.html").write_text(PAGE, encoding="cp1252")
    (folder / "other.html").write_text(PAGE)
    assert store.read_reports(spark, str(tmp_path / "raw")).count() == 1
    for _ in range(2):
        ingest_arrivals(spark, str(tmp_path / "raw"), f"{tmp_path}/store", f"{tmp_path}/cp").awaitTermination()
    assert {r.close for r in store.read_bulletins(spark, f"{tmp_path}/store/bulletins").collect()} == {5031.0, None}


@pytest.mark.parametrize("name", sorted(report_queries.QUERIES))
def test_report_query_matches_sql(spark, name):
    matches_sql(spark, name)


def test_only_pages_go_through_python(spark):
    for name in set(registry.queries()) - {"parsed_reports", "no_data_registry", "updated_roots", "rebuilt_roots", "stored_days", "stored_update", "rebuilt_store", "stored_registry", "stored_bulletins", "store_in_three_runs", "arrived_pages", "compacted_days", "unknown_columns", "grouped_treatment", "backward_in_appends", "forward_in_appends"}:
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InPandas" not in plan and "Cartesian" not in plan, name
