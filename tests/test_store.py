"""The store: runs that read what they change, runs taken again, compaction, retrieval by partitions, columns of unknown names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidefut.jobs import retrieve as R
from tidefut.jobs import update as U
from tidefut.sources import store
from tidefut.streaming import arrivals

from .test_reports import NOTICE, PAGE


def page(root, day, close="5.031,00", own=False):
    html = PAGE.replace("DOL", root).replace("15/03/2023", f"{day:%d/%m/%Y}").replace("5.031,00", close)
    if own:
        html = html.replace("<td>VOL.</td>", "<td>VOL.</td><td>Margem (9)</td>").replace("<td>33.987</td>", "<td>33.987</td><td>12,5</td>")
    return html


def pages(spark, *items):
    rows = [(f"/x/{root}_{day}.html", root, day, html.encode("cp1252")) for root, day, html in items]
    return spark.createDataFrame(rows, "path string, root string, date date, content binary")


def day(month, d, year=2023):
    return dt.date(year, month, d)


def some(*days, roots=("DOL", "WIN"), **options):
    return [(r, d, page(r, d, **options)) for r in roots for d in days]


def days_of(spark, folder):
    return sorted({(r.root, r.date) for r in R.stored_bulletins(spark, folder).select("root", "date").collect()})


def files_below(folder, part):
    return [f for f in (folder / part).rglob("*.parquet")]


def test_a_run_of_one_day_reads_one_partition(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/store"
    U.update_store(spark, pages(spark, *some(day(3, 1, 2021), day(3, 1, 2022), day(3, 1))), folder)
    scans, real = [], U.stored_rows
    monkeypatch.setattr(U, "stored_rows", lambda *a: scans.append(real(*a)) or scans[-1])
    U.update_store(spark, pages(spark, ("WIN", day(3, 2), page("WIN", day(3, 2)))), folder)
    assert len(scans) == 1
    plan = scans[0]._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "root" in filters and "year" in filters and "WIN" in filters and "2023" in filters and "DOL" not in filters
    assert len(days_of(spark, folder)) == 7


def test_too_many_partitions_to_name(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/store"
    monkeypatch.setattr(U, "NAMED_PARTITIONS", 1)
    for d in (day(3, 1), day(3, 2)):
        U.update_store(spark, pages(spark, *some(d)), folder)
    assert days_of(spark, folder) == [(r, d) for r in ("DOL", "WIN") for d in (day(3, 1), day(3, 2))]


def test_days_that_the_registry_takes_and_gives_back(spark, tmp_path):
    folder = f"{tmp_path}/store"
    all_pages = pages(spark, *some(day(3, 1), day(3, 2)), ("BGI", day(3, 3), NOTICE))
    U.update_store(spark, all_pages, folder)
    assert spark.read.parquet(f"{folder}/no_data").count() == 1
    skip = spark.createDataFrame([("DOL_2023-03-01.html", "DOL", day(3, 1))], "filename string, root string, date date")
    skip.write.mode("append").parquet(f"{folder}/no_data")
    U.update_store(spark, all_pages, folder)
    assert days_of(spark, folder) == [("DOL", day(3, 2)), ("WIN", day(3, 1)), ("WIN", day(3, 2))]
    states = {(r.root, r.date.day): r.status for r in U.day_states(spark, folder).collect()}
    assert states == {("DOL", 1): "skipped", ("DOL", 2): "ok", ("WIN", 1): "ok", ("WIN", 2): "ok", ("BGI", 3): "no_data"}
    skip.limit(0).write.mode("overwrite").parquet(f"{folder}/no_data")  # all days free again
    U.update_store(spark, all_pages, folder)
    assert len(days_of(spark, folder)) == 4 and spark.read.parquet(f"{folder}/no_data").count() == 1


@pytest.mark.parametrize("step", ["write_bulletins", "delete_partitions", "write_parsed_days", "write_run"])
def test_a_batch_that_fails_is_taken_again(spark, tmp_path, monkeypatch, step):
    """Whatever table the fault comes before, the batch taken again gives the tables of one without a fault; once committed, it changes nothing."""
    folder = f"{tmp_path}/store"
    first = pages(spark, *some(day(3, 1)), ("BGI", day(3, 1), NOTICE))
    arrivals.load_batch(first, 0, folder, "feed")
    second = pages(spark, *some(day(3, 2)), ("BGI", day(3, 2), NOTICE))

    def fail(*_):
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr(store, step, fail)
        with pytest.raises(OSError):
            arrivals.load_batch(second, 1, folder, "feed")
    arrivals.load_batch(second, 1, folder, "feed")
    found = lambda: (days_of(spark, folder), sorted(map(tuple, spark.read.parquet(f"{folder}/no_data").collect())), sorted(r["root"] for r in store.collect_parsed_days(spark, f"{folder}/parsed").collect()))
    want = [(r, day(3, d)) for r in ("DOL", "WIN") for d in (1, 2)], [(f"BGI_2023-03-0{d}.html", "BGI", day(3, d)) for d in (1, 2)], ["DOL"] * 4 + ["WIN"] * 4
    assert found() == want
    files = sorted(files_below(tmp_path, "store"))
    arrivals.load_batch(pages(spark, *some(day(3, 5))), 1, folder, "feed")
    assert found() == want and sorted(files_below(tmp_path, "store")) == files


def test_a_failed_stream_goes_on(spark, tmp_path, monkeypatch):
    raw, folder, checkpoint = (f"{tmp_path}/{x}" for x in ("raw", "store", "checkpoint"))
    store.write_reports(pages(spark, *some(day(3, 1), day(3, 2))), raw)
    assert sorted((r.root, r.date.day) for r in store.read_reports(spark, raw).collect()) == [("DOL", 1), ("DOL", 2), ("WIN", 1), ("WIN", 2)]
    real, calls = store.write_parsed_days, []

    def fails_once(*a):
        calls.append(a)
        if len(calls) == 2:
            raise OSError("no space")
        real(*a)

    monkeypatch.setattr(store, "write_parsed_days", fails_once)
    with pytest.raises(Exception, match="no space"):
        arrivals.ingest_arrivals(spark, raw, folder, checkpoint, files_per_batch=2).awaitTermination()
    arrivals.ingest_arrivals(spark, raw, folder, checkpoint, files_per_batch=2).awaitTermination()
    assert len(days_of(spark, folder)) == 4 and len(calls) == 3
    assert spark.read.parquet(f"{folder}/commits").count() == 2


def test_compaction_keeps_rows_in_fewer_files(spark, tmp_path):
    folder = f"{tmp_path}/store"
    for d in range(1, 6):
        U.update_store(spark, pages(spark, *some(day(3, d))), folder)
    again = pages(spark, *some(day(3, 2), close="5.032,00"))
    U.update_store(spark, again, folder, refresh=again.select("root", "date"))
    rows = lambda: sorted((r.root, r.date, str(sorted(r.cells.items()))) for r in store.collect_parsed_days(spark, f"{folder}/parsed").collect())
    before, many = rows(), len(files_below(tmp_path, "store/parsed")) + len(files_below(tmp_path, "store/days"))
    U.compact_store(spark, folder)
    assert rows() == before and len(files_below(tmp_path, "store/parsed")) + len(files_below(tmp_path, "store/days")) < many
    assert [p.name[:12] for p in (tmp_path / "store/parsed").glob("run=*")] == ["run=compact-"]
    states = U.day_states(spark, folder)
    assert states.count() == 10 and store.stale_reports(again, states).count() == 0
    U.update_store(spark, again, folder)  # nothing is new
    assert rows() == before


def test_compaction_that_stops_before_it_deletes(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/store"
    for d in (1, 2):
        U.update_store(spark, pages(spark, *some(day(3, d))), folder)
    rows = lambda: sorted((r.root, r.date) for r in store.collect_parsed_days(spark, f"{folder}/parsed").collect())
    before = rows()
    with monkeypatch.context() as m:
        m.setattr(store, "delete_partitions", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            U.compact_store(spark, folder)
    assert rows() == before
    U.compact_store(spark, folder)
    assert rows() == before and len(list((tmp_path / "store/parsed").glob("run=*"))) == 1


def test_contracts_by_partitions(spark, tmp_path):
    folder = f"{tmp_path}/store"
    U.update_store(spark, pages(spark, *some(day(3, 1, 2021), day(3, 1, 2022), day(3, 1), roots=("DOL", "WIN", "1234"))), folder)
    got = R.get_stored_contracts(spark, folder, [" winn23", "1234N23"], start="2022-01-01")
    assert sorted((r.ticker, r.date.year) for r in got.collect()) == [("1234N23", 2022), ("1234N23", 2023), ("WINN23", 2022), ("WINN23", 2023)]
    filters = got._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "root" in filters and "WIN" in filters and "year" in filters and "2022" in filters
    many = spark.createDataFrame([("DOLQ23",), ("dolq23 ",), *((f"ZZ{i}",) for i in range(R.NAMED_TICKERS))], "ticker string")
    joined = R.get_stored_contracts(spark, folder, many, end="2021-12-31", treatment="raw", ordered=True)
    assert [(r.ticker, r.date) for r in joined.collect()] == [("DOLQ23", day(3, 1, 2021))]
    filters = joined._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "DOL" in filters and "WIN" not in filters
    assert R.get_stored_contracts(spark, folder, ["WINN23"], end="2020-01-01").count() == 0  # known, but not in this range
    assert R.get_stored_bulletins(spark, folder, ["win"], "2023-01-01", treatment="raw").count() == 2
    for bad in (lambda: R.get_stored_contracts(spark, folder, ["nothing"]), lambda: R.get_stored_contracts(spark, f"{tmp_path}/none", ["WINN23"]), lambda: R.get_stored_contracts(spark, folder, ["WINN23"], "2023-02-01", "2023-01-01")):
        with pytest.raises(ValueError):
            bad()


def test_columns_of_unknown_names(spark, tmp_path):
    folder = f"{tmp_path}/store"
    U.update_store(spark, pages(spark, *some(day(3, 1))), folder)
    U.update_store(spark, pages(spark, *some(day(4, 1), own=True)), folder)
    assert "extras" not in R.stored_bulletins(spark, folder).columns
    found = R.stored_bulletins(spark, folder, extras=True).where("size(extras) > 0").collect()
    assert {(r.ticker, r.date.month, str(r.extras)) for r in found} == {(t, 4, "{'margem_9': '12,5'}") for t in ("DOLN23", "WINN23")}
    assert U.promote_extras(spark, folder, least=0.5) == [] and U.promote_extras(spark, folder) == ["margem_9"] and U.promote_extras(spark, folder) == []
    read = lambda: {(r.root, r.date.isoformat(), r.margem_9) for r in R.stored_bulletins(spark, folder).where("ticker like '%N23'").collect()}
    want = {(r, d, m) for r in ("DOL", "WIN") for d, m in (("2023-03-01", None), ("2023-04-01", "12,5"))}
    assert read() == want
    U.update_store(spark, pages(spark, ("DOL", day(5, 1), page("DOL", day(5, 1), own=True))), folder)  # rewrites one root's year
    assert read() == want | {("DOL", "2023-05-01", "12,5")}
    assert "margem_9" in spark.read.parquet(f"{folder}/bulletins/root=DOL").columns and "margem_9" not in spark.read.parquet(f"{folder}/bulletins/root=WIN").columns
    assert R.stored_bulletins(spark, folder, extras=True).where(F.size("extras") > 0).count() == 0
