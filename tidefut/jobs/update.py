"""Incremental and full loads of bulletin tables from report pages.

A store is a folder of tables:

- ``bulletins``: the rows, by root and year; columns of pages that have no canonical name in the map ``extras``
- ``no_data``: the registry of days to skip; users may add rows to it and take rows out
- ``parsed``: a log of every page ever parsed, by run
- ``days``: a log of what became of each root and day (``ok``, ``error``, ``no_data``, ``skipped``), by run; one narrow row a day
- ``promoted``: names of extras that are columns of their own by now
- ``commits``: a row for each run that ended
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators.merge import merge_days, promote, without_days
from ..sources import store
from ..sources.reports import PARSER_VERSION, bulletin_rows, no_data_reports, parse_reports

EMPTY = "date date, root string, contract_code string, ticker string, " + ", ".join(f"{c} double" for c in N.NUMBERS)

#: The same as stored.
STORED = f"{EMPTY}, extras map<string,string>, year int"
REGISTRY = "filename string, root string, date date"
DAYS = "root string, date date, status string, parser_version int, parsed_at timestamp, run string"
#: Partitions that are named one by one in a scan's filter; more are chosen by a join.
NAMED_PARTITIONS = 2_000


@dataclass
class Update:
    """Bulletin rows after the update, and the registry rows found by it."""

    bulletins: DataFrame
    no_data: DataFrame


def pending_reports(reports: DataFrame, current: DataFrame, skip: DataFrame) -> DataFrame:
    """Reports whose day is neither in the table nor skipped."""
    return without_days(without_days(reports, current), skip)


def merged(current: DataFrame, parsed: DataFrame, skip: DataFrame, extras: bool = False) -> Update:
    found = no_data_reports(parsed)
    days = skip.select("root", "date").unionByName(found.select("root", "date"))
    return Update(merge_days(current, bulletin_rows(parsed, extras), days), found)


def update_roots(reports: DataFrame, current: DataFrame, skip: DataFrame, refresh: bool = False) -> Update:
    """All roots at once: pending reports (all of them with ``refresh``) are parsed, their days replaced, skipped days removed."""
    todo = without_days(reports, skip) if refresh else pending_reports(reports, current, skip)
    return merged(current, parse_reports(todo), skip)


def registry_of(spark: SparkSession, folder: str) -> DataFrame:
    """(root, date) to skip."""
    return store.read_table(spark, f"{folder}/no_data", REGISTRY).select("root", "date").distinct()


def day_states(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of each root and day."""
    return store.latest_days(store.read_table(spark, f"{folder}/days", DAYS))


def promoted_names(spark: SparkSession, folder: str) -> list[str]:
    return sorted(r["name"] for r in store.read_table(spark, f"{folder}/promoted", "name string").distinct().collect())


def committed(spark: SparkSession, folder: str, run: str) -> bool:
    return not store.read_table(spark, f"{folder}/commits", "at timestamp, run string").where(F.col("run") == run).isEmpty()


def partitions_filter(touched: DataFrame) -> Column | None:
    """A condition on root and year that names the partitions; None if they are too many."""
    pairs = touched.groupBy("root").agg(F.sort_array(F.collect_set("year")).alias("years"))
    rows = pairs.limit(NAMED_PARTITIONS + 1).collect()
    if sum(len(r["years"]) for r in rows) > NAMED_PARTITIONS:
        return None
    found = F.lit(False)
    for years in sorted({tuple(r["years"]) for r in rows}):  # roots with the same years share a term
        found = found | (F.col("root").isin([r["root"] for r in rows if tuple(r["years"]) == years]) & F.col("year").isin(list(years)))
    return found


def stored_rows(spark: SparkSession, folder: str, touched: DataFrame | None = None) -> DataFrame:
    """Bulletins of the store, extras as columns where they were promoted; with ``touched``, of these (root, year) partitions only."""
    names = promoted_names(spark, folder)
    options = {"mergeSchema": "true"} if names else {}
    rows = store.read_table(spark, f"{folder}/bulletins", STORED, **options)
    if touched is not None:
        named = partitions_filter(touched)
        rows = rows.join(touched, ["root", "year"], "left_semi") if named is None else rows.where(named)
    return promote(rows.drop("year"), names)


def update_store(spark: SparkSession, reports: DataFrame, folder: str, refresh: DataFrame | None = None, run: str | None = None) -> None:
    """Take new pages into the store below ``folder``.

    Pages of new days, of days that the registry has given free again, of another parser version, and those of the
    (root, date) rows in ``refresh`` are parsed once. Only the years that have such pages, or days that the registry has since the last run,
    are read and rewritten: first to a staging folder, as a plan can't overwrite what it reads, then as whole
    partitions. Years that are left without rows are deleted; a reader between the two steps sees their old rows.

    A run that ended is committed under its name; running it again changes nothing. One that failed may be run again under
    its name: everything that it wrote is replaced, and the tables become what they would have been.
    """
    run = run or uuid.uuid4().hex
    if committed(spark, folder, run):
        return
    skip, states = registry_of(spark, folder), day_states(spark, folder)
    away = F.col("status").isin("skipped", "no_data")
    done = states.where(~away)
    if refresh is not None:
        done = without_days(done, refresh)
    todo = without_days(store.stale_reports(reports, done), skip)
    _replace_days(spark, parse_reports(todo), skip, without_days(skip, states.where(away)), folder, run, whole=False)


def rebuild_store(spark: SparkSession, reports: DataFrame, folder: str) -> None:
    """The bulletins again from the pages given: roots and days that these don't have go, the registry stays."""
    skip = registry_of(spark, folder)
    _replace_days(spark, parse_reports(without_days(reports, skip)), skip, skip, folder, uuid.uuid4().hex, whole=True)


def _replace_days(spark: SparkSession, parsed: DataFrame, skip: DataFrame, new_skip: DataFrame, folder: str, run: str, whole: bool) -> None:
    """Parsed days take the place of the stored ones (with ``whole``, of all that is stored); skipped days and emptied years go."""
    stage = f"{folder}/staging/{uuid.uuid4().hex}"

    def staged(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{stage}/{name}")
        return spark.read.schema(df.schema).parquet(f"{stage}/{name}")

    parsed, new_skip = staged(parsed, "parsed"), staged(new_skip, "skipped")
    year = F.year("date").alias("year")
    # a page's own date may differ from its file's
    new = parsed.select("root", F.coalesce("report_date", "date").alias("date")).unionByName(parsed.select("root", "date")).unionByName(new_skip)
    if whole:
        new = new.unionByName(stored_rows(spark, folder).select("root", "date"))
    touched = staged(new.select("root", year).distinct(), "touched")
    old = stored_rows(spark, folder, touched)
    result = merged(old.limit(0) if whole else old, parsed, skip, extras=True)
    rows, found = staged(promote(result.bulletins, promoted_names(spark, folder)), "bulletins"), staged(result.no_data, "no_data")
    store.write_bulletins(rows, f"{folder}/bulletins")
    store.delete_partitions(spark, f"{folder}/bulletins", touched.join(rows.select("root", year), ["root", "year"], "left_anti"))
    store.write_parsed_days(parsed, f"{folder}/parsed", run)
    known = store.read_table(spark, f"{folder}/no_data", REGISTRY).select("filename")
    found.join(known, "filename", "left_anti").write.mode("append").parquet(f"{folder}/no_data")
    states = parsed.groupBy("root", "date").agg(F.max("status").alias("status"), F.max("parser_version").alias("parser_version"))
    gone = without_days(new_skip, parsed).select("root", "date", F.lit("skipped").alias("status"), F.lit(PARSER_VERSION).alias("parser_version"))
    store.write_run(states.unionByName(gone).withColumn("parsed_at", F.current_timestamp()), f"{folder}/days", run)
    store.write_run(spark.range(1).select(F.current_timestamp().alias("at")), f"{folder}/commits", run)
    store.delete_folder(spark, stage)


def compact_store(spark: SparkSession, folder: str) -> None:
    """The logs of parsed pages and of days become one run each, with each day's last state."""
    store.compact_runs(spark, f"{folder}/parsed", ["row_no"])
    store.compact_runs(spark, f"{folder}/days", [])


def promote_extras(spark: SparkSession, folder: str, least: float = 0.01) -> list[str]:
    """Extras that so large a share of all rows has become columns: from now on where rows are written, and wherever rows are read."""
    rows = store.read_table(spark, f"{folder}/bulletins", STORED)
    if "extras" not in rows.columns:
        return []
    total = rows.count()
    names = rows.select(F.explode(F.map_keys("extras")).alias("name")).groupBy("name").count().where(F.col("count") >= max(1, least * total))
    known = promoted_names(spark, folder)
    new = sorted(r["name"] for r in names.collect() if r["name"] not in {c.lower() for c in [*known, *rows.columns]})
    if new:
        spark.createDataFrame([(n,) for n in new], "name string").write.mode("append").parquet(f"{folder}/promoted")
    return new


def rebuild_roots(reports: DataFrame, skip: DataFrame) -> Update:
    """All pages from scratch."""
    spark = reports.sparkSession
    return merged(spark.createDataFrame([], EMPTY), parse_reports(without_days(reports, skip)), skip)
