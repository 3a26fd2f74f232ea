"""Reports, registry and bulletin tables on storage."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import scalars as S
from ..operators.merge import promote, without_days
from .reports import PARSER_VERSION

REPORT_NAME = r"([A-Za-z0-9]+)_(\d{4}-\d{2}-\d{2})\.html"


def named(df: DataFrame, name: Column) -> DataFrame:
    """Adds root and date by the page's name: that of the file, or of the folder that ``write_reports`` made for it; names of another form go."""
    form = rf"(?:^|[/=]){REPORT_NAME}(?:/part-[^/]*)?$"
    out = df.withColumns({"root": F.upper(F.regexp_extract(name, form, 1)), "date": S.parse_date(F.regexp_extract(name, form, 2))})
    return out.where("root <> '' and date is not null")


#: Report pages by their own names, or as ``write_reports`` has them.
REPORT_FILES = "{*.html,part-*}"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """path, root, date, content of every report below the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", REPORT_FILES).option("recursiveFileLookup", "true").load(path)
    return named(files, F.col("path")).select("path", "root", "date", "content")


def write_reports(pages: DataFrame, path: str) -> None:
    """Each page in a folder by its name (``page=ROOT_yyyy-mm-dd.html``), its bytes followed by a line feed."""
    name = F.concat("root", F.lit("_"), F.col("date").cast("string"), F.lit(".html")).alias("page")
    pages.select(F.coalesce("content", F.lit(b"")).cast("string").alias("value"), name).write.mode("append").option("compression", "none").partitionBy("page").text(path)


def read_no_data_registry(spark: SparkSession, *paths: str, root: str | None = None) -> DataFrame:
    """(filename, root, date) of the registries together; blanks and names of another form go."""
    rows = spark.read.schema("filename string").option("comment", "#").option("header", True).csv(list(paths))
    name = F.btrim("filename", F.lit(" \t\r\n"))
    out = named(rows.select(name.alias("filename")).dropDuplicates(["filename"]), F.col("filename"))
    return out.where(F.col("root") == root.strip().upper()) if root else out


def write_no_data_registry(existing: DataFrame | None, new: DataFrame, path: str) -> None:
    """The registry with the unseen file names of ``new``, at a new path."""
    rows = new.select("filename") if existing is None else existing.select("filename").unionByName(new.select("filename"))
    rows.dropDuplicates(["filename"]).write.option("header", True).option("quoteAll", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """A Parquet table, its partition columns of text as text; where nothing is written yet, an empty one of the schema given."""
    try:
        found = spark.read.options(**options).parquet(path).schema
    except AnalysisException as error:
        if schema is None or error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    texts = {"root", "run", "series"}  # Spark would take the names of some for numbers
    kind = StructType([StructField(f.name, StringType() if f.name in texts else f.dataType) for f in found])
    return spark.read.schema(kind).options(**options).parquet(path)


def write_bulletins(df: DataFrame, path: str) -> None:
    """Replaces the (root, year) partitions that ``df`` has and leaves the others."""
    rows = df.withColumn("year", F.year("date")).repartition("root", "year").sortWithinPartitions("root", "year", "date", "ticker")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("root", "year").parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def delete_partitions(spark: SparkSession, path: str, gone: DataFrame) -> None:
    """Deletes partition folders: one for each row of ``gone``, named by its columns in order."""
    parts = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in gone.columns]
    for row in gone.select(F.concat_ws("/", *parts).alias("part")).distinct().toLocalIterator():
        delete_folder(spark, f"{path}/{row['part']}")


def years_between(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows of the years that a date range touches, by the partition column alone."""
    if start:
        df = df.where(F.col("year") >= int(start[:4]))
    return df.where(F.col("year") <= int(end[:4])) if end else df


def read_bulletins(spark: SparkSession, path: str, roots: list[str] | None = None, start: str | None = None, end: str | None = None, promoted: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """Stored rows (none, of the schema given, where nothing is written yet); roots and years of a date range choose the partitions that are read.

    Extra columns named in ``promoted`` come as columns of their own, from files that have them as such and from those
    that have them in ``extras``.
    """
    rows = read_table(spark, path, schema, **({"mergeSchema": "true"} if promoted else {}))
    if roots is not None:
        rows = rows.where(F.col("root").isin(roots))
    rows = years_between(rows, start, end).drop("year")
    return promote(rows, promoted) if promoted else rows


def write_run(rows: DataFrame, path: str, run: str) -> None:
    """What one run adds to a log; written again under the same name, it takes the place of what was there."""
    rows.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def write_parsed_days(parsed: DataFrame, path: str, run: str | None = None) -> None:
    """Adds the pages of ``parsed`` to the log, under the run's name; of a day parsed more than once, the last time counts. Few files, however many days."""
    rows = parsed.drop("run").withColumn("parsed_at", F.current_timestamp())
    write_run(rows.repartition("root").sortWithinPartitions("root", "date", "row_no"), path, run or uuid.uuid4().hex)


def latest_days(rows: DataFrame) -> DataFrame:
    """Of each root and day, the rows of the last time it was parsed."""
    last = rows.groupBy("root", "date").agg(F.max(F.struct("parsed_at", "run")).alias("last")).select("root", "date", "last.*")
    return rows.join(last, ["root", "date", "parsed_at", "run"], "left_semi")


def collect_parsed_days(spark: SparkSession, path: str, skip: DataFrame | None = None) -> DataFrame:
    """Parsed rows with data, without skipped days."""
    rows = latest_days(read_table(spark, path)).where("status = 'ok'")
    return without_days(rows, skip) if skip is not None else rows


def compact_runs(spark: SparkSession, path: str, order: list[str]) -> None:
    """A log's latest days in one run, in files by ranges of root and day; the runs that it replaces are deleted.

    A reader between the two steps finds the same rows twice and takes them once. Runs that are added
    meanwhile stay as they are.
    """
    rows = read_table(spark, path)
    old = [r["run"] for r in rows.select("run").distinct().toLocalIterator()]
    if len(old) < 2:
        return
    latest = latest_days(rows.where(F.col("run").isin(old))).drop("run")
    write_run(latest.repartitionByRange("root", "date").sortWithinPartitions("root", "date", *order), path, f"compact-{uuid.uuid4().hex}")
    delete_partitions(spark, path, spark.createDataFrame([(r,) for r in old], "run string"))


def stale_reports(reports: DataFrame, parsed: DataFrame, version: int = PARSER_VERSION) -> DataFrame:
    """Reports never parsed, or parsed by another version."""
    return without_days(reports, parsed.where(F.col("parser_version") == version))
