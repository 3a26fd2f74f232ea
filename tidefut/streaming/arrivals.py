"""Ingest of report files as they arrive."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..jobs.update import update_store
from ..sources.store import REPORT_FILES, named


def load_batch(batch: DataFrame, number: int, folder: str, source: str) -> None:
    """Takes one batch of files into the store, under the name of its source and its number: a repeated batch changes nothing."""
    pages = named(batch, F.col("path")).select("path", "root", "date", "content")
    update_store(batch.sparkSession, pages, folder, run=f"{source}-{number}")


def ingest_arrivals(spark: SparkSession, reports: str, folder: str, checkpoint: str, files_per_batch: int = 100_000) -> StreamingQuery:
    """Takes all files that are there and not taken yet, then ends; each batch updates the store once.

    A batch that failed, wherever it stopped, is taken again by the next call with the same checkpoint.
    """
    kind = "path string, modificationTime timestamp, length long, content binary"
    files = (
        spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", REPORT_FILES).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).load(reports)
    )
    source = f"arrivals-{sha256(checkpoint.encode()).hexdigest()[:16]}"
    return files.writeStream.foreachBatch(lambda batch, number: load_batch(batch, number, folder, source)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
