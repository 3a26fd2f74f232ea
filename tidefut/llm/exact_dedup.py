"""Exact deduplication with streaming state.

A batch pass writes each row's digest, stable identifier and content locator (file, row
number and byte length) to the shared folder. A Structured Streaming query reads that table
and keeps one state entry for each digest in RocksDB, on disk and without expiry: the
largest identifier with its locator, and how many rows there were. Partial aggregation
before the shuffle keeps a digest with very many rows small. On hits, the full texts are
compared: within a digest class the least and the greatest text must be the same bytes; a
class where they differ is grouped again by the text itself.

With a ``state`` folder the state outlives the call: rows of a later call meet those of all earlier ones
there, and only the new rows are read by the stream. The texts of earlier rows, for the comparison on
hits, come from ``earlier``; without it a hit across calls rests on digest and byte length.

Null texts count as empty. Equal means identical after lower-casing A-Z only. Of equal texts
the row with the largest identifier stays; a null identifier is smaller than any other, and
of rows that repeat identifier and text one stays. Very long texts are taken whole. An empty table gives an
empty result. Columns other than doc_id and text go along unread, whatever their names.

The rows of one very common text meet their group in a join whose both sides Spark may split (adaptive skew
join); all other steps sum before they shuffle.
"""

from __future__ import annotations

import string
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import new_path
from .common import fresh, materialize, sendable

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

def normalised(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    t = F.coalesce(text, F.lit(""))
    plain = F.octet_length(t) == F.char_length(t)
    return F.when(plain, F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keyed_state(staged: DataFrame, path: str, folder: str) -> DataFrame:
    """One row for each digest, from the streaming query's state in ``folder``: keep (struct) and group_size."""
    own = staged.sparkSession.newSession()  # settings of its own; what the session of the caller has set holds too
    for k, v in (STATE | {"spark.sql.shuffle.partitions": staged.sparkSession.conf.get("spark.sql.shuffle.partitions")}).items():
        own.conf.set(k, v)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/groups/batch={number}")

    stream = own.readStream.schema(staged.schema).parquet(path)
    keep = F.max(F.struct("doc_id", "row_no", "file", "n_bytes", "arrival")).alias("keep")
    groups = stream.groupBy("digest").agg(keep, F.count("*").alias("group_size"), F.min("n_bytes").alias("least"), F.max("n_bytes").alias("most"))
    query = groups.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = staged.sparkSession
    try:
        found = spark.read.schema(groups.schema).parquet(f"{folder}/groups")
    except AnalysisException as error:  # no row has come yet
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], groups.schema)
    # each batch tells the new state of the digests it met
    return found.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("group_size").alias("group_size"), F.min("least").alias("least"), F.max("most").alias("most"))


def only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of docs with (or, left_anti, without) these identifiers; a broadcast only up to a checked size."""
    (name,) = fresh(docs, "id_wanted")
    ids = ids.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(F.broadcast(ids) if sendable(ids) else ids, docs["doc_id"].eqNullSafe(F.col(name)), how)


def exact_dedup(docs: DataFrame, digest=sha256, state: str | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, keep_file, n_bytes for every row."""
    spark = docs.sparkSession
    norm = normalised(F.col("text"))
    folder = state or new_path(spark, "dedup-state")
    arrival = uuid.uuid4().hex
    rows = docs.select("doc_id", norm.alias("t"))
    rows = rows.select("doc_id", digest(F.col("t")).alias("digest"), sha256(F.col("t")).alias("sha"), F.monotonically_increasing_id().alias("row_no"), F.octet_length("t").cast("long").alias("n_bytes"), F.input_file_name().alias("file"), F.lit(arrival).alias("arrival"))
    rows.write.mode("append").parquet(f"{folder}/rows")
    staged = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    groups = keyed_state(staged, f"{folder}/rows", folder)
    staged = staged.where(F.col("arrival") == arrival)
    hits = groups.where("group_size > 1").select("digest")
    texts = docs.select("doc_id", "text") if earlier is None else docs.select("doc_id", "text").unionByName(earlier.select("doc_id", "text"))
    everyone = staged if earlier is None else spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    again = everyone.join(hits, "digest").select("doc_id")
    texts = only(texts, again).select(norm.alias("t")).select(digest(F.col("t")).alias("digest"), "t")
    differing = texts.groupBy("digest").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").select("digest")
    differing = materialize(differing.union(groups.where("least <> most").select("digest")).distinct(), "dedup-differing")
    flat = lambda g: g.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row_no").alias("keep_row"), F.col("keep.arrival").alias("keep_arrival"), F.col("keep.file").alias("keep_file"), "group_size")
    kept = ((F.col("row_no") == F.col("keep_row")) & (F.col("arrival") == F.col("keep_arrival"))).alias("kept")
    columns = ["doc_id", "keep_id", "group_size", kept, F.col("sha").alias("text_sha256"), "keep_file", "n_bytes"]
    if differing.isEmpty():
        return staged.join(flat(groups), "digest").select(columns)
    # classes of one digest with several texts: by the texts' SHA-256, of all rows ever seen
    same = only(docs.select("doc_id", "text"), again).select(norm.alias("t")).groupBy(sha256(F.col("t"))).agg(F.min("t").alias("low"), F.max("t").alias("high"))
    if not same.where("low <> high").isEmpty():
        raise ValueError("two texts share a SHA-256")
    mixed = spark.read.schema(rows.schema).parquet(f"{folder}/rows").join(differing, "digest", "left_semi")
    by_text = mixed.groupBy("sha").agg(F.max(F.struct("doc_id", "row_no", "file", "n_bytes", "arrival")).alias("keep"), F.count("*").alias("group_size")).withColumnRenamed("sha", "digest")
    split = mixed.where(F.col("arrival") == arrival).drop("digest").join(flat(by_text), F.col("sha") == F.col("digest")).select(columns)
    rest = staged.join(differing, "digest", "left_anti").join(flat(groups), "digest").select(columns)
    return rest.unionByName(split)


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their own columns."""
    found = materialize(exact_dedup(docs), "dedup-found")
    gone = found.where("not kept").select("doc_id")
    repeated = found.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        out = only(docs, gone, "left_anti")
    else:  # one identifier on several rows: the text decides as well
        key, sha, own = fresh(docs, "id_kept", "sha_kept", "sha_own")
        kept = found.where("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha)).distinct()
        rows = docs.withColumn(own, sha256(normalised(F.col("text"))))
        out = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(sha))).dropDuplicates([key, sha]).drop(key, sha, own)
    return out


__all__ = ["exact_dedup", "keep_documents", "only"]
