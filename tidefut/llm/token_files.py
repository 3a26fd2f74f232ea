"""Token ids in binary files, documents' boundaries in Elias-Fano code.

Documents are dealt by ranges of their identifiers and sorted, so the files together hold one array of
ids in ascending order of documents; each task encodes its rows as they come and closes a file
before it would pass ``file_ids`` ids, so no task holds more than one file, or one document. How many ids and
documents stand before a file follows from the counts of all files (a narrow table), and goes into its head:
a file can be read by itself.

A file: ``MAGIC``, ids before it and documents before it (8 bytes each, big-endian), then little-endian the
number of documents without identifier, the bytes of an id (2 or 4) and the number of ids, the other documents'
identifiers and all documents' boundaries (one more than documents) in the code of ``elias_fano``, the ids, and
a line feed. Spark's own writer puts each file in place, so any file system that Spark knows will do.

Null texts count as empty and hold the end mark only; very long texts are one document, in a file of their own
size. Documents without identifier come first; those that repeat one follow each other in the order
of a hash of their texts. An empty table gives no file and no row. Other columns are ignored, whatever their names.
Identifiers are whole numbers.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.folders import new_path
from .common import drop_table, materialize, sendable, small_batches, texts_of
from .elias_fano import EliasFano, encode
from .packing import encoder_of

MAGIC = b"TIDEIDS1"
HEAD = struct.Struct("<QBQ")  # documents without identifier, bytes of an id, ids
BEFORE = struct.Struct(">QQ")  # ids and documents before the file
#: Ids in a file, unless one document has more.
FILE_IDS = 4_000_000
#: The id after each document.
END_ID = 2
#: Ids that a reader hands on at once, unless one document has more.
READ_IDS = 500_000


def body(doc_ids: list, ids: list[bytes], width: int) -> tuple[int, int, bytes]:
    """Numbers of documents and of ids, and all of a file but its first bytes and its last; ``ids`` have four bytes each."""
    none = sum(i is None for i in doc_ids)
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
    array = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}")
    return len(ids), int(ends[-1]), HEAD.pack(none, width, int(ends[-1])) + encode(np.array(doc_ids[none:], np.int64)) + encode(ends) + array.tobytes()


class TokenFile:
    """A file's documents."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("no file of token ids")
        self.ids_before, self.docs_before = BEFORE.unpack_from(data, len(MAGIC))
        at = len(MAGIC) + BEFORE.size
        self.none, self.width, n_ids = HEAD.unpack_from(data, at)
        self.doc_ids = EliasFano(data, at + HEAD.size)
        self.bounds = EliasFano(data, at + HEAD.size + self.doc_ids.size)
        self.ids = np.frombuffer(data, f"<u{self.width}", n_ids, at + HEAD.size + self.doc_ids.size + self.bounds.size)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def document(self, i: int) -> np.ndarray:
        """The ids of the file's document ``i``."""
        start, end = self.bounds.select([i, i + 1]).tolist()
        return self.ids[start:end]

    def named(self, a: int, b: int) -> list:
        """Identifiers of the documents from ``a`` to ``b``."""
        none = max(0, min(b, self.none) - a)
        return [None] * none + self.doc_ids.select(np.arange(a + none - self.none, b - self.none)).tolist()


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """The files of all documents, in a new folder."""
    kind = docs.schema["doc_id"].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise ValueError("identifiers must be whole numbers")
    # rows that repeat an identifier, even with its text, may go to several tasks
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), (F.monotonically_increasing_id() % 64).alias("salt"))
    order = ["doc_id", "tie", "salt"]
    end = np.array([end_id], "<u4").tobytes()
    names = ["part", "chunk", "n_docs", "n_ids", "body"]

    def filed(batches):
        encoder = encoder_of(tokenizer_path)
        width = 2 if max(len(encoder.id_bytes) - 1, end_id) < 1 << 16 else 4
        part, chunk, doc_ids, held, total = TaskContext.get().partitionId(), 0, [], [], 0

        def closed() -> pa.RecordBatch:
            n_docs, n_ids, data = body(doc_ids, held, width)
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (part, chunk, n_docs, n_ids)), pa.array([data], pa.binary())], names=names)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b in small_batches(batch.column(1)):
                for key, ids in zip(keys[a:b], encoder.encode(texts_of(batch.column(1), a, b)), strict=True):
                    if held and total + len(ids) // 4 + 1 > file_ids:
                        yield closed()
                        chunk, doc_ids, held, total = chunk + 1, [], [], 0
                    doc_ids.append(key)
                    held.append(ids + end)
                    total += len(ids) // 4 + 1
        if held:
            yield closed()

    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    bodies = materialize(sorted_rows.mapInArrow(filed, "part long, chunk long, n_docs long, n_ids long, body binary"), "token-bodies")
    # sums over tasks (a row for each), then over a task's files
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = bodies.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("n_ids").alias("i"))
    tasks = tasks.select("part", *(before(c, Window.orderBy("part")).alias(f"{c}_part") for c in "di"))
    own = Window.partitionBy("part").orderBy("chunk")
    files = bodies.select("part", "chunk", before("n_docs", own).alias("d"), before("n_ids", own).alias("i")).join(F.broadcast(tasks), "part")
    files = files.select("part", "chunk", (F.col("i") + F.col("i_part")).alias("ids_before"), (F.col("d") + F.col("d_part")).alias("docs_before"))
    long = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    data = F.concat(F.lit(MAGIC), long(F.col("ids_before")), long(F.col("docs_before")), "body")
    whole = bodies.join(F.broadcast(files) if sendable(files) else files, ["part", "chunk"]).select(data.cast("string").alias("value"))
    whole.write.option("maxRecordsPerFile", 1).option("compression", "none").option("lineSep", "\n").text(path)
    drop_table(bodies)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, number (documents before it), start (ids before it), n_tokens and ids (four bytes each, little-endian) of each document."""
    names = ["doc_id", "number", "start", "n_tokens", "ids"]

    def read(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                file = TokenFile(batch.column(0)[k].as_buffer())
                bounds = file.bounds.select(np.arange(len(file) + 1))
                a = 0
                while a < len(file):
                    b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + READ_IDS, "right")) - 1)
                    ids = file.ids[bounds[a] : bounds[b]].astype("<u4")
                    offsets = pa.py_buffer(((bounds[a : b + 1] - bounds[a]) * 4).astype("<i4").tobytes())
                    data = pa.Array.from_buffers(pa.binary(), b - a, [None, offsets, pa.py_buffer(ids.tobytes())])
                    numbers = file.docs_before + np.arange(a, b), file.ids_before + bounds[a:b], np.diff(bounds[a : b + 1])
                    yield pa.RecordBatch.from_arrays([pa.array(file.named(a, b), pa.int64()), *(pa.array(x, pa.int64()) for x in numbers), data], names=names)
                    a = b

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(read, "doc_id long, number long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """The documents written to a new folder and read back; the files stay in the shared folder while the result is in use."""
    path = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_path, **options)
    return read_token_files(docs.sparkSession, path)
