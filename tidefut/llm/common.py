"""Helpers that the operators of this subpackage share.

Intermediate tables are written as Parquet under the folder that the cluster names in
``spark.checkpoint.dir``: every executor and the driver can read it, and a written table
cuts lineage, so a lost executor costs a re-read and no recomputation.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import new_path

MASK = (1 << 64) - 1


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (dots written as double underscores) for the time of a block."""
    named = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back; its shuffle files go when it is written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of the table is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: Tables up to so many bytes are sent to all tasks.
SENT_BYTES = 96_000_000


def sendable(rows: DataFrame) -> bool:
    """Whether a table is small enough to be broadcast, by the bytes of its values."""
    size = F.lit(16)
    for c in rows.columns:
        size = size + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8
    return (rows.agg(F.sum(size)).first()[0] or 0) <= SENT_BYTES


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, when nothing reads it any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(doc_id: str, m: int):
    """crc32 of the id as text, modulo ``m``: the folds of the learned operators."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % m


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser over an unsigned array."""
    x = (x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & MASK)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def carried(rows: DataFrame, read: list[str], carry: tuple[str, ...], compute: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` over the columns that ``compute`` reads; other columns go along unchanged.

    ``compute`` gives one batch, with as many rows, for each batch it gets.
    """
    n = len(read)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def tee():
            for batch in batches:
                held.append(batch)
                yield batch

        for out in compute(tee()):
            own = held.pop(0)
            yield pa.RecordBatch.from_arrays([*out.columns, *own.columns[n:]], names=[*out.schema.names, *carry])

    extra = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.select(*read, *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry))).mapInArrow(run, schema + extra)


_kept: list = []


def kept(key, make: Callable):
    """What a worker keeps from task to task: one thing, made anew when another is asked for, so that operators don't add up."""
    if not _kept or _kept[0] != key:
        forget()
        _kept.extend((key, make()))
    return _kept[1]


def forget() -> None:
    """Give up what another operator's tasks left in this worker, and give its memory back: workers live on through all of a job's stages."""
    if _kept:
        _kept.clear()
        gc.collect()  # an encoder and its chunks refer to each other
    try:
        ctypes.CDLL(None).malloc_trim(0)  # else freed memory stays with the process
    except (AttributeError, OSError, TypeError):  # another C library
        pass


class WordTable:
    """Distinct words of the rows seen so far, numbered, each with values computed once.

    ``compute(words)`` gives a tuple of arrays, one row per word. The table holds about
    ``limit`` words between batches; beyond that it starts anew, and words of more than
    ``LONGEST`` characters never stay. This bounds memory and changes no result.
    """

    LONGEST = 64

    def __init__(self, compute: Callable[[list], tuple[np.ndarray, ...]], limit: int = 600_000):
        self.compute, self.limit = compute, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict = {}
        self.values: tuple | None = None
        self.used = 0

    def ids(self, words: list) -> np.ndarray:
        """Row numbers of the words in ``values``."""
        if self.used > self.limit:
            self.clear()
        new = list(set(words).difference(self.index))
        if new or self.values is None:
            self._add(self.compute(new), len(new))
            start = self.used - len(new)
            self.index.update(zip(new, range(start, self.used), strict=True))
        out = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        for w in new:
            if len(w) > self.LONGEST:
                del self.index[w]
        return out

    def _add(self, found: tuple[np.ndarray, ...], n: int) -> None:
        """Rows after those there are; the arrays double when they are full."""
        if self.values is None:
            self.values = tuple(np.zeros((max(4096, 2 * n), *x.shape[1:]), x.dtype) for x in found)
        elif self.used + n > len(self.values[0]):
            grown = tuple(np.zeros((2 * (self.used + n), *x.shape[1:]), x.dtype) for x in found)
            for new, old in zip(grown, self.values, strict=True):
                new[: self.used] = old[: self.used]
            self.values = grown
        for x, part in zip(self.values, found, strict=True):
            x[self.used : self.used + n] = part
        self.used += n


def small_batches(texts: pa.Array, size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes each (at least one row)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        total += n
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def texts_of(column: pa.Array, a: int, b: int) -> list[str]:
    """Some rows of a column of texts; null counts as empty."""
    return [t or "" for t in column.slice(a, b - a).to_pylist()]


def key_groups(batches, keys: int) -> Iterator[pa.RecordBatch]:
    """Rows with equal values in the first ``keys`` columns, which come one after the other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((cols[1:] != cols[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(cols[a])
            if last is not None and key != last:
                yield pa.concat_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def whole_groups(batches, keys: int) -> Iterator[pa.RecordBatch]:
    """The rows again, such that no batch ends inside a group of equal values in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)], axis=1)
        cuts = np.flatnonzero((cols[1:] != cols[:-1]).any(axis=1)) + 1
        first = int(cuts[-1]) if len(cuts) else 0
        if held:
            last = tuple(held[-1].column(k)[-1].as_py() for k in range(keys))
            if not len(cuts) and last == tuple(cols[0].tolist()):
                held.append(batch)
                continue
        if held or first:
            yield pa.concat_batches([*held, batch.slice(0, first)])
        held = [batch.slice(first)]
    if held:
        yield pa.concat_batches(held)


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) of every node with a link: the smallest node reachable over ``a``-``b``.

    Rounds of large-star and small-star: each aggregates by node, with partial aggregation before
    the shuffle, and joins the minima back. No component is ever gathered in a list; a hub's
    links pass through one task of that join as a stream of two numbers each.
    """
    spark = edges.sparkSession
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        # large-star: every larger neighbour of a node is linked to the least of its neighbours and itself
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: a node and its smaller neighbours are linked to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)
        # a forest of stars: every left end occurs once, and no right end is a left end
        lefts = nxt.groupBy("a").count()
        unstable = nxt.join(nxt.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count() or lefts.where("count > 1").limit(1).count()
        drop_table(cur)
        cur = nxt
        if not unstable:
            break
    centres = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)
