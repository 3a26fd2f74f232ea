"""Shards of bounded size by extendible hashing.

The directory is indexed by the leading bits of a hash of the key. It starts with one
bucket; only a bucket over the byte limit splits on the next bit, so a row's shard is the
shortest prefix of its hash whose bucket fits. Buckets are summed once by a fine prefix
(partial aggregation, then one small shuffle), and all coarser depths are sums of those
sums; rows of prefixes that are still too large are summed again by more bits.

A bucket whose rows all have one hash (one large row, or rows that repeat a key) can't split
further: it is a shard of its own, marked ``oversize``. Null keys hash like empty text, null
texts weigh nothing, very long ones their bytes; repeated rows weigh as often as they occur, and rows of one key
share a shard. An empty table gives an empty result. Columns other than key and text are ignored,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BITS = 60
LIMIT_BYTES = 1 << 20
#: Directories up to so many entries of 40 bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_ENTRIES = 1 << 18


def hash60(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _leaves(sums: DataFrame, bits: int, least: int, limit: int) -> DataFrame:
    """For each fine prefix: the depth of its shard (null: still too large), and that shard's bytes."""
    depths = sums.withColumn("depth", F.explode(F.sequence(F.lit(least), F.lit(bits)))).withColumn("shard", F.expr(f"shiftright(prefix, cast({bits} - depth as int))"))
    totals = depths.groupBy("depth", "shard").agg(F.sum("bytes").alias("shard_bytes"), (F.min("low") == F.max("high")).alias("one"))
    totals = totals.where((F.col("shard_bytes") <= limit) | F.col("one"))
    found = depths.join(totals, ["depth", "shard"]).groupBy("prefix").agg(F.min(F.struct("depth", "shard", "shard_bytes")).alias("leaf"))
    return sums.select("prefix").join(found, "prefix", "left").select("prefix", "leaf.*")


def extendible_shards(docs: DataFrame, limit_bytes: int = LIMIT_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, shard_depth, shard (the prefix as a number), shard_bytes, oversize for every row."""
    rows = docs.select(F.col(key), hash60(F.col(key)).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    rows = materialize(rows, "shard-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits, done = min(20, max(4, math.ceil(math.log2(max(1, total / limit_bytes))) + 3)), 0
    left, parts = rows, []
    while True:
        at = F.expr(f"shiftright(h, {BITS - bits})")
        sums = left.groupBy(at.alias("prefix")).agg(F.sum("n_bytes").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high"))
        leaves = materialize(_leaves(sums, bits, done, limit_bytes), "shard-directory")
        entries = leaves.count()
        directory = F.broadcast(leaves) if entries <= BROADCAST_ENTRIES else leaves
        found = left.withColumn("prefix", at).join(directory, "prefix")
        parts.append(found.where("depth is not null"))
        if bits == BITS or not leaves.where("depth is null").limit(1).count():
            break
        left = found.where("depth is null").select(key, "h", "n_bytes")
        done, bits = bits + 1, min(BITS, bits + 8)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(key, "n_bytes", F.col("depth").cast("int").alias("shard_depth"), "shard", "shard_bytes", (F.col("shard_bytes") > limit_bytes).alias("oversize"))


def directory(shards: DataFrame) -> DataFrame:
    """One row for each shard: shard_depth, shard, shard_bytes, n_rows, and, of the whole directory, global_depth and how many of its entries lead here."""
    own = shards.groupBy("shard_depth", "shard", "shard_bytes").agg(F.count("*").alias("n_rows"))
    deepest = shards.agg(F.max("shard_depth").alias("global_depth"))  # one row
    return own.crossJoin(F.broadcast(deepest)).withColumn("entries", F.pow(F.lit(2.0), F.col("global_depth") - F.col("shard_depth")).cast("long"))


ORACLE = f"""
WITH r AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
d AS (SELECT r.*, t.depth, h >> CAST({BITS} - t.depth AS INT) AS shard FROM r, (SELECT unnest(range(0, {BITS + 1})) AS depth) t),
s AS (SELECT depth, shard, sum(n_bytes) AS shard_bytes, min(h) = max(h) AS one FROM d GROUP BY depth, shard),
f AS (SELECT doc_id, n_bytes, d.depth, d.shard, s.shard_bytes,
             row_number() OVER (PARTITION BY doc_id ORDER BY d.depth) AS k
      FROM d JOIN s ON d.depth = s.depth AND d.shard = s.shard WHERE s.shard_bytes <= {LIMIT_BYTES} OR s.one)
SELECT doc_id, n_bytes, CAST(depth AS INT) AS shard_depth, shard, CAST(shard_bytes AS BIGINT) AS shard_bytes,
       shard_bytes > {LIMIT_BYTES} AS oversize FROM f WHERE k = 1
"""
