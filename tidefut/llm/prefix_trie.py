"""Prefix trie of conversations, from adaptive radix trees.

A turn's id is the first 16 bytes of a digest of its role and text, read big-endian; a conversation's key is
its turns' ids one after the other. Spark sorts the keys over ranges. A task reads its range as a stream and
builds a radix tree (``radix_tree``) of one bounded block of keys after another; only depths that are whole
numbers of turns are nodes of the trie.

A node all of whose members lie in one block is finished there. A node that may go on in the next block is open:
one on the path of a block's first or last key, as deep as the neighbouring key shares it (all of the path
where the neighbour lies in another task). Open nodes are few, a path for each block. Their parts are summed by
the digest of their path; sums over subtrees of open nodes take rounds of doubling: each round adds what the
descendants that a node's pointers reach have summed, and doubles the distance of the pointers.
Members that end at an open node go as written lists, one of each block, to one stream in order, where
they are hashed.

Turns are in order of their number, null first; turns of one number in order of their ids. Null roles and texts
are empty. Rows without a conv_id are left out; rows that repeat all of a turn are turns each. An empty table
has no node. A conversation's ids and lengths (20 bytes a turn) must fit into one row, its texts need not.
Columns other than conv_id, turn, role and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, sendable
from .radix_tree import RadixTree, shared

#: Bytes of a turn's id.
WIDTH = 16
#: A block's different keys, members and bytes of keys, unless one key has more.
LIMITS = (20_000, 100_000, 16_000_000)

COUNTS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
SCHEMA = ", ".join(f"{c} long" for c in COUNTS) + ", ends_sha256 string, own binary, above binary, size long, ends string, first_end long"
KINDS = [*[pa.int64()] * len(COUNTS), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order: id (hexadecimal) and code points of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)  # tells where the role ends
    turn = F.struct(F.col("turn"), F.left(F.sha2(whole.cast("binary"), 256), F.lit(2 * WIDTH)).alias("id"), F.char_length(text).alias("n"))
    rows = conversations.where("conv_id is not null").select("conv_id", turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_openings(seqs: DataFrame, block: int = 100, openings: int = 6) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % block in place of its own first h; h is crc32(c) % openings."""
    base = F.col("conv_id") - F.col("conv_id") % block
    first = seqs.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, openings).alias("opening"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % openings).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    opening = F.when(F.col("opening").isNotNull(), F.slice("opening", F.lit(1), h)).otherwise(F.slice("turns", 1, 0))
    return seqs.join(first, base == F.col("base"), "left").select("conv_id", F.concat(opening, own).alias("turns"))


class Block:
    """Different keys in order with their members, and how deep (in turns) the neighbouring blocks may share the first and the last key."""

    def __init__(self, before: int | None):
        self.before, self.after = before, None  # None: unknown, so all of it
        self.keys: list[bytes] = []
        self.sizes: list[list[int]] = []
        self.ids: list[list[int]] = []
        self.members = self.bytes = 0

    def full(self, limits: tuple[int, int, int]) -> bool:
        return any(have >= most for have, most in zip((len(self.keys), self.members, self.bytes), limits, strict=True))

    def add(self, key: bytes, sizes, conv_id: int) -> None:
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
            self.sizes.append(sizes.tolist())
            self.ids.append([])
            self.bytes += len(key)
        self.ids[-1].append(conv_id)
        self.members += 1

    def paths(self) -> list[list[bytes]]:
        """Digests of the first key's beginnings and of the last key's, by depth, as far as they may be shared."""
        out = []
        for key, depth in ((self.keys[0], self.before), (self.keys[-1], self.after)):
            digest, found = hashlib.blake2b(digest_size=16), []
            most = len(key) // WIDTH if depth is None else depth
            for d in range(most + 1):
                digest.update(key[WIDTH * (d - 1) : WIDTH * d] if d else b"")
                found.append(digest.copy().digest())
            out.append(found)
        return out

    def rows(self) -> list[tuple]:
        """The block's nodes, in the columns of ``SCHEMA``."""
        tree = RadixTree()
        for i, key in enumerate(self.keys):
            tree.insert(key, i)
        nodes = list(tree.walk())
        first, last = self.paths()
        out: list[list] = []
        # of what lies below each node of the tree: members, least member, first and last key, topmost rows, leaves, tokens saved
        below = [[0, None, None, None, [], 0, 0] for _ in nodes]
        for at in range(len(nodes) - 1, -1, -1):
            node, above, start, end = nodes[at]
            got = below[at]
            i = node.value
            if i is not None:
                got[0] += len(self.ids[i])
                got[1] = self.ids[i][0] if got[1] is None else min(got[1], self.ids[i][0])
                got[2] = i if got[2] is None else min(got[2], i)
                got[3] = i if got[3] is None else max(got[3], i)
            n, least, lo, hi, waiting, leaves, saved = got
            if lo is None:  # the root of an empty tree
                continue
            sizes = self.sizes[lo]
            top = start // WIDTH + 1 if at else 0
            for depth in range(end // WIDTH, top - 1, -1):
                ending = self.ids[i] if i is not None and depth * WIDTH == end else None
                size = sizes[depth - 1] if depth else 0
                digests = first if lo == 0 and depth < len(first) else last if hi == len(self.keys) - 1 and depth < len(last) else None
                if digests is None:
                    leaves, saved = leaves if waiting else 1, saved + (n - 1) * size
                    ends = hashlib.sha256(",".join(map(str, ending)).encode()).hexdigest() if ending else NO_ENDS
                    for k in waiting:
                        out[k][2] = least
                    out.append([least, depth, None, n, len(waiting), leaves, saved, ends, None, None, None, None, None])
                    waiting = [len(out) - 1]
                else:
                    for k in waiting:
                        out[k][9] = digests[depth]
                    ends = ",".join(map(str, ending)) if ending else None
                    out.append([least, depth, None, n, len(waiting), leaves, saved, None, digests[depth], digests[depth - 1] if depth else None, size, ends, ending[0] if ending else None])
                    waiting, leaves, saved = [], 0, 0
            if above >= 0:
                to = below[above]
                to[0] += n
                to[1] = least if to[1] is None else min(to[1], least)
                to[2] = lo if to[2] is None else min(to[2], lo)
                to[3] = hi if to[3] is None else max(to[3], hi)
                to[4] += waiting
                to[5] += leaves
                to[6] += saved
            below[at] = None
        return out


def block_nodes(batches, limits: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """Nodes of the sorted keys of one task."""
    block = Block(None)

    def rows(done: Block) -> Iterator[pa.RecordBatch]:
        found = done.rows()
        for a in range(0, len(found), 50_000):
            cols = zip(*found[a : a + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, KINDS, strict=True)], names=NAMES)

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(1)
        offsets, flat = sizes.offsets.to_numpy().tolist(), sizes.values.to_numpy(zero_copy_only=False)
        for k, (key, conv_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if block.full(limits):
                block.after = shared(block.keys[-1], key) // WIDTH
                yield from rows(block)
                block = Block(block.after)
            block.add(key, flat[offsets[k] : offsets[k + 1]], conv_id)
    if block.keys:
        yield from rows(block)


def hashed(ends: DataFrame) -> DataFrame:
    """own and the digest of its lists, one after the other."""

    def streamed(batches):
        own = digest = None
        for batch in batches:
            done: list[tuple] = []
            for key, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key == own:
                    digest.update(b"," + part.encode())
                    continue
                if own is not None:
                    done.append((own, digest.hexdigest()))
                own, digest = key, hashlib.sha256(part.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])], names=["own", "ends_sha256"])
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.binary()), pa.array([digest.hexdigest()])], names=["own", "ends_sha256"])

    dealt = ends.select("own", "first_end", "ends").repartition("own").sortWithinPartitions("own", "first_end")
    return dealt.mapInArrow(streamed, "own binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """own, and the sums of ``leaves`` and ``saved`` over each node's subtree; ``above`` is its parent."""
    cur = materialize(nodes.select("own", F.col("above").alias("far"), "leaves", "saved"), "trie-sums")
    while cur.where("far is not null").limit(1).count():
        more = cur.where("far is not null").groupBy(F.col("far").alias("own")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        on = cur.select(F.col("own").alias("far"), F.col("far").alias("farther"))
        on = F.broadcast(on) if sendable(on) else on
        summed = cur.join(more, "own", "left").join(on, "far", "left")
        add = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
        after = materialize(summed.select("own", F.col("farther").alias("far"), add("leaves", "l"), add("saved", "s")), "trie-sums")
        drop_table(cur)
        cur = after
    return cur.select("own", "leaves", "saved")


def trie(seqs: DataFrame, limits: tuple[int, int, int] = LIMITS) -> DataFrame:
    """A row for each node: ``COUNTS`` and ends_sha256; ``limits`` of a block change no row."""
    ids = F.array_join(F.transform("turns", lambda t: t["id"]), "")
    keys = seqs.select(F.unhex(ids).alias("key"), F.transform("turns", lambda t: t["n"]).alias("sizes"), F.col("conv_id").cast("long").alias("conv_id"))
    keys = materialize(keys, "trie-keys")
    parts = keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(lambda batches: block_nodes(batches, limits), SCHEMA)
    parts = materialize(parts, "trie-parts")
    drop_table(keys)
    of = {"conv_id": F.min, "depth": F.min, "above": F.min, "n_convs": F.sum, "n_children": F.sum, "n_leaves": F.sum, "saved_tokens": F.sum, "size": F.max}
    opened = materialize(parts.where("own is not null").groupBy("own").agg(*(f(c).alias(c) for c, f in of.items())), "trie-open")
    kids = opened.where("above is not null").groupBy(F.col("above").alias("own")).agg(F.count("*").alias("more"))
    opened = opened.join(kids, "own", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    leaves = F.col("n_leaves") + (F.col("n_children") == 0).cast("long")
    sums = subtree_sums(opened.select("own", "above", leaves.alias("leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")).alias("saved")))
    opened = opened.drop("n_leaves", "saved_tokens").join(sums.withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"}), "own")
    opened = opened.join(hashed(parts.where("ends is not null")), "own", "left").fillna(NO_ENDS, ["ends_sha256"])
    opened = materialize(opened.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*COUNTS, "ends_sha256", "own", "above"), "trie-open")
    names = opened.select(F.col("own").alias("above"), F.col("conv_id").alias("named"))
    names = F.broadcast(names) if sendable(names) else names
    columns = [*COUNTS, "ends_sha256"]
    inner = parts.where("own is null")
    under = inner.where("above is not null").unionByName(opened.where("above is not null"), allowMissingColumns=True).join(names, "above", "left").withColumn("parent_conv_id", F.col("named"))
    return inner.where("above is null").select(*columns).unionByName(under.select(*columns)).unionByName(opened.where("above is null").select(*columns))


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS x, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x) AS k, x, n FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda b: [256 + ascii(b), {", ".join(["-1"] * 8)}])),
  lambda s, e: CASE WHEN e >= 0 THEN xor(s, e - 256) ELSE xor(s >> 1, 3988292384 * (s & 1)) END, 4294967295)) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS src, k, x, n FROM c JOIN o ON o.conv_id = c.base AND k <= h UNION ALL SELECT c.conv_id, 1 AS src, k, x, n FROM c JOIN o ON o.conv_id = c.conv_id AND k > h),
p AS (SELECT conv_id, row_number() OVER w AS d, string_agg(x, '') OVER w AS path, n FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY src, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0 AS d, '' AS path, 0 AS n FROM c),
m AS (SELECT *, max(d) OVER (PARTITION BY conv_id) AS turns FROM p),
v AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE turns = d), '')) AS ends_sha256 FROM m GROUP BY d, path),
k AS (SELECT left(path, 64 * (d - 1)) AS path, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1),
f AS (SELECT v.*, coalesce(k.n_children, 0) AS n_children FROM v LEFT JOIN k USING (path)),
s AS (SELECT left(path, 64 * i) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS i FROM f) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (path) LEFT JOIN f u ON f.d > 0 AND u.path = left(f.path, 64 * (f.d - 1))
"""
