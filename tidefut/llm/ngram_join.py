"""Exact n-gram Jaccard join by PartEnum signatures.

A document's set is its distinct five-word shingles (hashed to 64 bits). Sets fall into size
bands; two sets of Jaccard similarity 0.8 or more are in the same band or in neighbouring
ones, and differ in at most ``k`` shingles, where ``k`` follows from the band's upper size.
For each band that a set may meet partners in, a hash divides the shingle domain into groups
of three partitions, and each two partitions of a group are enumerated: the part of the set in
both of them is one signature. The differences touch at most ``k`` partitions, and it takes two
of a group to change all of its three signatures, so at least ``groups - k // 2`` groups keep one.
A set with that many groups that have two empty partitions could agree on empty ones alone, so
it also signs under further, independent divisions, until one separates it. Where ``k`` is 0 only equal
sets link, which are one set anyway; where it is 1 each element is a partition of its own, and the set and the set
less each element are the signatures. Sets that share no signature can't link.

Spark deals the signatures out by their value; a task reads its own in order, a stream of rows
whatever the size of a group. Each set is first compared with the least set of the runs that most
of its signatures fall into, then with the least of its other runs where those are not connected
yet (stars, not all pairs), and the components of the links found so far are then checked for
completeness: of sets that share a signature, those still in different components are compared
with one another, in square blocks of bounded size; the first run that two sets share gives their pair. Sizes, and a parity sketch whose distance
never exceeds the true one, rule out most pairs; the others are verified on the full sets. Copies
of one set are one node throughout. A node is named by 64 bits of its set's 128-bit hash; names
that two sets share are told apart by the other half.

Words are runs of bytes other than white space after lower-casing A-Z; a text of fewer than
five words is one shingle; null texts and texts without words have an empty set and link
with nothing. Very long texts are taken whole. Rows that repeat an identifier or a text are
copies of one set, the smallest identifier names the class; pairs exactly at the limit link; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, connected_components, drop_table, forget, materialize, mix64, sendable, small_batches, texts_of, whole_groups

WIDTH = 5
#: Jaccard similarity as a fraction of whole numbers.
NUM, DEN = 80, 100
BAND = 1.4
#: Divisions of the shingle domain; a set of eight shingles or more needs a second one rarely and a tenth one hardly ever.
LEVELS = 100
#: Bits of the smallest and largest sketch of a set, powers of two; between them, two to four bits a shingle.
CELLS, MOST_CELLS = 256, 1 << 16
#: Members of one run that are compared in one block with one another.
SQUARE = 1024
#: Runs of so few members are compared many at a time.
SMALL = 48
#: Pairs of one set in a block that are verified before all that are left.
NEAREST = 2
#: Runs of a set in order, of which the first one that two sets share gives their pair.
FIRST_RUNS = 32
#: Names that sets of different hashes share; by chance, none in a thousand tables of 10^8 sets.
MOST_CLASHES = 10_000


@lru_cache(maxsize=None)
def bands(largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower sizes, differences allowed, and groups of partitions, of bands up to ``largest`` and one more."""
    low, diff, groups, lo = [], [], [], 1
    while not low or low[-1] <= largest:
        hi = max(lo, int(lo * BAND))
        k = 2 * hi * (DEN - NUM) // (DEN + NUM)
        low.append(lo)
        diff.append(k)
        groups.append(k // 2 + 1 + max(1, -(-k // 10)))
        lo = hi + 1
    return np.array(low), np.array(diff), np.array(groups)


def word_hashes(words: list[bytes]) -> tuple[np.ndarray]:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)),)


def shingle_sets(texts: list[str], table: WordTable) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, in order."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    at = table.ids([w for s in split for w in s])
    h = table.values[0][at]
    step = np.uint64(0x9E3779B97F4A7C15)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    m = max(0, len(h) - WIDTH + 1)
    long = np.zeros(m, np.uint64)
    for k in range(WIDTH):
        long = long * step + h[k : k + m]
    long = mix64(long, 5)
    out, a = [], 0
    for n in sizes.tolist():
        if n >= WIDTH:
            out.append(np.unique(long[a : a + n - WIDTH + 1]))
        elif n:
            v = np.zeros(1, np.uint64)
            for x in h[a : a + n]:
                v = v * step + x
            out.append(mix64(v, 7 + n))
        else:
            out.append(np.zeros(0, np.uint64))
        a += n
    return out


def set_hash(h: np.ndarray) -> tuple[int, int]:
    """Two numbers that name a set."""
    return int(mix64(h, 11).sum(dtype=np.uint64)), int(mix64(h, 13).sum(dtype=np.uint64))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of all sets, and the position of the set of each."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    low, diff, groups = bands(int(sizes.max()) if len(sizes) else 1)
    own = np.searchsorted(low, sizes, "right") - 1
    upper = (own + 1 < len(low)) & (sizes * DEN // NUM >= low[np.minimum(own + 1, len(low) - 1)])
    docs = np.concatenate([np.flatnonzero(sizes > 0), np.flatnonzero((sizes > 0) & upper)])
    band = np.concatenate([own[sizes > 0], own[(sizes > 0) & upper] + 1])
    found, owners = [], []
    none, one, many = diff[band] == 0, diff[band] == 1, diff[band] > 1
    if none.any():  # only equal sets link: those that the given ones hold several times sign as a whole
        few, n = docs[none], sizes[docs[none]]
        h = mix64(np.concatenate([sets[i] for i in few]), 29)
        whole = mix64(np.add.reduceat(h, np.cumsum(n) - n) + mix64(band[none].astype(np.uint64), 61), 19)
        again = np.unique(whole, return_inverse=True, return_counts=True)
        several = again[2][again[1]] > 1
        found.append(whole[several])
        owners.append(few[several])
    if one.any():
        few, n = docs[one], sizes[docs[one]]
        h = mix64(np.concatenate([sets[i] for i in few]), 29)
        total = np.add.reduceat(h, np.cumsum(n) - n) + mix64(band[one].astype(np.uint64), 61)
        found += [mix64(total, 19), mix64(np.repeat(total, n) - h, 19)]
        owners += [few, np.repeat(few, n)]
    docs, band = docs[many], band[many]
    for level in range(LEVELS):
        if not len(docs):
            break
        n, g, k = sizes[docs], groups[band], diff[band]
        p = 3 * g
        h = np.concatenate([sets[i] for i in docs])
        each = np.repeat(np.arange(len(docs)), n)
        place = ((mix64(h, 1000 + level) >> np.uint64(32)) * p[each].astype(np.uint64)) >> np.uint64(32)
        slot = (np.cumsum(p) - p)[each] + place.astype(np.int64)
        order = np.argsort(slot, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(slot[order]) > 0))
        total, filled = np.zeros(int(p.sum()), np.uint64), np.zeros(int(p.sum()), bool)
        total[slot[order][starts]] = np.add.reduceat(mix64(h[order], 2000 + level), starts)
        filled[slot] = True
        total, filled = total.reshape(-1, 3), filled.reshape(-1, 3)
        of = np.repeat(np.arange(len(docs)), g)
        tag = (np.arange(len(of)) - (np.cumsum(g) - g)[of]).astype(np.uint64) + (band[of].astype(np.uint64) << np.uint64(40)) + np.uint64(level << 56)
        for i, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
            some = filled[:, a] | filled[:, b]
            both = total[some, a] + mix64(total[some, b], 53) + mix64(tag[some], 59 + i)
            found.append(mix64(both, 19))
            owners.append(docs[of[some]])
        weak = np.bincount(of, filled.sum(axis=1) < 2, len(docs))
        again = weak >= g - k // 2
        docs, band = docs[again], band[again]
    if len(docs):  # hashes failed: one signature for all of the band
        found.append(mix64(band.astype(np.uint64), 23))
        owners.append(docs)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def sketch(h: np.ndarray) -> bytes:
    """Parities of a set's counts in cells: two sets differ in at least as many shingles as sketches in bits.

    The number of cells grows with the set, as a small sketch of a large set says nothing.
    """
    cells = min(MOST_CELLS, max(CELLS, 1 << (2 * len(h) - 1).bit_length())) if len(h) else CELLS
    return np.packbits(np.bincount((mix64(h, 31) >> np.uint64(40)).astype(np.int64) % cells, minlength=cells) & 1).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same set with fewer cells, ``size`` bytes of them."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def near(raw: list[np.ndarray], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair of positions, how far below the limit the finest sketches that both have differ, by size; below zero rules it out."""
    room = np.zeros(len(i))
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    size = np.minimum(lens[i], lens[j])
    for s in np.unique(size).tolist():
        at = np.flatnonzero(size == s)
        rows, back = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        bits = np.stack([folded(raw[r], s) for r in rows]).view(np.uint64)
        left, right = back[: len(at)], back[len(at) :]
        for a in range(0, len(at), 4096):
            part = at[a : a + 4096]
            differ = np.bitwise_count(bits[left[a : a + 4096]] ^ bits[right[a : a + 4096]]).sum(axis=1, dtype=np.int64)
            both = n[i[part]] + n[j[part]]
            room[part] = (both * (DEN - NUM) - differ * (DEN + NUM)) / both
    return room


def described(texts: list[str], table: WordTable) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Signatures of the texts' sets with the names of their sets (copies in a batch give them once), and each text's set size, name (both halves) and sketch."""
    sets = shingle_sets(texts, table)
    names = np.array([set_hash(h) for h in sets], np.uint64).reshape(-1, 2)
    once = np.unique(names, axis=0, return_index=True)[1]
    sig, of = signatures([sets[i] for i in once])
    names = names.view(np.int64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return sig.view(np.int64), names[once[of], 0], names, [sketch(h) for h in sets], sizes


def shared_runs(batches, streamed: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From signatures in order, members of those that several sets share, as (key of the run, node).

    Runs with the same members have the same key. A run of more than ``streamed`` members, of
    which a batch holds a part only, goes out as it comes, under its signature.
    """
    sig, node, open_run = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in _and_end(batches):
        if batch is not None:
            sig, node = (np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate((sig, node)))
        if not len(sig):
            continue
        once = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))
        sig, node = sig[once], node[once]
        starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        if open_run:  # the first row was sent before; what follows with its signature belongs to its run
            end = starts[1] if len(starts) > 1 else len(sig)
            if end > 1:
                yield mix64(sig[1:end].view(np.uint64), 47).view(np.int64), node[1:end]
            if end == len(sig) and batch is not None:
                sig, node = sig[-1:], node[-1:]
                continue
            sig, node, open_run = sig[end:], node[end:], False
            starts = starts[1:] - end
            if not len(sig):
                continue
        cut = len(sig) if batch is None else starts[-1]
        if cut:
            full = starts[starts < cut]
            sizes = np.diff(np.append(full, cut))
            key = np.add.reduceat(mix64(node[:cut].view(np.uint64), 41), full)
            keep = np.zeros(len(full), bool)
            keep[np.unique(key, return_index=True)[1]] = True
            ok = np.repeat(keep & (sizes > 1), sizes)
            yield mix64(np.repeat(key, sizes)[ok], 43).view(np.int64), node[:cut][ok]
        sig, node = sig[cut:], node[cut:]
        if len(sig) > streamed:
            yield mix64(sig.view(np.uint64), 47).view(np.int64), node
            sig, node, open_run = sig[-1:], node[-1:], True


def _and_end(batches):
    yield from batches
    yield None


def nearest_of(a: np.ndarray, b: np.ndarray, room: np.ndarray, nearest: int) -> np.ndarray:
    """Positions of the pairs that are among the ``nearest`` ones of one of their ends."""
    if not len(a):
        return np.zeros(0, np.int64)
    end, pair = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
    order = np.lexsort((-room[pair], end))
    starts = np.flatnonzero(np.append(True, end[order][1:] != end[order][:-1]))
    rank = np.arange(len(end)) - np.repeat(starts, np.diff(np.append(starts, len(end))))
    return np.unique(pair[order][rank < nearest])


def block_pairs(n: np.ndarray, group: np.ndarray, raw: list[np.ndarray], side: np.ndarray, nearest: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs in different groups that sizes and sketches don't rule out; with two sides, pairs across only.

    With ``nearest``, only those that are among so many nearest ones of one of their sets.
    """
    order = np.argsort(n, kind="stable")
    n, group, raw, side = n[order], group[order], [raw[k] for k in order], side[order]
    bits = np.stack([folded(r, CELLS // 8) for r in raw]).view(np.uint64)
    both = side.min() != side.max()
    reach = np.searchsorted(n, n * DEN // NUM, "right")  # larger ones that are not too large
    a, b, room = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for x in range(0, len(n), 128):
        y = min(x + 128, len(n))
        z = reach[y - 1]
        differ = np.bitwise_count(bits[x:y, None, :] ^ bits[None, x:z, :]).sum(axis=2)
        ok = differ <= (n[x:y, None] + n[None, x:z]) * (DEN - NUM) // (DEN + NUM)
        ok &= group[x:y, None] != group[None, x:z]
        if both:
            ok &= side[x:y, None] != side[None, x:z]
        i, j = np.nonzero(ok)
        i, j = i[j > i], j[j > i]
        score = near(raw, n, x + i, x + j)
        fine = score >= 0
        a.append(x + i[fine])
        b.append(x + j[fine])
        room.append(score[fine])
    a, b, room = np.concatenate(a), np.concatenate(b), np.concatenate(room)
    if nearest is not None:
        best = nearest_of(a, b, room, nearest)
        a, b = a[best], b[best]
    return order[a], order[b]


def first_here(run: np.ndarray, firsts: pa.Array, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the rows of each pair of positions have no run before this one in common, among the first runs of each: pairs that share many runs go out of one of them."""
    ends = firsts.offsets.to_numpy()
    sizes = np.diff(ends)
    table = np.full((len(sizes), max(1, int(sizes.max(initial=0)))), np.iinfo(np.int64).max)
    table[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(ends[:-1] - ends[0], sizes)] = firsts.values.to_numpy()[ends[0] : ends[-1]]
    out = np.ones(len(x), bool)
    for a in range(0, len(x), 2048):
        left, right = table[x[a : a + 2048]], table[y[a : a + 2048]]
        before = left < run[x[a : a + 2048], None]
        out[a : a + 2048] = ~((left[:, :, None] == right[:, None, :]) & before[:, :, None]).any(axis=(1, 2))
    return out


def describe(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node, node2, sketch, name) of every row, and (run, node) of signatures that several sets share; one pass over the texts.

    ``node`` is ``name`` unless two sets share that.
    """
    field = docs.schema["doc_id"].dataType.simpleString()
    own_kinds = [("n", pa.int64()), ("node2", pa.int64()), ("sketch", pa.binary())]
    names = ["sig", "node", "own"]

    def signed(batches):
        forget()
        table = WordTable(word_hashes, 250_000)
        for batch in batches:
            kind = pa.struct([*own_kinds, ("doc_id", batch.column(0).type)])
            for a, b in small_batches(batch.column(1)):
                sig, of, named, sketches, sizes = described(texts_of(batch.column(1), a, b), table)
                for i in range(0, len(sig), 200_000):
                    part = [pa.array(sig[i : i + 200_000]), pa.array(of[i : i + 200_000])]
                    yield pa.RecordBatch.from_arrays([*part, pa.nulls(len(part[0]), kind)], names=names)
                spread = mix64(np.arange(b - a).astype(np.uint64), 67) + mix64(named[:, 0].view(np.uint64), 71)
                own = pa.StructArray.from_arrays([pa.array(sizes), pa.array(np.ascontiguousarray(named[:, 1])), pa.array(sketches, pa.binary()), batch.column(0).slice(a, b - a)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([pa.array(spread.view(np.int64)), pa.array(np.ascontiguousarray(named[:, 0])), own], names=names)
        del table
        forget()

    def shared(batches):
        rows: list[pa.RecordBatch] = []

        def signatures_only():
            for batch in batches:
                described = pc.is_valid(batch.column(2))
                got = batch.filter(described)
                rows.append(pa.RecordBatch.from_arrays([pa.nulls(got.num_rows, pa.int64()), *got.columns[1:]], names=["run", *names[1:]]))
                yield batch.filter(pc.invert(described)).select([0, 1])

        kind = None
        for run, node in shared_runs(signatures_only()):
            kind = kind or rows[0].schema.field(2).type
            while rows:
                yield rows.pop()
            yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(node), pa.nulls(len(run), kind)], names=["run", *names[1:]])
        yield from rows

    schema = f"long, node long, own struct<n: bigint, node2: bigint, sketch: binary, doc_id: {field}>"
    rows = docs.select("doc_id", "text").mapInArrow(signed, f"sig {schema}").repartition("sig").sortWithinPartitions("sig", "node")
    both = materialize(rows.mapInArrow(shared, f"run {schema}"), "jaccard-pass")
    rows, runs = both.where("run is null").select("node", F.col("node").alias("name"), "own.*"), both.where("run is not null").select("run", "node").distinct()
    while True:
        halves = rows.where("n > 0").groupBy("node").agg(F.min("node2").alias("lo"), F.max("node2").alias("hi"))
        clash = [r["node"] for r in halves.where("lo <> hi").limit(MOST_CLASHES + 1).collect()]
        if not clash:
            break
        if len(clash) > MOST_CLASHES:
            raise ValueError("64 bits don't tell these sets apart")
        rows = rows.withColumn("node", F.when(F.col("node").isin(clash), F.xxhash64("node", "node2")).otherwise(F.col("node")))
        named = rows.where(F.col("name") != F.col("node")).select("name", F.col("node").alias("other")).distinct()
        runs = both.where("run is not null").select("run", "node").distinct().join(named, F.col("node") == F.col("name"), "left").select("run", F.coalesce("other", "node").alias("node"))
        runs = runs.unionByName(named.select(F.xxhash64("name").alias("run"), F.col("other").alias("node")))  # they were one member so far
    return rows, materialize(runs, "jaccard-runs")


def not_ruled_out(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow a link."""
    for c in "ab":
        pairs = pairs.join(info.select(F.col("node").alias(c), F.col("n").alias("n" + c), F.col("sketch").alias("s" + c)), c)
    alike = F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM

    def compared(batches):
        for batch in batches:
            raw = [np.frombuffer(x, np.uint8) for c in ("sa", "sb") for x in batch.column(c).to_pylist()]
            n = np.concatenate([batch.column(c).to_numpy() for c in ("na", "nb")])
            i = np.arange(batch.num_rows)
            ok = pa.array(near(raw, n, i, i + batch.num_rows) >= 0)
            yield batch.select(["a", "b"]).filter(ok)

    return pairs.where(alike).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(compared, "a long, b long")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, shingles) for wanted (doc_id, node, name, node2) rows, from the whole texts again."""
    rows = docs.select(F.col("doc_id").alias("own_id"), "text").join(F.broadcast(wanted) if sendable(wanted) else wanted, F.col("own_id").eqNullSafe(F.col("doc_id"))).select("node", "text", "name", "node2")

    def measured(batches):
        forget()
        table = WordTable(word_hashes, 250_000)
        for batch in batches:
            node, name, other = (batch.column(k).to_numpy() for k in (0, 2, 3))
            for a, b in small_batches(batch.column(1)):
                sets = shingle_sets(texts_of(batch.column(1), a, b), table)
                named = np.array([set_hash(h) for h in sets], np.uint64).reshape(-1, 2).view(np.int64)
                ok = (named[:, 0] == name[a:b]) & (named[:, 1] == other[a:b])
                sets = [h for h, k in zip(sets, ok, strict=True) if k]  # a repeated identifier may stand on another text too
                values = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
                offsets = pa.array(np.append(0, np.cumsum([len(h) for h in sets])).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(node[a:b][ok]), pa.array([len(h) for h in sets], pa.int64()), pa.ListArray.from_arrays(offsets, values)], names=["node", "n", "shingles"])

    return rows.mapInArrow(measured, "node long, n long, shingles array<long>")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough. Spark may split both sides of the joins (adaptive skew join), so the pairs of one centre need not meet in one task."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = materialize(sets_of(docs, classes.join(ends, "node", "left_semi").select("doc_id", "node", "name", "node2")).dropDuplicates(["node"]), "jaccard-sets")
    x = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    y = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(x, "a").join(y, "b").withColumn("i", common)
    links = materialize(joined.where(F.col("i") * DEN >= (F.col("na") + F.col("nb") - F.col("i")) * NUM).select("a", "b"), "jaccard-links")
    drop_table(sets)
    return links


def grouped(runs: DataFrame, info: DataFrame, components: DataFrame) -> DataFrame:
    """(run, node, grp): members of runs with their components so far."""
    group = info.select("node").join(components, "node", "left").select("node", F.coalesce("component", "node").alias("grp"))
    return materialize(runs.join(group, "node"), "jaccard-members")


def starred(members: DataFrame, one: bool) -> DataFrame:
    """Pairs of a set and the least set of a run of both, in different components; with ``one``, of each set the pair of most runs."""
    least = members.groupBy("run").agg(F.min(F.struct("node", "grp")).alias("least"))
    pairs = members.join(least, "run").where("grp <> least.grp").groupBy(F.col("node").alias("a"), F.col("least.node").alias("b")).count()
    if one:
        pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
    return pairs.select("a", "b")


def unconnected(named: DataFrame, info: DataFrame, nearest: int | None) -> DataFrame:
    """Pairs of sets of one run that are in different components so far and not ruled out: all, or each set's nearest in its run of most members.

    Of all the runs that two sets share, the first one gives the pair, as far as it is among the ``FIRST_RUNS`` first ones of both.
    """
    mixed = named.groupBy("run").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count("*").alias("members")).where("lo <> hi")
    members = named.join(mixed.select("run", "members"), "run")
    by_node = members.groupBy("node")
    if nearest is None:
        members = members.join(by_node.agg(F.slice(F.sort_array(F.collect_set("run")), 1, FIRST_RUNS).alias("firsts")), "node")
    else:
        chosen = by_node.agg(F.max_by(F.struct("run", "grp", "members"), F.struct("members", "run")).alias("most"))
        members = chosen.select("node", "most.*", F.array().cast("array<long>").alias("firsts"))
    members = members.join(info, "node").withColumn("cells", F.ceil(F.col("members") / SQUARE)).withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    key = ["run", "i", "j"]
    dealt = dealt.select("run", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), "node", "n", "grp", "sketch", (F.col("cell") > F.col("other")).cast("int").alias("side"), "firsts")

    def compared(batches):
        for part in whole_groups(batches, 3):
            a, b = group_pairs(part, nearest)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(compared, "a long, b long").distinct()


def group_pairs(part: pa.RecordBatch, nearest: int | None) -> tuple[np.ndarray, np.ndarray]:
    """``block_pairs`` of each group (of equal run, i and j) of a batch; small groups all at once."""
    run, i, j, node, n, grp, side = (part.column(k).to_numpy() for k in (0, 1, 2, 3, 4, 5, 7))
    raw = [np.frombuffer(x, np.uint8) for x in part.column(6).to_pylist()]
    starts = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    sizes = np.diff(np.append(starts, len(run)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def once(x, y):
        """One of the pairs of positions of equal nodes."""
        a, b = np.maximum(node[x], node[y]), np.minimum(node[x], node[y])
        order = np.lexsort((y, x, b, a))
        a, b = a[order], b[order]
        kept = order[np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))] if len(order) else order
        return x[kept], y[kept]

    for s, m in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        at = slice(s, s + m)
        x, y = block_pairs(n[at], grp[at], raw[at], side[at], nearest)
        left.append(s + x)
        right.append(s + y)
    rows = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    if len(rows):
        gid = np.repeat(np.arange(len(sizes)), sizes)
        across = np.repeat(np.maximum.reduceat(side, starts) != np.minimum.reduceat(side, starts), sizes)
        ends = np.repeat(starts + sizes, sizes)
        later = (ends - np.arange(len(run)) - 1)[rows]
        x = np.repeat(rows, later)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later) - later, later)
        ok = (gid[x] == gid[y]) & (grp[x] != grp[y]) & (np.minimum(n[x], n[y]) * DEN >= np.maximum(n[x], n[y]) * NUM) & (~across[x] | (side[x] != side[y]))
        x, y = x[ok], y[ok]
        x, y = once(x, y)
        room = near(raw, n, x, y)
        x, y, room = x[room >= 0], y[room >= 0], room[room >= 0]
        if nearest is not None:
            best = nearest_of(np.maximum(node[x], node[y]), np.minimum(node[x], node[y]), room, nearest)
            x, y = x[best], y[best]
        left.append(x)
        right.append(y)
    x, y = np.concatenate(left), np.concatenate(right)
    here = first_here(run, part.column(8), x, y)
    x, y = once(x[here], y[here])
    return np.maximum(node[x], node[y]), np.minimum(node[x], node[y])


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    rows, runs = describe(docs)
    classes = materialize(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("name").alias("name"), F.min("node2").alias("node2")), "jaccard-classes")
    info = classes.select("node", "n", "sketch")
    members, tried, links, moved, found_members = runs.withColumn("grp", F.col("node")), None, None, False, False
    # stars first, then each set's nearest ones in other components, then all that is left: only this last step decides completeness
    for step in (lambda m: starred(m, True), lambda m: starred(m, False), lambda m: unconnected(m, info, NEAREST), lambda m: unconnected(m, info, None)):
        if moved:
            if found_members:
                drop_table(members)
            members, moved, found_members = grouped(runs, info, components), False, True
        pairs = step(members)
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(not_ruled_out(pairs, info), "jaccard-pairs")
        if tried is not None and not pairs.limit(1).count():
            continue
        found = verified(pairs, docs, classes)
        tried, links = (pairs, found) if tried is None else (tried.unionByName(pairs), links.unionByName(found))
        components = connected_components(links, "jaccard-cc")
        moved = True
    for table in [runs, *([members] if found_members else [])]:
        drop_table(table)
    named = classes.join(components, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = components.join(named, "component").select("node", "component_id")
    whole = classes.join(named, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = rows.join(whole.withColumnRenamed("node", "_n"), (F.col("node") == F.col("_n")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
