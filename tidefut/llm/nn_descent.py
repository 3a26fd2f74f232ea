"""Near-duplicate vectors by NN-descent.

Every vector has a list of its nearest neighbours so far. A round joins each vector's
neighbours and reverse neighbours with one another, in blocks of bounded size (a hub with
very many reverse neighbours is dealt into several blocks), and keeps two lists for each: the
best ``k`` of its component so far and the best ``k`` outside of it. Lists start from sorted
sign codes of random rotations.

No list of outside neighbours is ever saturated: one at or above the threshold is a link,
joins the two components, and makes room in the lists of all their members. Rounds go on
until one adds no link. Then two audits follow. Fresh rotations find links of all vectors by themselves: the share
of them that lies inside components already is the recall, wherever links are, as the fresh ones know nothing of the
rounds before. And vectors from components of all sizes are compared with all others by brute force (each component
weighs the same, a hot one hides no other). What either finds missing is added, and rounds go on, until
``CLEAN`` audits in a row reach ``target``. Every audit that fails joins components, so this ends. The result gives the
last recall and how many links it was measured on: null and few where a table has hardly any.

The list inside is at last enlarged to the whole component, which gives the exact number of links
of each: members lie in cells of cells with a centre and a radius, and only pairs of cells that the
triangle inequality leaves undecided are compared vector by vector. Equal vectors are one node with a
weight.

Cosines are in double precision. Vectors that are null, zero, or hold null or non-finite
components, link with nothing; vectors of different lengths don't link. Rows that repeat a
vector link with one another; rows that repeat an identifier too are counted each. Of equally near
neighbours the one with the smaller number stays in a list. Empty tables give empty results; columns
other than vec_id and embedding, labels too, are not read, whatever their names.
"""

from __future__ import annotations

import logging
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import connected_components, drop_table, key_groups, materialize, sendable

K, ROTATIONS, BITS, BLOCK, TOP = 10, 8, 16, 64, 5
SQUARE = 256
AUDITED, TARGET = 200, 0.995
#: Audits in a row that must reach the target, and links that a recall is measured on, at least.
CLEAN, MEASURED = 2, 20


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, padded with zeros to one length, and their lengths."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(sizes) and (sizes == sizes[0]).all():
        x = flat.reshape(len(sizes), sizes[0]).copy()
    else:
        x = np.zeros((len(sizes), sizes.max() if len(sizes) else 0))
        x[np.arange(x.shape[1]) < sizes[:, None]] = flat
    return x, sizes


def _unit(x: np.ndarray) -> np.ndarray:
    """Scaled twice, so that very large and very small components neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cosines(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, other: np.ndarray) -> np.ndarray:
    d = max(x.shape[1], y.shape[1])
    x, y = (np.pad(z, ((0, 0), (0, d - z.shape[1]))) for z in (x, y))
    return np.where(sizes[:, None] == other[None, :], _unit(x) @ _unit(y).T, -2.0)


def _best(ids: np.ndarray, group: np.ndarray, cos: np.ndarray, top: int):
    """Batches of each row's ``top`` best others of its own group, and of other groups."""
    cos[ids[:, None] == ids[None, :]] = -3.0
    top = min(top, len(ids) - 1)
    outside = group[:, None] != group[None, :]
    for far in (True, False):
        allowed = outside if far else ~outside
        left = np.where(allowed, cos, -3.0)
        at = np.argpartition(-left, top - 1, axis=1)[:, :top]
        s = np.take_along_axis(left, at, axis=1).ravel()
        ok = s > -1.5
        if ok.any():
            yield _edges(np.repeat(ids, top)[ok], ids[at].ravel()[ok], s[ok], far)


EDGE = "u long, v long, sim double, far boolean"


def _edges(u, v, s, far: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s), pa.array(np.full(len(u), far))], names=["u", "v", "sim", "far"])


def starting_lists(placed: DataFrame, k: int, step: int = 0) -> DataFrame:
    """Neighbours within blocks of vectors whose sign codes, under some rotation, are next to one another; each step has its own rotations."""

    bits = max(BITS, placed.count().bit_length())  # a larger table needs longer codes to tell neighbours apart

    def coded(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            x, _ = _matrix(batch.column(1))
            d = x.shape[1]
            if d not in planes:
                planes[d] = np.random.default_rng([d, step]).standard_normal((d, ROTATIONS * bits))
            signs = (x @ planes[d] > 0).reshape(len(x), ROTATIONS, bits)
            codes = signs @ (1 << np.arange(bits)[::-1])
            for r in range(ROTATIONS):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), r)), pa.array(codes[:, r].astype(np.int64)), *batch.columns], names=["rot", "code", "nid", "e", "grp"])

    def compared(batches):
        for batch in batches:
            ids, group = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            for a in range(0, len(ids), BLOCK):
                x, sizes = _matrix(batch.column(3).slice(a, BLOCK))
                if len(x) > 1:
                    yield from _best(ids[a : a + BLOCK], group[a : a + BLOCK], _cosines(x, sizes, x, sizes), k)

    rows = placed.select("nid", "e", "grp").mapInArrow(coded, "rot long, code long, nid long, e array<double>, grp long")
    order = ["rot", "code", "nid"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compared, EDGE)


def best_k(edges: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each vector inside its component, and the best ``k`` outside."""
    w = Window.partitionBy("u", "far").orderBy(F.desc("sim"), "v")
    return edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("far").alias("far")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def placed_in(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """(nid, e, grp): nodes with their components so far."""
    return nodes.join(components.withColumnRenamed("node", "nid"), "nid", "left").select("nid", "e", F.coalesce("component", "nid").alias("grp"))


def marked(lists: DataFrame, components: DataFrame) -> DataFrame:
    """The lists, told apart anew by the components so far."""
    cu, cv = (components.select(F.col("node").alias(x), F.col("component").alias("c" + x)) for x in "uv")
    both = lists.drop("far").join(cu, "u", "left").join(cv, "v", "left")
    return both.select("u", "v", "sim", (F.coalesce("cu", "u") != F.coalesce("cv", "v")).alias("far"))


def local_join(placed: DataFrame, lists: DataFrame) -> DataFrame:
    """Compare the neighbours and reverse neighbours of each vector with one another."""
    near = lists.select(F.col("u").alias("w"), F.col("v").alias("m"))
    both = near.unionByName(near.select(F.col("m").alias("w"), F.col("w").alias("m"))).unionByName(near.select("w", F.col("w").alias("m"))).distinct()
    degree = both.groupBy("w").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = both.join(degree, "w").withColumn("salt", F.pmod(F.xxhash64("m", "w"), F.col("blocks"))).select("w", "salt", "m")
    members = dealt.join(placed.select(F.col("nid").alias("m"), "e", "grp"), "m").select("w", "salt", "m", "e", "grp")

    def compared(batches):
        for group in key_groups(batches, 2):
            ids = group.column(2).to_numpy()
            if len(ids) > 1:
                x, sizes = _matrix(group.column(3))
                yield from _best(ids, group.column(4).to_numpy(), _cosines(x, sizes, x, sizes), TOP)

    return members.repartition("w", "salt").sortWithinPartitions("w", "salt").mapInArrow(compared, EDGE)


def audit(nodes: DataFrame, components: DataFrame, threshold: float, step: int = 0) -> tuple[float | None, DataFrame]:
    """The share of linked vectors with all their links inside their component (None without any), and the missing links (a, b).

    Up to ``AUDITED`` vectors of each class of component sizes are compared with all others;
    every component weighs the same, whatever its size.
    """
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    placed = placed_in(nodes, components)
    classes = placed.join(sizes.withColumnRenamed("component", "grp"), "grp", "left").withColumn("size", F.coalesce("size", F.lit(1))).withColumn("class", F.floor(F.log2("size")))
    w = Window.partitionBy("class").orderBy(F.xxhash64("nid", F.lit(step)), "nid")
    probe = classes.withColumn("n", F.row_number().over(w)).where(F.col("n") <= AUDITED).drop("n").collect()
    rows = {r["class"]: r["count"] for r in classes.groupBy("class").count().collect()}
    drawn = Counter(r["class"] for r in probe)
    weight = {r["nid"]: rows[r["class"]] / drawn[r["class"]] / r["size"] for r in probe}
    sent = nodes.sparkSession.sparkContext.broadcast([(r["nid"], r["grp"], r["e"]) for r in probe])

    def brute(batches):
        ids, groups = (np.array([r[k] for r in sent.value], np.int64) for k in (0, 1))
        y, other = _matrix(pa.array([r[2] for r in sent.value], pa.list_(pa.float64())))
        for batch in batches:
            x, lengths = _matrix(batch.column(1))
            mine, own = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            hit = (_cosines(x, lengths, y, other) >= threshold) & (mine[:, None] != ids[None, :])
            i, j = np.nonzero(hit & (own[:, None] != groups[None, :]))
            linked = ids[hit.any(axis=0)]
            yield pa.RecordBatch.from_arrays([pa.array([*mine[i].tolist(), *[None] * len(linked)], pa.int64()), pa.array(np.append(ids[j], linked))], names=["a", "b"])

    true = materialize(placed.select("nid", "e", "grp").mapInArrow(brute, "a long, b long"), "nn-audit")
    found = true.groupBy("b").agg(F.count("a").alias("missed")).collect()
    total = sum(weight[r["b"]] for r in found)
    share = sum(weight[r["b"]] for r in found if not r["missed"]) / total if total else None  # none of them has a link: nothing to measure
    logging.getLogger(__name__).info("audit %d: %d vectors, share of components' linked vectors with all links: %s", step, len(probe), share)
    return share, true.where("a is not null")


PAIR = "i long, j long, node long, links long"
MEMBER = "component long, id long, e array<double>, mult long, radius double"
#: Angles nearer than this to the threshold are compared vector by vector.
MARGIN = 1e-6


def cells_of(rows: DataFrame, square: int) -> DataFrame:
    """Rows of ``MEMBER`` and their component's ``size``, cut into cells of neighbours: each row with its ``parent``, and for each cell a row without.

    Neighbours have the same nearest pivot and then are next to one another by sign code. Pivots are about ``square`` rows of a component at most, drawn by hash;
    where those of all components are too many bytes to be sent, sign codes alone decide. Cells change the work, not a result.
    A cell's row holds its centre, the largest angle to what lies in it, and its weight.
    """
    spark = rows.sparkSession
    parts = min(rows.count() // (8 * square) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.greatest(F.lit(square), F.floor(F.col("size") / square))) == 0).select("component", "e")
    pivots: dict[int, list] = {}
    for r in drawn.collect() if sendable(drawn) else []:
        pivots.setdefault(r["component"], []).append(r["e"])
    sent = spark.sparkContext.broadcast({c: _unit(np.array(e, float)) for c, e in pivots.items()})

    def coded(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            x, sizes = _matrix(batch.column(2))
            d = x.shape[1]
            if d not in planes:
                planes[d] = np.random.default_rng([d, 62]).standard_normal((d, 62))
            own, nearest = batch.column(0).to_numpy(), np.zeros(len(x), np.int64)
            for c in set(own.tolist()) & sent.value.keys():
                of, to = own == c, sent.value[c]
                nearest[of] = (_unit(x[of])[:, : to.shape[1]] @ to.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest), pa.array((x @ planes[d] > 0) @ (1 << np.arange(62)[::-1]))], names=[*batch.schema.names, "pivot", "code"])

    def cut(batches):
        made = TaskContext.get().partitionId() << 33
        for group in key_groups(batches, 2):
            for a in range(0, group.num_rows, square):
                part = group.slice(a, square)
                x = _unit(_matrix(part.column(3))[0])
                n, centre = len(x), x.mean(axis=0)
                centre = _unit(centre[None])[0] if np.abs(centre).max() > 1e-9 else x[0]
                radius = (np.arccos(np.clip(x @ centre, -1, 1)) + part.column(5).to_numpy()).max() + MARGIN  # never 0, as a vector's is
                own = [part.column(k) for k in (0, 2, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(n, made))], names=_CELLS)
                first = part.column(0).slice(0, 1)
                whole = [pa.array([v], t) for v, t in ((made, pa.int64()), (centre, pa.list_(pa.float64())), (int(part.column(4).to_numpy().sum()), pa.int64()), (radius, pa.float64()), (None, pa.int64()))]
                yield pa.RecordBatch.from_arrays([first, *whole], names=_CELLS)
                made += 1

    order = ["component", "pivot", "code", "id"]
    coded_rows = rows.select(*_CELLS[:5]).mapInArrow(coded, MEMBER + ", pivot long, code long").select("component", "pivot", "id", "e", "mult", "radius", "code")
    return coded_rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(cut, MEMBER + ", parent long")


_CELLS = ["component", "id", "e", "mult", "radius", "parent"]


def compared_pairs(pairs: DataFrame, children: DataFrame, threshold: float) -> DataFrame:
    """For pairs (i, j) of parents, what their children (``parent`` and the columns of ``MEMBER``) have to do with one another.

    Rows with ``node``: so many links for all that lies in this child. Rows without: two cells that only
    their own children decide. Of two vectors the cosine decides, of two cells the angle between their centres,
    where their radii leave no doubt. A cell and itself are always left to the children.
    """
    limit = float(np.arccos(min(1.0, threshold)))
    child = children.select("parent", "id", "e", "mult", "radius")
    sides = [pairs.join(child.withColumnRenamed("parent", key), key).select("i", "j", F.lit(side).alias("side"), "id", "e", "mult", "radius") for side, key in enumerate("ij")]
    rows = sides[0].unionByName(sides[1].where("i <> j"))

    def decided(batches):
        for group in key_groups(batches, 2):
            first = group.column(2).to_numpy() == 0
            same = first.all()
            a, b = (first, first) if same else (first, ~first)
            ids, mult, radius = (group.column(k).to_numpy() for k in (3, 5, 6))
            x, sizes = _matrix(group.column(4))
            cos = _cosines(x[a], sizes[a], x[b], sizes[b])
            own = ids[a][:, None] == ids[b][None, :]
            around = radius[a][:, None] + radius[b][None, :]
            angle = np.arccos(np.clip(cos, -1, 1))
            vectors = around == 0
            hit = np.where(vectors, cos >= threshold, angle + around <= limit - MARGIN) & ~own
            open_ = ~vectors & ~hit & (angle - around <= limit + MARGIN)
            found = [(ids[a], hit @ mult[b])] if same else [(ids[a], hit @ mult[b]), (ids[b], hit.T @ mult[a])]
            for node, links in found:
                node, links = node[links > 0], links[links > 0]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(node), pa.int64()), pa.nulls(len(node), pa.int64()), pa.array(node), pa.array(links)], names=["i", "j", "node", "links"])
            i, j = np.nonzero(np.triu(open_) if same else open_)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a][i]), pa.array(ids[b][j]), pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.int64())], names=["i", "j", "node", "links"])

    return rows.repartition("i", "j").sortWithinPartitions("i", "j", "side", "id").mapInArrow(decided, PAIR)


def count_links(nodes: DataFrame, components: DataFrame, threshold: float, square: int = SQUARE) -> DataFrame:
    """(nid, links): weights of the other nodes of its component at or above the threshold.

    Components of up to ``square`` members are compared whole. Larger ones are cut into cells, these into cells of
    cells, until a component has no more than ``square``; then pairs of cells are followed downwards. Pairs that lie wholly within
    or wholly beyond the threshold end there, and only what is left is compared vector by vector.
    """
    members = components.select("component", F.col("node").alias("nid")).join(nodes, "nid")
    rows = materialize(members.select("component", F.col("nid").alias("id"), "e", F.col("mult").cast("long").alias("mult"), F.lit(0.0).alias("radius")), "nn-members")
    levels, written = [], [rows]  # from the vectors upwards: rows below a parent, and those of components that end there
    while True:
        size = rows.groupBy("component").agg(F.count("*").alias("size"))
        large = size.where(F.col("size") > square)
        top = rows.join(large, "component", "left_anti").withColumn("parent", F.col("component"))
        if not large.limit(1).count():
            levels.append((None, top))
            break
        cut = materialize(cells_of(rows.join(large, "component"), square), "nn-cells")
        written.append(cut)
        levels.append((cut.where("parent is not null"), top))
        rows = cut.where("parent is null").drop("parent")
    pairs = counts = None
    for below, top in reversed(levels):
        roots = top.select(F.col("component").alias("i"), F.col("component").alias("j")).distinct()
        found = compared_pairs(roots, top, threshold)
        if below is not None:
            found = found.unionByName(compared_pairs(pairs.where("node is null").select("i", "j"), below, threshold))
        pairs = materialize(found, "nn-pairs")
        written.append(pairs)
        own = pairs.where("node is not null").groupBy(F.col("node").alias("id")).agg(F.sum("links").alias("links"))
        if below is not None:  # what was found for a cell holds for all that lies in it
            above = below.select("id", "parent").join(counts.withColumnRenamed("id", "parent"), "parent").select("id", "links")
            own = own.unionByName(above).groupBy("id").agg(F.sum("links").alias("links"))
        counts = own
    counts = materialize(counts.select(F.col("id").alias("nid"), "links"), "nn-counts")
    for table in written:
        drop_table(table)
    return counts


def joined(components: DataFrame, links: DataFrame) -> DataFrame:
    """The components that further links leave."""
    return connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links), "nn-cc")


def fresh_links(placed: DataFrame, k: int, step: int, threshold: float) -> tuple[DataFrame, int, int]:
    """Lists from rotations of their own, how many links these have, and how many of those join two components."""
    lists = materialize(best_k(starting_lists(placed, k, step), k), "nn-lists")
    hit = F.col("sim") >= threshold
    row = lists.agg(F.count(F.when(hit, 1)).alias("all"), F.count(F.when(hit & F.col("far"), 1)).alias("far")).first()
    return lists, row["all"], row["far"]


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, k: int = K, target: float = TARGET) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; audited_recall and audited_links: the last audit's, by fresh rotations (recall is null below ``MEASURED`` links)."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("e", lambda x: x != 0), F.lit(False))
    good = rows.where(usable)
    nodes = materialize(good.groupBy("e").agg(F.count("*").alias("mult"), F.min("vec_id").alias("low")).withColumn("nid", F.monotonically_increasing_id()), "nn-nodes")
    lists = materialize(best_k(starting_lists(nodes.select("nid", "e", F.col("nid").alias("grp")), k), k), "nn-lists")
    ends = [F.col("u").alias("a"), F.col("v").alias("b")]
    links, step, clean = lists.where(F.col("sim") >= threshold).select(*ends), 0, 0
    components = connected_components(links, "nn-cc")
    while True:
        placed = placed_in(nodes, components)
        nxt = materialize(best_k(marked(lists, components).unionByName(local_join(placed, lists)), k), "nn-lists")
        drop_table(lists)
        lists = nxt
        links = lists.where(F.col("far") & (F.col("sim") >= threshold)).select(*ends)
        if links.limit(1).count():
            clean = 0
        while clean < CLEAN and not links.limit(1).count():  # the rounds add no more: audits, until one finds a link
            step += 1
            again, n_links, missed = fresh_links(placed, k, step, threshold)
            share, links = audit(nodes, components, threshold, step)
            good_enough = (share is None or share >= target) and missed <= (1 - target) * n_links
            clean = clean + 1 if good_enough else 0
            links = links.unionByName(again.where(F.col("far") & (F.col("sim") >= threshold)).select(*ends))
            if not good_enough:
                nxt = materialize(best_k(lists.unionByName(again), k), "nn-lists")
                drop_table(lists)
                lists = nxt
        components = joined(components, links)
        if clean >= CLEAN:
            break
    counts = count_links(nodes, components, threshold)
    found = nodes.join(components.withColumnRenamed("node", "nid"), "nid", "left").join(counts, "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    lowest = found.groupBy("component").agg(F.min("low").alias("component_id"))
    found = found.join(lowest, "component").select("e", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    linked = good.join(found, "e").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumns({"kept": F.col("vec_id").eqNullSafe(F.col("component_id")), "audited_recall": F.lit(1 - missed / n_links if n_links >= MEASURED else None).cast("double"), "audited_links": F.lit(n_links).cast("long")})

