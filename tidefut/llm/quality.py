"""Document quality by Bradley-Terry pairwise ranking.

Every preference pair (a document labelled 1 over one labelled 0) is a comparison; the
score of a document is linear in its features, and the chance that one document beats
another is the logistic function of the score difference. The weights minimise the logistic
loss on feature differences. The published score is shifted so that the threshold falls on
a quantile of the training scores: the share of documents labelled 0.

The fit takes every labelled document and every pair of them. Their features are written once; each Newton step
sums them over cells of a class and a sixteenth of a score's unit (number, scores, features, products of features),
and all pairs of documents are pairs of cells, compared at the mean scores of their documents. The quantile is
exact. Scoring covers every whole text. A null
text counts as empty and gets a score as well. Null labels are left out; of repeated labels
of one document the largest counts. With only one class, all scores are 0.5. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, crc_mod, drop_table, forget, materialize, sendable, small_batches, texts_of

N_FEATURES = 18
#: Cells of scores for each class, and how many of them are one unit of a score; the outermost hold all beyond.
CELLS, FINE = 512, 16
#: Scores that the driver sorts at once.
SORTED = 10_000
#: Pairs of features, whose products are summed.
_I, _J = np.triu_indices(N_FEATURES)

_UPPER, _LOWER, _DIGIT = (np.zeros(256) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = 1
_MARKS = [b"!", b"|", b"#$%&*", b"<>{}[]\\=_~^", b".", b",;:", b"@/", b"?"]


def features(texts: list[str]) -> np.ndarray:
    """One row of numbers for each text: shares of kinds of characters, repetition, lengths."""
    out = np.zeros((len(texts), N_FEATURES))
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "replace")
        words = text.split()
        n, m = max(1, len(raw)), max(1, len(words))
        hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        lines = text.split("\n")
        row = out[i]
        row[0] = np.log1p(len(words))
        row[1] = hist @ _UPPER / max(1, hist @ (_UPPER + _LOWER))
        row[2] = hist @ _DIGIT / n
        for k, marks in enumerate(_MARKS):
            row[3 + k] = min(1.0, 4 * sum(int(hist[c]) for c in marks) / n)
        row[11] = len(set(words)) / m
        row[12] = sum(map(str.__eq__, words, words[1:])) / m
        row[13] = min(n / m, 40) / 10
        row[14] = len(set(lines)) / len(lines)
        row[15] = np.log1p(len(lines)) - row[0]
        row[16] = row[11] * row[0]
        row[17] = (len(words) < 4) + 0.0
    return out


def bradley_terry(better: np.ndarray, worse: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Weights by Newton's method on the logistic loss of feature differences."""
    diff = better - worse
    w = np.zeros(diff.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        grad = diff.T @ (p - 1) / len(diff) + ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class QualityModel:
    def __init__(self, mean, scale, weights, shift):
        self.mean, self.scale, self.weights, self.shift = mean, scale, weights, shift

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale) @ self.weights + self.shift
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def cell_sums(rows: DataFrame, w: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Over classes and cells of scores: the rows' number, and sums of their scores, features and products of features, features shifted by ``mean`` and divided by ``scale``."""
    names = ["key", "part", "sums"]

    def batch_of(keys, sums):
        part = np.full(len(keys), TaskContext.get().partitionId())
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part), pa.array([x.tobytes() for x in sums], pa.binary())], names=names)

    def measured(batches):
        total = np.zeros((2 * CELLS, 2 + N_FEATURES + len(_I)))
        for batch in batches:
            z = (np.stack([batch.column(k + 1).to_numpy() for k in range(N_FEATURES)], axis=1) - mean) / scale
            raw = z @ w
            key = batch.column(0).to_numpy() * CELLS + np.clip(np.floor(raw * FINE) + CELLS // 2, 0, CELLS - 1).astype(np.int64)
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(key[order]) > 0)) if len(key) else []
            if len(starts):
                total[key[order][starts]] += np.add.reduceat(np.column_stack([np.ones(len(raw)), raw, z, z[:, _I] * z[:, _J]])[order], starts)
        keys = np.flatnonzero(total[:, 0])
        yield batch_of(keys, total[keys])

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                total[key] = total.get(key, 0) + np.frombuffer(data)
        yield batch_of(np.array(list(total), np.int64), total.values())

    kind = "key long, part long, sums binary"
    # in a fixed order, so that the same rows give the same sums
    got = rows.mapInArrow(measured, kind).repartition("key").sortWithinPartitions("key", "part").mapInArrow(added, kind).collect()
    out = np.zeros((2 * CELLS, 2 + N_FEATURES + len(_I)))
    for r in got:
        out[r["key"]] = np.frombuffer(r["sums"])
    return out.reshape(2, CELLS, -1)


def newton_step(sums: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    """What ``bradley_terry`` subtracts from the weights in a step, over all pairs of a row of class 1 and one of class 0."""
    bad, good = (x[x[:, 0] > 0] for x in sums)
    (m, xg, pg), (n, xb, pb) = ((x[:, 0], x[:, 2 : 2 + N_FEATURES], x[:, 2 + N_FEATURES :]) for x in (good, bad))
    p = 1 / (1 + np.exp(-np.clip(good[:, None, 1] / m[:, None] - bad[None, :, 1] / n[None], -30, 30)))
    pairs, v = m.sum() * n.sum(), p * (1 - p)
    grad = xg.T @ ((p - 1) @ n) - xb.T @ ((p - 1).T @ m)
    hess = np.zeros((len(w), len(w)))
    hess[_I, _J] = pg.T @ (v @ n) + pb.T @ (v.T @ m)
    hess += np.triu(hess, 1).T
    cross = xg.T @ v @ xb
    return np.linalg.solve((hess - cross - cross.T) / pairs + ridge * np.eye(len(w)), grad / pairs + ridge * w)


def ranked(scores: DataFrame, rank: int) -> float:
    """The value of ``raw`` that so many values stand before in order; nothing is sorted but the values close to it."""
    low, high, n, least, most = scores.agg(F.min("raw"), F.max("raw"), F.count("raw"), F.lit(0), F.lit(0)).first()
    before = 0
    while n > SORTED and low < high:
        inside = scores.where(F.col("raw").between(low, high))
        cell = F.least(F.floor((F.col("raw") - low) / ((high - low) / 1000)), F.lit(999))
        for _, n, least, most in sorted(inside.groupBy(cell.alias("cell")).agg(F.count("*"), F.min("raw"), F.max("raw")).collect()):
            if before + n > rank:
                break
            before += n
        low, high = least, most
    if low == high:
        return low
    return sorted(r["raw"] for r in scores.where(F.col("raw").between(low, high)).collect())[rank - before]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, ridge: float = 1e-3, steps: int = 40) -> QualityModel:
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sent = sendable(known)
    rows = docs.select("doc_id", "text").where("doc_id is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    if sent:
        rows = rows.join(F.broadcast(known), "doc_id").select("doc_id", "text")

    def measured(batches):
        forget()
        for batch in batches:
            texts = batch.column("text")
            x = np.concatenate([np.zeros((0, N_FEATURES)), *(features(texts_of(texts, a, b)) for a, b in small_batches(texts))])
            cols = {f"f{k}": x[:, k] for k in range(N_FEATURES)}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **cols})

    # features, not texts, meet labels that are too many to be sent
    names = [f"f{k}" for k in range(N_FEATURES)]
    found = rows.mapInArrow(measured, f"doc_id {kind}, " + ", ".join(f"{k} double" for k in names))
    found = materialize(found.join(F.broadcast(known) if sent else known, "doc_id").where("y in (0, 1)").select(F.col("y").cast("long").alias("y"), *names), "quality-features")
    none, one = np.zeros(N_FEATURES), np.ones(N_FEATURES)
    sums = cell_sums(found, none, none, one).sum(axis=1)
    if not sums[0, 0] or not sums[1, 0]:
        drop_table(found)
        return QualityModel(none, one, none, 0.0)
    n = sums[:, 0].sum()
    mean = sums[:, 2 : 2 + N_FEATURES].sum(axis=0) / n
    scale = np.sqrt(np.maximum(0, sums[:, 2 + N_FEATURES :].sum(axis=0)[_I == _J] / n - mean**2)) + 1e-6
    w = none
    for _ in range(steps):
        step = newton_step(cell_sums(found, w, mean, scale), w, ridge)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    w = np.round(w, 9)

    def scored(batches):
        for batch in batches:
            x = np.stack([batch.column(k + 1).to_numpy() for k in range(N_FEATURES)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(((x - mean) / scale) @ w)], names=["raw"])

    raw = materialize(found.mapInArrow(scored, "raw double"), "quality-scores")
    at = (n - 1) * sums[0, 0] / n
    low, high = (ranked(raw, int(k)) for k in (np.floor(at), np.ceil(at)))
    for table in (found, raw):
        drop_table(table)
    return QualityModel(mean, scale, w, np.log(threshold / (1 - threshold)) - (low + (high - low) * (at - np.floor(at))))


def score(docs: DataFrame, model: QualityModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and the carried columns of every row, one pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches):
        forget()
        for batch in batches:
            parts = [sent.value.scores(features(texts_of(batch.column(1), a, b))) for a, b in small_batches(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else [], pa.float64())], names=["doc_id", "score"])

    return carried(docs, ["doc_id", "text"], carry, scored, f"doc_id {kind}, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, held_out_of: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Learn from the labels outside the held-out fold, score every row."""
    model = fit(docs, labels.where(crc_mod("doc_id", held_out_of) != 0), threshold=threshold)
    held = (crc_mod("doc_id", held_out_of) == 0).alias("held_out")
    return score(docs, model, carry).select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *carry)
