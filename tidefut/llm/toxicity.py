"""Toxicity by class-conditional Kneser-Ney models.

Two character models of words, one for the rows labelled toxic and one for the others. At the
highest order each has its own counts; below it, both back off to one shared distribution, the
full Kneser-Ney recursion down to single characters over the continuation counts of both classes
together (in how many different contexts an n-gram occurs, not how often). The discount of each
order comes from its counts of counts. A rare expression thus gets nearly the same probability
from both models, and only what one class really uses more moves the score.

Most words of a toxic text are ordinary ones, so its likelihood of a word is a mixture: ``SHARE``
of the toxic model and the rest of the ordinary one. A text's toxic and ordinary log-likelihoods
are compared over the whole text and normalised by its length: their difference per character,
and per square root of the characters (its noise grows with that root). A logistic curve on these two
numbers, fitted on a bounded sample of other labelled rows (``max_rows``), gives the published score.

All labelled training rows outside that sample are counted. Labels of up to ``SENT_BYTES`` go to the
tasks, so that only words of labelled texts move; more are joined by a shuffle of the texts. Models of up
to ``SENT_NGRAMS`` n-grams (12 bytes each) are sent to the tasks as well; larger ones stay in
Spark: the documents' words are counted, the distinct words' n-grams joined with the models, and the
sums come back by joins. Both ways give the same numbers up to rounding.

Null texts count as empty and get a score too. Very long texts are taken whole. Null labels are
left out; of repeated labels of one document the largest counts. Rows that repeat an identifier
are scored by their own texts. With only one class all scores are 0.5 or less. An empty table gives
an empty result; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, crc_mod, drop_table, kept, materialize, mix64, sendable, small_batches, texts_of
from .language_id import by_length, count_words, split_words

ORDER = 5
#: Share of toxic words in a toxic text.
SHARE = 0.03
MAX_ROWS = 20_000
SENT_NGRAMS = 6_000_000

_PAD = "^" * (ORDER - 1)
_STEP = np.uint64(0x100000001B3)


def ngram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the characters of ``word$``: which there are, and hashes of the n-gram that ends at each and of its context."""
    marked = [_PAD + w + "$" for w in words]
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    width = int(lens.max()) if marked else ORDER
    codes = np.zeros((len(marked), width), np.uint64)
    codes[np.arange(width) < lens[:, None]] = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    h, live = np.zeros((len(marked), width - ORDER + 1), np.uint64), width - ORDER + 1
    for k in range(ORDER - 1):
        h = h * _STEP + codes[:, k : k + live] + np.uint64(1)
    return np.arange(live) < lens[:, None] - ORDER + 1, mix64(h * _STEP + codes[:, ORDER - 1 :] + np.uint64(1), 1), mix64(h, 2)


def mixed(ratio: np.ndarray) -> np.ndarray:
    """Log ratio of the mixture to the ordinary model, for a word's log ratio of the toxic to the ordinary model."""
    return np.logaddexp(np.log1p(-SHARE), np.log(SHARE) + ratio)


class ToxicModel:
    """Log ratios of the two models: for seen n-grams, and for contexts where both back off."""

    def __init__(self, grams, ratios, contexts, backoffs):
        self.grams, self.ratios, self.contexts, self.backoffs = grams, ratios, contexts, backoffs

    def words(self) -> WordTable:
        """What is known of the words met so far, for all tasks of a worker."""
        return kept(self, lambda: WordTable(self.values))

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(x.shape, bool), np.zeros(x.shape, np.float32)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return keys[at] == x, values[at]

    def word_ratios(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for at in by_length(words):
            live, grams, contexts = ngram_hashes([words[i] for i in at])
            total, rest = np.zeros(grams.shape), np.zeros(live.sum())
            seen, ratio = self._find(self.grams, self.ratios, grams[live])
            known, back = self._find(self.contexts, self.backoffs, contexts[live][~seen])
            rest[seen] = ratio[seen]
            rest[~seen] = np.where(known, back, 0)
            total[live] = rest
            out[at] = total.sum(axis=1)
        return out

    def values(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each chunk between white space: the difference of log-likelihoods, and the characters."""
        split = [split_words(c) for c in chunks]
        flat = [w for s in split for w in s]
        names = list(set(flat))
        number = dict(zip(names, range(len(names)), strict=True))
        at = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        owner = np.repeat(np.arange(len(chunks)), np.fromiter(map(len, split), np.int64, len(split)))
        ratio = np.bincount(owner, mixed(self.word_ratios(names))[at], len(chunks))
        size = np.bincount(owner, np.fromiter((len(w) + 1 for w in names), float, len(names))[at], len(chunks))
        return ratio, size


def features(ratio: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The differences per character, and per square root of the characters."""
    size = np.maximum(size, 1)
    return np.stack([ratio / size, ratio / np.sqrt(size)], axis=1)


def count_ngrams(words: DataFrame) -> DataFrame:
    """(gram, t, o): uses of each n-gram in toxic and in other rows; each word's n-grams are made once."""
    one = words.groupBy("word").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("label") == 1, 0).otherwise(F.col("n"))).alias("o"))
    return one.select(F.explode(word_ngrams(F.col("word"))).alias("gram"), "t", "o").groupBy("gram").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def word_ngrams(word):
    """All n-grams of ``word$`` with its padding, as often as they occur."""
    padded = F.concat(F.lit(_PAD), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.char_length(word) + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))


def discount(counts: DataFrame, column: str) -> float:
    """From the counts of counts; the usual value where a table is too small to tell."""
    one, two = counts.agg(F.count_if(F.col(column) == 1), F.count_if(F.col(column) == 2)).first()
    return one / (one + 2 * two) if one and two else 0.75


def shared_backoff(grams: DataFrame) -> DataFrame:
    """(gram, p) of the highest order but one: the recursion over continuation counts of both classes."""
    levels, cur = [], grams.select("gram")
    for k in range(ORDER - 1, 0, -1):
        cur = materialize(cur.groupBy(F.expr(f"right(gram, {k})").alias("gram")).agg(F.count("*").alias("n")), "toxic-order")
        levels.append((k, cur))
    p = None
    for k, level in reversed(levels):
        d = discount(level, "n")
        if p is None:
            total, kinds = level.agg(F.sum("n"), F.count("*")).first()
            below = F.lit(1.0) / (kinds or 1)
            rows = level.withColumns({"total": F.lit(total or 1), "kinds": F.lit(kinds), "below": below})
        else:
            rows = level.withColumns({"ctx": F.expr(f"left(gram, {k - 1})"), "rest": F.expr(f"right(gram, {k - 1})")})
            context = level.groupBy(F.expr(f"left(gram, {k - 1})").alias("ctx")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
            rows = rows.join(context, "ctx").join(p.select(F.col("gram").alias("rest"), F.col("p").alias("below")), "rest")
        p = rows.select("gram", (F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total") + d * F.col("kinds") / F.col("total") * F.col("below")).alias("p"))
        p = materialize(p, "toxic-backoff")
    for _, level in levels:
        drop_table(level)
    return p


def log_ratios(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, ratio) and (context, ratio): the toxic to the ordinary model where the n-gram is seen, and where only its context is."""
    dt, do = (discount(grams.where(F.col(c) > 0), c) for c in "to")
    ctx = F.expr(f"left(gram, {ORDER - 1})").alias("ctx")
    context = grams.groupBy(ctx).agg(F.sum("t").alias("nt"), F.sum("o").alias("no"), F.count_if(F.col("t") > 0).alias("kt"), F.count_if(F.col("o") > 0).alias("ko"))
    lam = lambda d, k, n: F.when(F.col(n) > 0, d * F.col(k) / F.col(n)).otherwise(1.0)
    context = materialize(context.withColumns({"lt": lam(dt, "kt", "nt"), "lo": lam(do, "ko", "no")}), "toxic-contexts")
    below = shared_backoff(grams).select(F.col("gram").alias("rest"), "p")
    full = grams.withColumns({"ctx": ctx, "rest": F.expr(f"right(gram, {ORDER - 1})")}).join(context, "ctx").join(below, "rest")
    own = lambda d, n, total, back: F.when(F.col(total) > 0, F.greatest(F.col(n) - d, F.lit(0.0)) / F.col(total)).otherwise(0.0) + F.col(back) * F.col("p")
    top = full.select("gram", F.log(own(dt, "t", "nt", "lt") / own(do, "o", "no", "lo")).alias("ratio"))
    return top, context.select(F.col("ctx").alias("gram"), F.log(F.col("lt") / F.col("lo")).alias("ratio"))


def _collect(table: DataFrame, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order and their log ratios, of all rows of a table of checked size."""

    def hashed(batches):
        for batch in batches:
            codes = np.frombuffer("".join(batch.column(0).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length).astype(np.uint64)
            h = np.zeros(len(codes), np.uint64)
            for k in range(length):
                h = h * _STEP + codes[:, k] + np.uint64(1)
            yield pa.RecordBatch.from_arrays([pa.array(mix64(h, seed).view(np.int64)), batch.column(1)], names=["h", "ratio"])

    got = table.select("gram", F.col("ratio").cast("float").alias("ratio")).mapInArrow(hashed, "h long, ratio float").toArrow()
    keys = got.column("h").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got.column("ratio").to_numpy()[order]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights, the last one constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = ridge * np.append(w[:-1], 0) / max(1, len(x))
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, x.T @ (p - y) + len(x) * pull)
    return w


def differences(rows: DataFrame, key: str, model: ToxicModel) -> DataFrame:
    """``key``, ratio and size of every row: one pass, no shuffle."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema[key].dataType.simpleString()

    def measured(batches):
        table = sent.value.words()
        for batch in batches:
            ratios, sizes = [], []
            for a, b in small_batches(batch.column(1)):
                split = [t.split() for t in texts_of(batch.column(1), a, b)]
                at = table.ids([c for s in split for c in s])
                owner = np.repeat(np.arange(b - a), np.fromiter(map(len, split), np.int64, b - a))
                ratio, size = (np.bincount(owner, v[at], b - a) for v in table.values)
                ratios.append(ratio)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x) if x else [], pa.float64()) for x in (ratios, sizes))], names=[key, "ratio", "size"])

    return rows.select(key, "text").mapInArrow(measured, f"`{key}` {kind}, ratio double, size double")


def joined_differences(rows: DataFrame, key: str, top: DataFrame, low: DataFrame) -> DataFrame:
    """The same by joins, for models too large to send: words are counted by row, and the models meet distinct words only."""
    numbered = materialize(rows.select(F.monotonically_increasing_id().alias("row_no"), F.col(key).alias("row_key"), "text"), "toxic-rows")
    counts = materialize(count_words(numbered, "row_no"), "toxic-row-words")
    grams = counts.select("word").distinct().select("word", F.explode(word_ngrams(F.col("word"))).alias("gram"))
    uses = grams.groupBy("word", "gram").agg(F.count("*").alias("uses")).withColumn("ctx", F.expr(f"left(gram, {ORDER - 1})"))
    known = uses.join(top, "gram", "left").join(low.select(F.col("gram").alias("ctx"), F.col("ratio").alias("back")), "ctx", "left")
    ratio = known.groupBy("word").agg(F.sum(F.col("uses") * F.coalesce("ratio", "back", F.lit(0.0))).alias("r"))
    mix = F.greatest(F.lit(np.log1p(-SHARE)), np.log(SHARE) + F.col("r"))
    mix = mix + F.log1p(F.exp(-F.abs(F.lit(np.log1p(-SHARE)) - np.log(SHARE) - F.col("r"))))
    words = ratio.select("word", mix.alias("m"))
    sums = counts.join(words, "word").groupBy(F.col("label").alias("row_no")).agg(F.sum(F.col("n") * F.col("m")).alias("ratio"), F.sum(F.col("n") * (F.char_length("word") + 1)).cast("double").alias("size"))
    out = numbered.select("row_no", "row_key").join(sums, "row_no", "left")
    return out.select(F.col("row_key").alias(key), F.coalesce("ratio", F.lit(0.0)).alias("ratio"), F.coalesce("size", F.lit(0.0)).alias("size"))


class Toxicity:
    """The fitted models, sent to the tasks or kept as tables, and the curve."""

    def __init__(self, top: DataFrame, low: DataFrame, sent_ngrams: int):
        self.top, self.low = materialize(top, "toxic-ngrams"), low
        small = self.top.count() <= sent_ngrams
        self.model = ToxicModel(*_collect(self.top, ORDER, 1), *_collect(low, ORDER - 1, 2)) if small else None
        self.weights = np.array([0.0, 0.0, -1e-9])

    def differences(self, rows: DataFrame, key: str) -> DataFrame:
        return differences(rows, key, self.model) if self.model else joined_differences(rows, key, self.top, self.low)

    def score(self, rows: DataFrame, key: str) -> DataFrame:
        """``key`` and score, 0 to 1."""
        a, b, c = (float(w) for w in self.weights)
        size = F.greatest("size", F.lit(1.0))
        x = a * F.col("ratio") / size + b * F.col("ratio") / F.sqrt(size) + c
        return self.differences(rows, key).select(key, (1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, sent_ngrams: int = SENT_NGRAMS) -> Toxicity:
    """Fit the curve on a quarter of the labelled rows, ``max_rows`` at most, and count n-grams on all others."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = materialize(known, "toxic-labels")
    curve_fold = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    sample = materialize(known.where(curve_fold).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "toxic-sample")
    rest = known.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti")  # at most max_rows rows are sent
    texts = docs.select("doc_id", "text")
    train = texts.join(F.broadcast(rest) if sendable(rest) else rest, "doc_id")
    words = materialize(count_words(train, "y"), "toxic-words")
    grams = materialize(count_ngrams(words), "toxic-grams")
    drop_table(words)
    fitted = Toxicity(*log_ratios(grams), sent_ngrams)
    drop_table(grams)
    got = fitted.differences(texts.join(F.broadcast(sample), "doc_id"), "y").toPandas().sort_values(["y", "ratio", "size"]).to_numpy(float)
    y, x = got[:, 0], features(got[:, 1], got[:, 2])
    if (y == 1).any() and (y == 0).any():
        fitted.weights = logistic(x, y)
    return fitted


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, held_out_of: int = 5) -> DataFrame:
    """Learn from the labels outside the held-out fold, score every row."""
    fitted = fit(docs, labels.where(crc_mod("doc_id", held_out_of) != 0))
    held = (crc_mod("doc_id", held_out_of) == 0).alias("held_out")
    return fitted.score(docs, "doc_id").select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
