"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum, over all its segmentations into pieces, of the product of the
piece probabilities (forward algorithm); a text's is the product over its words. The piece
probabilities are learned by expectation maximisation over the word counts of all training
rows: expected counts come from a forward-backward pass over every segmentation. Words of
more than ``LINEAR`` characters are summed in logarithms, as their probabilities are too small
for floating point; no word is cut.

Words are runs of letters, lower-cased and marked at their start. Null texts and texts
without a letter get ``und`` with score 0, numbers and signs are no letters. Ties go to the
language that sorts first. Repeated rows count as often as they occur. With no labelled row,
and so for an empty training table, every text is ``und``; an empty table gives an empty
result. Very long texts are taken whole. Other columns of the input are ignored, whatever
their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK, WordTable, carried, crc_mod, drop_table, forget, kept, materialize, small_batches, texts_of

#: Longest word, in characters, whose segmentations are summed without logarithms.
LINEAR = 32
#: Probability of a single character that no piece covers.
UNKNOWN = 1e-7
#: Passes of expectation maximisation.
PASSES = 2
#: Log likelihoods are tempered by this power before they are compared as probabilities.
TEMPER = 0.25

#: Runs of word characters; most hold letters only, from the others the runs of letters are taken.
_WORDS = re.compile(r"[^\W\d_]+")
_STEP = 0x100000001B3 | 1
_SLOTS = 20


class Pieces:
    """The vocabulary as hash tables that are looked up for whole arrays of substrings."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.names = sorted(p for p in found if p and re.fullmatch(r"▁?(?:[^\W\d_]+)?", p))
        self.longest = max(map(len, self.names))
        hashes = np.zeros(len(self.names), np.uint64)
        for i, p in enumerate(self.names):
            h = 0
            for c in p:
                h = (h * _STEP + ord(c) + 1) & MASK
            hashes[i] = h
        self.hashes = np.append(hashes, np.uint64(0))
        self.size = len(self.names)  # also the row number of "no such piece"
        self.first, rest = self._place(np.arange(self.size), 0)
        self.second, self.rest = self._place(rest, 1)  # rest: none, for the public vocabularies here

    @staticmethod
    def _slot(h: np.ndarray, table: int) -> np.ndarray:
        return (h * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[table])) >> np.uint64(64 - _SLOTS)

    def _place(self, items: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """A slot for each item, the first come first; and the items without one."""
        slots = np.full(1 << _SLOTS, self.size, np.int32)
        at = self._slot(self.hashes[items], table)
        slots[at[::-1]] = items[::-1]
        return slots, items[slots[at] != items]

    def find(self, h: np.ndarray) -> np.ndarray:
        out = self.first[self._slot(h, 0)]
        out[self.hashes[out] != h] = self.size
        miss = out == self.size
        other = self.second[self._slot(h[miss], 1)]
        other[self.hashes[other] != h[miss]] = self.size
        out[miss] = other
        for i in self.rest:
            out[h == self.hashes[i]] = i
        return out

    def lattice(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Lengths (with the start mark), and for each piece length the piece that begins at each place."""
        marked = ["▁" + w for w in words]
        lens = np.fromiter(map(len, marked), np.int64, len(marked))
        width = int(lens.max()) if len(marked) else 1
        codes = np.zeros((len(marked), width), np.uint64)
        codes[np.arange(width) < lens[:, None]] = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        out, h = [], np.zeros_like(codes)
        for n in range(1, min(self.longest, width) + 1):
            live = width - n + 1
            h = h[:, :live] * np.uint64(_STEP) + codes[:, n - 1 :] + np.uint64(1)
            ok = np.arange(live) + n <= lens[:, None]
            idx = np.full((len(marked), live), self.size, np.int32)
            idx[ok] = self.find(h[ok])
            out.append(idx)
        return lens, out


def _weights(probs: np.ndarray) -> np.ndarray:
    """Probabilities with a last row for pieces that don't exist; that row counts for single characters only."""
    return np.vstack([probs, np.zeros((1, probs.shape[1]))])


def arcs(lattice: list[np.ndarray], none: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length over 1: words and pieces of the pieces there are, in order of their places, and where each place begins."""
    out = []
    for idx in lattice[1:]:
        place, word = np.nonzero(idx.T != none)
        out.append((word, idx[word, place], np.searchsorted(place, np.arange(idx.shape[1] + 1))))
    return out


def forward(lens: np.ndarray, lattice: list[np.ndarray], probs: np.ndarray) -> np.ndarray:
    """alpha[place, word, language]: the summed probability of the first ``place`` characters."""
    n, width, none = len(lens), lattice[0].shape[1], len(probs)
    w = np.vstack([probs, np.full((1, probs.shape[1]), UNKNOWN)])
    alpha = np.zeros((width + 1, n, probs.shape[1]))
    alpha[0] = 1
    longer = arcs(lattice, none)
    for start in range(width):
        own = alpha[start]
        alpha[start + 1] += own * w[lattice[0][:, start]]
        for k, (word, piece, first) in enumerate(longer, 2):
            if start + k <= width and first[start] < first[start + 1]:
                at = slice(first[start], first[start + 1])
                alpha[start + k, word[at]] += own[word[at]] * w[piece[at]]
    return alpha


def expected_counts(lens: np.ndarray, lattice: list[np.ndarray], probs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, over all segmentations of all words, for one language."""
    n, width, none = len(lens), lattice[0].shape[1], len(probs)
    w = np.append(probs, UNKNOWN)
    alpha = forward(lens, lattice, probs[:, None])[:, :, 0]
    scale = counts / np.maximum(alpha[lens, np.arange(n)], 1e-300)
    beta = np.zeros((width + 1, n))
    beta[lens, np.arange(n)] = 1
    longer, pieces, uses = arcs(lattice, none), [], []
    for start in range(width - 1, -1, -1):
        left = alpha[start] * scale
        path = w[lattice[0][:, start]] * beta[start + 1]
        beta[start] += path
        pieces.append(lattice[0][:, start])
        uses.append(left * path)
        for k, (word, piece, first) in enumerate(longer, 2):
            if start + k <= width and first[start] < first[start + 1]:
                at = slice(first[start], first[start + 1])
                path = w[piece[at]] * beta[start + k, word[at]]
                beta[start, word[at]] += path
                pieces.append(piece[at])
                uses.append(left[word[at]] * path)
    return np.bincount(np.concatenate(pieces), np.concatenate(uses), none + 1)[:none]


def long_steps(lens: np.ndarray, lattice: list[np.ndarray], probs: np.ndarray, last_first: bool = False) -> np.ndarray:
    """Logarithms of the summed probabilities up to each place of each word (or, from each place to its end)."""
    n, width = len(lens), lattice[0].shape[1]
    with np.errstate(divide="ignore"):
        w = np.log(_weights(probs))
    none, out = len(probs), np.full((n, width + 1, probs.shape[1]), -np.inf)
    if last_first:
        out[np.arange(n), lens] = 0
    else:
        out[:, 0] = 0
    for at in range(width - 1, -1, -1) if last_first else range(1, width + 1):
        total = out[:, at]
        for k in range(1, min(len(lattice), width - at if last_first else at) + 1):
            start = at if last_first else at - k
            idx = lattice[k - 1][:, start]
            p = w[idx]
            if k == 1:
                p = np.where(((idx == none) & (start < lens))[:, None], np.log(UNKNOWN), p)
            np.logaddexp(total, out[:, start + k if last_first else start] + p, out=total)
    return out


def long_counts(lens: np.ndarray, lattice: list[np.ndarray], probs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``expected_counts`` by logarithms."""
    n, none = len(lens), len(probs)
    alpha, beta = (long_steps(lens, lattice, probs[:, None], way)[:, :, 0] for way in (False, True))
    total = alpha[np.arange(n), lens]
    with np.errstate(divide="ignore"):
        w = np.log(np.append(probs, 0.0))
    out = np.zeros(none + 1)
    for start in range(lattice[0].shape[1]):
        for k in range(1, min(len(lattice), lattice[0].shape[1] - start) + 1):
            idx = lattice[k - 1][:, start]
            share = np.exp(alpha[:, start] + w[idx] + beta[:, start + k] - total)
            out += np.bincount(idx, np.where(idx < none, share, 0) * counts, none + 1)
    return out[:none]


def by_length(words: list[str], most: int = 20_000, cells: int = 600_000) -> Iterator[np.ndarray]:
    """Positions of words of like length, a block of at most ``cells`` characters (but one word at least) at a time."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    i = 0
    while i < len(order):
        j = min(i + most, len(order))
        while j > i + 1 and ((j - i) * (sizes[order[j - 1]] + 2) > cells or sizes[order[i]] <= LINEAR < sizes[order[j - 1]]):
            j = i + max(1, (j - i) // 2)
        yield order[i:j]
        i = j


def split_words(chunk: str) -> list[str]:
    """Runs of letters, in lower case."""
    low = chunk.lower()
    if low.isalpha():
        return [low]
    return [w for run in _WORDS.findall(low) for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def word_log_probs(words: list[str], pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), probs.shape[1]))
    for at in by_length(words):
        lens, lattice = pieces.lattice([words[i] for i in at])
        if lens.max() > LINEAR + 1:
            out[at] = long_steps(lens, lattice, probs)[np.arange(len(at)), lens]
        else:
            out[at] = np.log(np.maximum(forward(lens, lattice, probs)[lens, np.arange(len(at))], 1e-300))
    return out


def count_words(rows: DataFrame, label: str, text: str = "text") -> DataFrame:
    """(label, word, n) over whole texts: counted per task first, then summed in the shuffle."""

    def counted(batches):
        forget()
        held: dict = {}
        size, kind = 0, pa.string()
        for batch in batches:
            kind = batch.schema.field(0).type
            labels = batch.column(0).to_pylist()
            for a, b in small_batches(batch.column(1)):
                texts, long = texts_of(batch.column(1), a, b), {}
                for lab in set(labels[a:b]):
                    own = held.setdefault(lab, Counter())
                    size -= len(own)
                    mine = Counter(c for x, t in zip(labels[a:b], texts, strict=True) if x == lab for c in t.split())
                    long[lab] = Counter({c: n for c, n in mine.items() if len(c) > WordTable.LONGEST})
                    own.update({c: n for c, n in mine.items() if len(c) <= WordTable.LONGEST})
                    size += len(own)
                yield from _word_rows(long, kind)  # long chunks aren't held
                if size > 300_000:
                    yield from _word_rows(held, kind)
                    held, size = {}, 0
        yield from _word_rows(held, kind)

    kind = rows.schema[label].dataType.simpleString()
    got = rows.select(label, text).mapInArrow(counted, f"label {kind}, word string, n long")
    return got.groupBy("label", "word").agg(F.sum("n").alias("n"))


def _word_rows(held: dict, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for lab, own in held.items():
        words: Counter = Counter()
        for chunk, n in own.items():
            for w in split_words(chunk):
                words[w] += n
        names = list(words)
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"label": pa.array([lab] * len(part), kind), "word": part, "n": [words[w] for w in part]})


@lru_cache(maxsize=2)
def pieces_of(model_path: str) -> Pieces:
    """The vocabulary, once for all tasks of a worker."""
    return Pieces(model_path)


class LanguageModel:
    """``langs`` in order, and ``probs``: one column of piece probabilities for each."""

    def __init__(self, langs: list[str], probs: np.ndarray, prior: np.ndarray):
        self.langs, self.probs, self.prior = langs, probs, prior

    def words(self, pieces: Pieces) -> WordTable:
        """Log-likelihoods of the words met so far, for all tasks of a worker."""
        return kept(self, lambda: WordTable(lambda chunks: self.values(chunks, pieces)))

    def values(self, chunks: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Of each chunk between white space: the log-likelihood in each language, and the number of words."""
        split = [split_words(c) for c in chunks]
        flat = [w for s in split for w in s]
        sizes = np.fromiter(map(len, split), np.int32, len(chunks))
        names = list(set(flat))
        number = dict(zip(names, range(len(names)), strict=True))
        logs = word_log_probs(names, pieces, self.probs).astype(np.float32)
        own = logs[np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))]
        ends = np.cumsum(sizes)
        total = np.vstack([np.zeros((1, logs.shape[1])), np.cumsum(own, axis=0, dtype=float)])
        return (total[ends] - total[ends - sizes]).astype(np.float32), sizes


def fit(rows: DataFrame, model_path: str, lang: str = "lang", text: str = "text", passes: int = PASSES) -> LanguageModel:
    """Learn from all rows with a language. What reaches the driver is bounded by vocabulary times languages."""
    spark = rows.sparkSession
    rows = rows.where(F.col(lang).isNotNull())
    counts = materialize(count_words(rows, lang, text), "langid-words")
    totals = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    pieces = pieces_of(model_path)
    probs = np.full((pieces.size, max(1, len(langs))), 1.0 / pieces.size)
    for _ in range(passes if langs else 0):
        sent = spark.sparkContext.broadcast((langs, probs))

        def expect(batches, sent=sent):
            forget()
            langs, probs = sent.value
            own, total = pieces_of(model_path), np.zeros_like(probs)
            for batch in batches:
                labels = np.array(batch.column(0).to_pylist(), object)
                words = batch.column(1).to_pylist()
                n = batch.column(2).to_numpy().astype(float)
                for k, lab in enumerate(langs):
                    mine = np.flatnonzero(labels == lab)
                    w = [words[i] for i in mine]
                    for at in by_length(w):
                        lens, lattice = own.lattice([w[i] for i in at])
                        count = long_counts if lens.max() > LINEAR + 1 else expected_counts
                        total[:, k] += count(lens, lattice, probs[:, k], n[mine[at]])
            k, p = np.nonzero(total.T)
            yield pa.RecordBatch.from_pydict({"k": k.astype(np.int32), "p": p.astype(np.int32), "x": total[p, k]})

        found = counts.mapInArrow(expect, "k int, p int, x double").groupBy("k", "p").agg(F.sum("x").alias("x")).toPandas()
        raw = np.full_like(probs, 0.05)
        raw[found["p"], found["k"]] += found["x"]
        probs = raw / raw.sum(axis=0)
        sent.destroy()
    drop_table(counts)
    n = np.array([totals[k] for k in langs], float)
    return LanguageModel(langs, probs, np.log(n / n.sum()) if langs else np.zeros(1))


def predict(docs: DataFrame, model: LanguageModel, model_path: str, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, n_words and the carried columns of every row, one pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(LanguageModel(model.langs, model.probs, model.prior))
    kind = docs.schema[doc_id].dataType.simpleString()

    def scored(batches):
        own = sent.value
        table, names = own.words(pieces_of(model_path)), np.array([*own.langs, "und"], object)
        for batch in batches:
            preds, scores, words = [], [], []
            for a, b in small_batches(batch.column(1)):
                split = [t.split() for t in texts_of(batch.column(1), a, b)]
                at = table.ids([c for s in split for c in s])
                owner = np.repeat(np.arange(b - a), np.fromiter(map(len, split), np.int64, b - a))
                found, counts = (v[at] for v in table.values)
                n = np.bincount(owner, counts, b - a).astype(np.int64)
                logs = np.stack([np.bincount(owner, found[:, k], b - a) for k in range(found.shape[1])], axis=1) + own.prior
                best = logs.argmax(axis=1)
                top = 1 / np.exp(TEMPER * (logs - logs.max(axis=1, keepdims=True))).sum(axis=1)
                none = (n == 0) | (not own.langs)
                preds.append(names[np.where(none, len(own.langs), best)])
                scores.append(np.where(none, 0.0, top))
                words.append(n)
            cols = [np.concatenate(x) if x else [] for x in (preds, scores, words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, (pa.string(), pa.float64(), pa.int64()))], names=["doc_id", "lang_pred", "score", "n_words"])

    return carried(docs, [doc_id, text], carry, scored, f"doc_id {kind}, lang_pred string, score double, n_words long")


def language_id(docs: DataFrame, model_path: str, held_out_of: int = 4, held_out: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """Learn from the rows outside the held-out fold, predict every row."""
    fold = crc_mod("doc_id", held_out_of)
    model = fit(docs.where(fold != held_out), model_path)
    out = predict(docs, model, model_path, carry=carry)
    return out.select("doc_id", (crc_mod("doc_id", held_out_of) == held_out).alias("held_out"), "lang_pred", "score", "n_words", *carry)
