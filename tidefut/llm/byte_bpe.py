"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The corpus's chunks (runs of text that no match of the pattern spans) are counted in Spark. The
commonest ones, as many as may be sent to all tasks, are dealt into blocks by hash, and the words
(matches of the pattern) of a block are laid out one after the other as bytes, each word
once, whatever its number of uses. An inverted index lists, for each rank, the places where two
neighbours join into the token of that rank. Ranks are taken in order; a merge is applied at
all its places, and only the two pairs beside a merged place change in the index. The ids
come back as one table of checked size. Chunks beyond it are replayed the same way in the
task that meets them, in blocks of its own; merges never cross words, so ids don't depend on blocks.

Whole texts are encoded, very long ones too; null and empty texts have no ids. Strings of special
tokens are ordinary text. Rows that repeat are encoded each. An empty table gives an empty
result. Ids are decoded again from the numbers alone. Columns other than doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from base64 import b64decode
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, kept, materialize, small_batches, texts_of

#: Chunks that are sent to all tasks, at most, and the characters of the longest of them: about 50 MB, 500 at the very most.
SENT_CHUNKS, LONGEST = 1_000_000, 64
#: Further chunks of that length that a worker remembers between batches; more, and longer ones, are encoded anew.
REMEMBERED = 150_000
#: Words that are replayed together.
BLOCK = 50_000


class Ranks:
    """A rank file: the token of each byte string, and the byte string of each token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.pairs: dict[int, int] = {}
        size = max(self.ranks.values(), default=0) + 1
        self.size = size
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)])
        self.of_pair = np.array([self.ranks.get(bytes([i, j]), -1) for i in range(256) for j in range(256)])
        self.names = [b"%d" % i for i in range(size)]

    def pair(self, a: int, b: int) -> int:
        """The rank of two neighbouring tokens together, or -1."""
        key = a * self.size + b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            found = self.pairs[key] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return found


def replay(words: list[bytes], table: Ranks) -> list[list[int]]:
    """The tokens of each word, by merges over all words at once."""
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)
    ids = table.of_byte[data].tolist()
    ends = np.cumsum([len(w) for w in words])
    last = ends[ends > 0] - 1
    follow = np.arange(1, n + 1)  # the next place of the same word, or n
    follow[last] = n
    follow = follow.tolist()
    before = np.arange(-1, n - 1)  # the previous place of the same word, or -1
    before[last[last + 1 < n] + 1] = -1
    before = before.tolist()
    ends = ends.tolist()
    pair, pairs, size = table.pair, table.pairs, table.size
    first = table.of_pair[data[:-1].astype(np.int64) * 256 + data[1:]] if n else np.zeros(0, np.int64)
    first[last[last + 1 < n]] = -1
    order = np.argsort(first, kind="stable")
    order = order[np.searchsorted(first[order], 0) :]
    cuts = np.flatnonzero(np.append(True, np.diff(first[order]) > 0)) if len(order) else []
    index: dict[int, list[int]] = {int(first[order[a]]): order[a:b].tolist() for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)}
    heap = list(index)
    heapify(heap)
    while heap:
        rank = heappop(heap)
        places = index.pop(rank, None)
        if places is None:
            continue
        places.sort()
        held = -1  # the word in which a lower rank came up: its other places wait
        for p in places:
            a = ids[p]
            if a < 0:
                continue
            q = follow[p]
            if q >= n or pairs.get(a * size + ids[q], -2) != rank and pair(a, ids[q]) != rank:
                continue
            if held >= 0 and before[p] >= 0:
                b = p
                while before[b] >= 0:
                    b = before[b]
                if b == held:
                    if rank in index:
                        index[rank].append(p)
                    else:
                        index[rank] = [p]
                        heappush(heap, rank)
                    continue
            ids[p], ids[q] = rank, -1
            after = follow[q]
            follow[p] = after
            if after < n:
                before[after] = p
                r = pairs.get(rank * size + ids[after])
                if r is None:
                    r = pair(rank, ids[after])
                if r >= 0:
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        heappush(heap, r)
                    if r < rank:
                        held = p
            b = before[p]
            if b >= 0:
                r = pairs.get(ids[b] * size + rank)
                if r is None:
                    r = pair(ids[b], rank)
                if r >= 0:
                    if r in index:
                        index[r].append(b)
                    else:
                        index[r] = [b]
                        heappush(heap, r)
                    if r < rank:
                        held = b
            if held >= 0:
                while before[held] >= 0:
                    held = before[held]
    out, start = [], 0
    for e in ends:
        out.append([t for t in ids[start:e] if t >= 0])
        start = e
    return out


class Encoder:
    """Ids of texts (4 bytes each, little-endian), a block at a time; ``known`` has the ids of common chunks."""

    def __init__(self, path: str, pattern: str, known: dict[str, bytes] | None = None):
        import regex

        self.table, self.pattern = Ranks(path), regex.compile(pattern)
        self.cut = regex.compile(r"\S(?= )")
        self.double = regex.compile(r"\s ")
        self.chunks, self.kept = known or {}, len(known or {})
        self.more: list[str] = []

    def split(self, text: str) -> list[str]:
        """Parts that no match of the pattern spans: cut before each space that follows no white space."""
        if not self.double.search(text):
            first, *rest = text.split(" ")
            parts = [" " + p for p in rest]
            return [first, *parts] if first else parts
        cuts = [m.end() for m in self.cut.finditer(text)]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True) if a < b]

    def learn(self, chunks: list[str]) -> None:
        """Replay the merges over the words of chunks that are not known yet."""
        parts = [self.pattern.findall(c) for c in chunks]
        fresh = list({w for ws in parts for w in ws})
        words: dict[str, bytes] = {}
        for i in range(0, len(fresh), BLOCK):
            block = fresh[i : i + BLOCK]
            ids = replay([w.encode("utf-8", "surrogatepass") for w in block], self.table)
            words.update(zip(block, (array("I", x).tobytes() for x in ids), strict=True))
        for c, ws in zip(chunks, parts, strict=True):
            self.chunks[c] = words[ws[0]] if len(ws) == 1 else b"".join(map(words.__getitem__, ws))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        new = list({c for s in split for c in s}.difference(self.chunks))
        self.learn(new)
        at = self.chunks.__getitem__
        out = [b"".join(map(at, s)) for s in split]
        for c in new:
            if len(c) > LONGEST:
                del self.chunks[c]
            else:
                self.more.append(c)
        if len(self.more) > REMEMBERED:
            for c in self.more:
                del self.chunks[c]
            self.more = []
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.table.tokens.__getitem__, ids))


class Sent:
    """What is sent to the tasks: the common chunks with their ids."""

    def __init__(self, path: str, pattern: str, chunks: pa.Array, ids: pa.Array):
        self.path, self.pattern, self.known = path, pattern, (chunks, ids)

    def encoder(self) -> Encoder:
        """One encoder for all tasks of a worker."""
        return kept(self, lambda: Encoder(self.path, self.pattern, dict(zip(*(x.to_pylist() for x in self.known), strict=True))))


def count_chunks(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(chunk, n) of chunks up to ``LONGEST`` over whole texts: counted per task first, then summed in the shuffle."""

    def counted(batches):
        split, held = Encoder(path, pattern).split, Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["chunk", "n"])

        for batch in batches:
            for a, b in small_batches(batch.column(0)):
                held.update(c for t in texts_of(batch.column(0), a, b) for c in split(t) if len(c) <= LONGEST)
                if len(held) > 300_000:
                    yield from rows()
                    held = Counter()
        yield from rows()

    return docs.select("text").mapInArrow(counted, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def sent_chunks(docs: DataFrame, path: str, pattern: str, most: int = SENT_CHUNKS) -> Sent:
    """The corpus's commonest chunks with their ids: all with a number of uses such that there are at most ``most``."""
    counts = materialize(count_chunks(docs, path, pattern), "bpe-chunks")
    short = counts.where("n > 1")
    # by sixteenths of powers of two: the table of numbers of uses is small, whatever the corpus
    step = F.floor(F.log2("n") * 16)
    least, total = None, 0
    for row in short.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += row["count"]
        if total > most:
            break
        least = row["step"]

    def replayed(batches):
        encoder, held = Encoder(path, pattern), []

        def rows() -> Iterator[pa.RecordBatch]:
            encoder.learn(held)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(list(map(encoder.chunks.__getitem__, held)), pa.binary())], names=["chunk", "ids"])

        for batch in batches:
            held += batch.column(0).to_pylist()
            if len(held) >= BLOCK:
                yield from rows()
                held, encoder.chunks = [], {}
        yield from rows()

    if least is None:
        drop_table(counts)
        return Sent(path, pattern, pa.array([], pa.string()), pa.array([], pa.binary()))
    # partitions of the counted table are blocks by hash
    found = short.where(step >= least).select("chunk").mapInArrow(replayed, "chunk string, ids binary").toArrow()
    drop_table(counts)
    return Sent(path, pattern, found.column("chunk").combine_chunks(), found.column("ids").combine_chunks())


def _encoded(docs: DataFrame, rank_path: str, pattern: str, make, columns: str) -> DataFrame:
    """doc_id and what ``make`` (encoder, ids of some texts) gives."""
    sent = docs.sparkSession.sparkContext.broadcast(sent_chunks(docs, rank_path, pattern))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]

    def coded(batches):
        encoder = sent.value.encoder()
        for batch in batches:
            for a, b in small_batches(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *make(encoder, encoder.encode(texts_of(batch.column(1), a, b)))], names=names)

    return docs.select("doc_id", "text").mapInArrow(coded, f"doc_id {kind}, {columns}")


def encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and the ids themselves."""

    def make(_, ids: list[bytes]) -> list[pa.Array]:
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))]

    return _encoded(docs, rank_path, pattern, make, "ids array<int>")


def encode_decode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, the number of ids, and digests of the ids and of the bytes that they are decoded to, in place of the ids."""

    def make(encoder: Encoder, ids: list[bytes]) -> list[pa.Array]:
        names = encoder.table.names
        count, ids_sha, text_sha = [], [], []
        for raw in ids:
            own = np.frombuffer(raw, "<u4").tolist()
            count.append(len(own))
            ids_sha.append(hashlib.sha256(b" ".join(map(names.__getitem__, own))).hexdigest())
            text_sha.append(hashlib.sha256(encoder.decode(own)).hexdigest())
        return [pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

    return _encoded(docs, rank_path, pattern, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(ids: DataFrame, rank_path: str) -> DataFrame:
    """doc_id and the bytes that the ids stand for; null has none."""
    kind = ids.schema["doc_id"].dataType.simpleString()

    def decoded(batches):
        tokens = Ranks(rank_path).tokens
        for batch in batches:
            data = [b"".join(map(tokens.__getitem__, x or [])) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "bytes"])

    return ids.select("doc_id", "ids").mapInArrow(decoded, f"doc_id {kind}, bytes binary")
