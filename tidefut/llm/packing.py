"""Sequence packing as vector bin packing with the dot-product heuristic.

A sequence has three limits: tokens, segments (pieces of examples) and loss-bearing tokens.
Of the waiting pieces, the one whose demand has the largest dot product with what is left of
the open sequence, each limit scaled to 1, goes in next; where none fits whole, the best one
is cut to fill the sequence exactly. Examples as long as a sequence fill sequences of their
own first. Each task packs its own rows, with a bounded number of waiting pieces, so there
is no shuffle; what is left at its end, under one sequence, is cut into sequences whose
lengths are powers of two, which need no padding.

The tokens of an example's prompt (a text column, ``prompt``), or its first ``n_prompt`` ones, bear no
loss; without either column all tokens do. Null texts count as empty and hold the end mark only. Very
long texts are cut over as many sequences as they need. Rows that repeat an identifier or a text are packed as
often as they occur; of pieces with equal dot products the one that came first goes in. An empty table gives no
piece. Columns other than these are ignored, whatever their names. Sequence ids are unique over all
tasks: task number times 2^33 plus a counter.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, small_batches, texts_of

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 2048, 128, 2048
#: Pieces that wait for a sequence, in each task.
WAITING = 256
#: The id after each document.
END_ID = 1
#: Chunks, and words, that are remembered between batches, and the characters of the longest of them: 150 MB at the very most.
REMEMBERED, LONGEST = 400_000, 64

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_loss long"
_ODD_SPACE = "\x1c\x1d\x1e\x1f"


class WordEncoder:
    """Ids of whole texts (4 bytes each, little-endian) by any tokenizer file.

    One that composes, lower-cases and splits as ``STEPS`` says never joins across white space. Then each distinct chunk between white space is encoded once, from the ids of its words, and
    each distinct word once, by the tokenizer's merge model. Chunks beyond the Latin letters
    go through the whole tokenizer, and so do all texts with another tokenizer.
    """

    STEPS = ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x for part in ("normalizer", "pre_tokenizer") for x in (spec.get(part) or {}).get("normalizers" if part == "normalizer" else "pretokenizers", [])]
        known = [x["type"] for x in steps] == self.STEPS and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        known = known and steps[3]["invert"] and steps[3]["behavior"] == "Removed" and not steps[4]["add_prefix_space"] and not steps[4]["use_regex"]
        self.by_words = bool(known) and not spec.get("post_processor")
        self.pattern = regex.compile(steps[3]["pattern"]["Regex"]) if self.by_words else None
        self.other = re.compile("[^\x20-\x7e\u00a1-\u024f]|<\\|")
        # the printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, the others from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.stand_in = {i: i if i in plain else next(rest) for i in range(256)}
        self.id_bytes = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.known = Chunks(self.chunk)
        self.words: dict[str, bytes] = {}

    def one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.stand_in)
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(mapped)])

    def split(self, chunk: str) -> list[str]:
        if chunk.isascii():
            return [chunk.lower()] if chunk.isalpha() else self.pattern.findall(chunk.lower())
        return self.pattern.findall(unicodedata.normalize("NFC", chunk).lower())

    def chunk(self, c: str) -> bytes:
        if self.other.search(c):
            return self.one(c)
        words, ids = self.words, []
        for w in self.split(c):
            got = words.get(w)
            if got is None:
                got = self.word(w)
                if len(w) <= LONGEST:
                    words[w] = got
            ids.append(got)
        return ids[0] if len(ids) == 1 else b"".join(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return [self.one(t) for t in texts]
        if len(self.words) > REMEMBERED:
            self.words = {}
        at = self.known.__getitem__
        return [self.one(t) if any(c in t for c in _ODD_SPACE) else b"".join(map(at, t.split())) for t in texts]


class Chunks(dict):
    """Ids of chunks, each encoded when it is first asked for; long ones are not remembered."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, c: str) -> bytes:
        ids = self.encode(c)
        if len(self) > REMEMBERED:
            self.clear()
        if len(c) <= LONGEST:
            self[c] = ids
        return ids


def encoder_of(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker: what it remembers stays useful."""
    return kept(("packing", path), lambda: WordEncoder(path))


class Packer:
    """Places examples, one at a time; ``rows`` holds the finished pieces."""

    def __init__(self, first_id: int, max_tokens: int, max_segments: int, max_loss: int, waiting: int):
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.next_id, self.waiting = first_id, waiting
        self.rows: list[tuple] = []
        self.items: list[list] = []  # [key, ids, start, prompt]
        self.demand = np.zeros((0, 3))

    @staticmethod
    def loss(start: int, end: int, prompt: int) -> int:
        return max(0, end - max(start, prompt))

    def longest(self, start: int, end: int, prompt: int, tokens: int, loss: int) -> int:
        """Where a piece from ``start`` must end to stay within both limits."""
        return min(end, start + tokens, max(start, prompt) + loss)

    def emit(self, pieces: list[tuple]) -> None:
        """One sequence."""
        offset = 0
        for key, ids, start, end, prompt in pieces:
            crc = zlib.crc32(memoryview(ids)[4 * start : 4 * end])
            self.rows.append((key, start, end - start, crc, len(ids) // 4, self.next_id, offset, self.loss(start, end, prompt)))
            offset += end - start
        self.next_id += 1

    def add(self, key, ids: bytes, prompt: int) -> None:
        n, start = len(ids) // 4, 0
        tokens, loss = int(self.limits[0]), int(self.limits[2])
        while n - start >= tokens:
            end = self.longest(start, n, prompt, tokens, loss)
            if end - start < tokens:
                break  # its loss-bearing tokens must be spread over sequences
            self.emit([(key, ids, start, end, prompt)])
            start = end
        if start < n:
            self.items.append([key, ids, start, prompt])
        if len(self.items) >= self.waiting:
            self.pack(self.waiting // 2)

    def pack(self, leave: int) -> None:
        """Close sequences until at most ``leave`` pieces wait."""
        d = np.array([[len(ids) // 4 - s, 1, self.loss(s, len(ids) // 4, p)] for _, ids, s, p in self.items], float).reshape(-1, 3) / self.limits
        live = np.ones(len(d), bool)
        while live.sum() > leave:
            left, pieces = np.ones(3), []
            while live.any() and round(left[0] * self.limits[0]) > 0 and left[1] > 1e-9:
                dot = np.where(live, d @ left, -1.0)
                fits = live & (d <= left + 1e-9).all(axis=1)
                if fits.any():
                    i = int(np.where(fits, dot, -1.0).argmax())
                    key, ids, start, prompt = self.items[i]
                    end = len(ids) // 4
                    live[i] = False
                    left = left - d[i]
                else:
                    tokens, loss = int(round(left[0] * self.limits[0])), int(round(left[2] * self.limits[2]))
                    for i in np.argsort(-dot, kind="stable")[: int(live.sum())].tolist():
                        key, ids, start, prompt = self.items[i]
                        end = self.longest(start, len(ids) // 4, prompt, tokens, loss)
                        if end > start:
                            break
                    else:
                        break
                    used = np.array([end - start, 1, self.loss(start, end, prompt)]) / self.limits
                    self.items[i][2] = end
                    d[i] = d[i] - used
                    d[i, 1] = 1 / self.limits[1]
                    left = left - used
                pieces.append((key, ids, start, end, prompt))
            self.close(pieces)
        self.items = [x for x, k in zip(self.items, live, strict=True) if k]

    def close(self, pieces: list[tuple]) -> None:
        """Full sequences go out as they are; shorter ones are cut into powers of two."""
        size = sum(e - s for _, _, s, e, _ in pieces)
        if size == self.limits[0]:
            return self.emit(pieces)
        rest = [list(p) for p in pieces]
        while size:
            want = 1 << (size.bit_length() - 1)
            size -= want
            own = []
            while want:
                key, ids, start, end, prompt = rest[0]
                cut = min(end, start + want)
                own.append((key, ids, start, cut, prompt))
                want -= cut - start
                if cut == end:
                    rest.pop(0)
                else:
                    rest[0][2] = cut
            self.emit(own)


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, waiting: int = WAITING, n_prompt: str | None = None, prompt: str | None = None) -> DataFrame:
    """doc_id and the columns of SCHEMA: one row for each piece of the prompt's ids, the text's and the end mark."""
    field = docs.schema["doc_id"]
    count = (F.coalesce(F.col(n_prompt), F.lit(0)) if n_prompt else F.lit(0)).cast("long")
    rows = docs.select("doc_id", "text", count.alias("n_prompt"), (F.col(prompt) if prompt else F.lit(None)).cast("string").alias("prompt"))
    names = ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))]
    end = np.array([END_ID], "<u4").tobytes()

    def packed(batches):
        encoder = encoder_of(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 33, max_tokens, max_segments, max_loss, waiting)
        kind = None

        def out() -> Iterator[pa.RecordBatch]:
            if packer.rows:
                cols = list(zip(*packer.rows, strict=True))
                packer.rows = []
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            keys, prompts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b in small_batches(batch.column(1)):
                before = encoder.encode(texts_of(batch.column(3), a, b)) if prompt else [b""] * (b - a)
                for key, first, ids, n in zip(keys[a:b], before, encoder.encode(texts_of(batch.column(1), a, b)), prompts[a:b], strict=True):
                    packer.add(key, first + ids + end, len(first) // 4 + n)
                yield from out()
        packer.pack(0)
        yield from out()

    return rows.mapInArrow(packed, f"doc_id {field.dataType.simpleString()}, {SCHEMA}")
