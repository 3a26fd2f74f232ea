"""What the registered queries return, against the public libraries and plain loops."""

import hashlib
import math
import re
from collections import Counter

import pytest

from tidefut.llm import byte_bpe, language_id, queries
from tidefut.llm.queries import vocabulary

from .test_brute_force import check_pieces

SF = "/root/testdata/sf0.001"


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def test_byte_bpe_digests(spark):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.Ranks(vocabulary("byte_bpe_50k.tiktoken")).ranks
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode()))
    got = queries.op10_byte_bpe(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_packed_conversations(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    asked: dict = {}
    for r in turns:
        if r.role is not None and r.role != "assistant" and r.text is not None:
            asked[r.conv_id, r.turn + 1] = max(r.text, asked.get((r.conv_id, r.turn + 1), ""))
    ids = {f"{r.conv_id}:{r.turn}": [x for t in (asked.get((r.conv_id, r.turn)), r.text) for x in library.encode(t or "", add_special_tokens=False).ids] for r in turns if r.role == "assistant"}
    check_pieces(queries.packed_conversations(spark, SF).collect(), ids, (2048, 4, 1024))


class PlainLanguages:
    """The model by plain sums over the pieces of each word, one language and one word at a time."""

    def __init__(self, rows):
        self.names = {p for p in language_id.pieces_of(vocabulary("piece_bpe_32k.model")).names if p}
        self.longest = max(map(len, self.names))
        counts: dict = {}
        for text, lang in rows:
            counts.setdefault(lang, Counter()).update(self.words(text))
        self.langs = sorted(counts)
        total = sum(sum(c.values()) for c in counts.values())
        self.prior = {k: math.log(sum(c.values()) / total) for k, c in counts.items()}
        self.probs = {k: self.learned(c) for k, c in counts.items()}

    @staticmethod
    def words(text):
        return re.findall(r"[^\W\d_]+", (text or "").lower())

    def steps(self, word, probs):
        """(start, end, piece, probability) of every piece that a segmentation can hold; an unknown character is one, too."""
        w = "▁" + word
        for a in range(len(w)):
            for b in range(a + 1, min(len(w), a + self.longest) + 1):
                if w[a:b] in self.names:
                    yield a, b, w[a:b], probs(w[a:b])
                elif b == a + 1:
                    yield a, b, None, language_id.UNKNOWN

    def sums(self, word, probs):
        steps, n = list(self.steps(word, probs)), len(word) + 1
        ahead, behind = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for a, b, _, p in steps:
            ahead[b] += ahead[a] * p
        for a, b, _, p in sorted(steps, reverse=True, key=lambda s: s[0]):
            behind[a] += p * behind[b]
        return steps, ahead, behind

    def learned(self, counts):
        size, probs = len(self.names), {}
        rest = 1 / size
        for _ in range(language_id.PASSES):
            found: Counter = Counter()
            for word, n in counts.items():
                steps, ahead, behind = self.sums(word, lambda p, probs=probs, rest=rest: probs.get(p, rest))
                for a, b, piece, p in steps:
                    if piece is not None:
                        found[piece] += n * ahead[a] * p * behind[b] / ahead[-1]
            whole = 0.05 * size + sum(found.values())
            probs, rest = {p: (0.05 + x) / whole for p, x in found.items()}, 0.05 / whole
        return probs, rest

    def predict(self, text):
        words = self.words(text)
        if not words:
            return "und", 0.0
        logs = []
        for k in self.langs:
            probs, rest = self.probs[k]
            logs.append(self.prior[k] + sum(math.log(self.sums(w, lambda p: probs.get(p, rest))[1][-1]) for w in words))  # noqa: B023
        best = max(logs)
        return self.langs[logs.index(best)], 1 / sum(math.exp(language_id.TEMPER * (x - best)) for x in logs)


@pytest.fixture(scope="module")
def small_corpus():
    stems = {"en": "the tide and moon with stone", "de": "der mond und die flut mit stein", "fr": "la lune et le flot avec pierre"}
    rows = []
    for i in range(60):
        lang = sorted(stems)[i % 3]
        words = stems[lang].split()
        rows.append((i, " ".join(words[(i * 7 + k * k) % len(words)] for k in range(3 + i % 5)), lang if i % 11 else None))
    return [*rows, (100, "the mond 12 Flut", None), (101, None, "en"), (102, "12 !!", "de"), (103, "ünß ß", None), (104, "the flot", "en")]


def test_languages_by_plain_sums(spark, small_corpus):
    import zlib

    docs = spark.createDataFrame(small_corpus, "doc_id long, text string, lang string").repartition(3)
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in small_corpus}
    plain = PlainLanguages([(t, lang) for i, t, lang in small_corpus if lang is not None and not held[i]])
    got = {r.doc_id: r for r in language_id.language_id(docs, vocabulary("piece_bpe_32k.model")).collect()}
    assert len(got) == len(small_corpus)
    for i, text, _ in small_corpus:
        lang, score = plain.predict(text)
        assert (got[i].held_out, got[i].lang_pred) == (held[i], lang)
        assert got[i].score == pytest.approx(score, abs=1e-4)
