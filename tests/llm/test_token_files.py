"""Token files against the library's ids, and the code of their boundaries against plain numbers."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefut.llm import queries, token_files
from tidefut.llm.elias_fano import EliasFano, encode
from tidefut.llm.queries import vocabulary
from tidefut.sources.folders import new_path

WORDS = vocabulary("word_bpe_49k.json")
CLASHES = "start long, n_tokens string, tie string, salt string, part long, body binary"


def library_ids(texts, end=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


@pytest.mark.parametrize("most", [0, 1, 1000, 2**40, 2**62])
def test_coded_numbers(most):
    rng = random.Random(most)
    for m in (0, 1, 2, 255, 256, 257, 1000):
        v = np.sort(np.array([rng.randint(-most if m % 2 else 0, most) for _ in range(m)], np.int64))
        coded = EliasFano(b"ab" + encode(v) + b"c", 2)
        assert len(coded) == m and coded.size == len(encode(v)) and (coded.values() == v).all()
        some = np.array([rng.randrange(m) for _ in range(min(m, 30))], np.int64)
        assert (coded.select(some) == v[some]).all()


def test_boundaries_take_little_space():
    v = np.cumsum(np.random.default_rng(1).integers(1, 1500, 50_000))
    assert 8 * len(encode(v)) / len(v) < np.log2(v[-1] / len(v)) + 2.2


TEXTS = [(5, "Tide and MOON, over the sea"), (5, "another text"), (5, "another text"), (None, None), (None, "no name"), (-3, "below zero é́ ß 的 🎉"), (2**62, "far"), (7, ""), (8, "word " * 20_000), (9, "x" * 5000), (10, "\x1c\x1d w x")]


def check(rows, texts):
    """Rows in order of their number are the texts in ascending order of identifiers, without a gap."""
    rows = sorted(rows, key=lambda r: r.number)
    assert [r.number for r in rows] == list(range(len(texts)))
    assert [r.doc_id for r in rows] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i))
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    got = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in rows)
    assert got == sorted((str(i), ids) for (i, _), ids in zip(texts, library_ids([t for _, t in texts]), strict=True))


@pytest.mark.parametrize("file_ids", [1, 50, 4_000_000])
def test_files_of_all_sizes(spark, file_ids):
    texts = [*TEXTS, *((i, f"Text {i} of many words {i * i}") for i in range(100, 160))]
    docs = spark.createDataFrame([(i, t, *[None] * 6) for i, t in texts], f"doc_id long, text string, {CLASHES}").repartition(3)
    path = new_path(spark, "token-files")
    token_files.write_token_files(docs, path, WORDS, file_ids=file_ids)
    check(token_files.read_token_files(spark, path).collect(), texts)
    contents = [bytes(r.content) for r in spark.read.format("binaryFile").load(f"{path}/part-*").collect()]
    files = [token_files.TokenFile(c) for c in contents]
    assert all(c.startswith(token_files.MAGIC) and c.endswith(b"\n") for c in contents)
    assert all(len(f) == 1 or len(f.ids) <= file_ids for f in files) and sum(map(len, files)) == len(texts)
    for f in files:
        ends = f.bounds.values()
        assert all((f.document(i) == f.ids[ends[i] : ends[i + 1]]).all() for i in range(len(f)))


def test_wide_ids_no_rows_and_odd_names(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.round_trip(docs, WORDS, end_id=70_000).collect()}
    assert ids == dict(zip((1, 2), library_ids(["a b", ""], 70_000), strict=True))
    assert token_files.round_trip(docs.limit(0), WORDS).count() == 0
    with pytest.raises(ValueError, match="whole numbers"):
        token_files.round_trip(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), WORDS)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want, start = [], 0
    for i, ids in zip(sorted(docs), library_ids([docs[i] for i in sorted(docs)]), strict=True):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = queries.op11_token_files(spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and sorted(map(tuple, got.collect())) == want
