"""The n-gram join on short texts: alone, after a long one, and many that have nothing in common."""

import numpy as np
import pytest

from tidefut.llm import ngram_join
from tidefut.llm.common import WordTable

LONG = "of the sea " * 100_000


@pytest.mark.parametrize("n", [0, 2, 3, 5])
def test_words_alone_and_after_a_long_text(spark, n):
    text = " ".join("abcdef"[:n])
    for texts in ([text], [LONG, text]):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        got = sorted(map(tuple, ngram_join.jaccard_join(docs).collect()))
        size = {text: 0 if not n else 1 if n < 5 else n - 4, LONG: 3}
        assert got == [(i, size[t], texts.index(t) if t and size[t] else i) for i, t in enumerate(texts)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 7, 12])
def test_sets_of_a_block_of_short_texts(n):
    table = WordTable(ngram_join.word_hashes)
    words = [f"w{i}" for i in range(n)]
    assert [len(s) for s in ngram_join.shingle_sets([" ".join(words)], table)] == [0 if not n else max(1, n - 4)]
    assert [len(s) for s in ngram_join.shingle_sets(words, table)] == [1] * n


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 13, 20])
def test_unrelated_short_sets_share_no_signature(n):
    rng = np.random.default_rng(n)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for _ in range(1000)]
    sig, own = ngram_join.signatures(sets)
    assert len(np.unique(sig)) == len(sig)
    assert not len(sig) if n < 4 else len(np.unique(own)) == len(sets)


@pytest.mark.parametrize("n", range(1, 14))
def test_similar_short_sets_share_a_signature(n):
    rng = np.random.default_rng(n)
    for _ in range(100):
        a = rng.integers(0, 2**63, n).astype(np.uint64).tolist()
        for less in range(n // 4 + 1):
            for more in range(n // 4 + 1):
                b = a[less:] + rng.integers(0, 2**63, more).astype(np.uint64).tolist()
                if b != a and 100 * (n - less) >= 80 * (n + more):
                    sig, own = ngram_join.signatures([np.unique(np.array(x, np.uint64)) for x in (a, b)])
                    assert np.intersect1d(sig[own == 0], sig[own == 1]).size
