"""Pairs of sets that share many runs go out once; what the encoder remembers is bounded inside a text too."""

import itertools

import numpy as np
import pyarrow as pa

from tidefut.llm import ngram_join, packing
from tidefut.llm.queries import vocabulary


def batch(run, nodes, firsts):
    n = len(nodes)
    longs = [pa.array(np.full(n, v, np.int64)) for v in (run, 0, 0)]
    return pa.RecordBatch.from_arrays(
        [*longs, pa.array(nodes), pa.array([100] * n), pa.array(nodes), pa.array([bytes(32)] * n), pa.array([0] * n, pa.int32()), pa.array([firsts[k] for k in nodes], pa.list_(pa.int64()))],
        names=["run", "i", "j", "node", "n", "grp", "sketch", "side", "firsts"],
    )


def test_the_first_common_run_gives_a_pair():
    rng = np.random.default_rng(4)
    for size in (12, ngram_join.SMALL + 30):
        runs = {r: sorted(rng.choice(100, size, replace=False).tolist()) for r in range(-10, 10)}
        for limit, most in ((99, 1), (5, 20)):
            firsts = {k: [r for r in runs if k in runs[r]][:limit] for k in range(100)}
            out = []
            for r, nodes in runs.items():
                a, b = ngram_join.group_pairs(batch(r, nodes, firsts), None)
                assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(a)
                out += zip(a.tolist(), b.tolist(), strict=True)
            want = {(max(p), min(p)) for nodes in runs.values() for p in itertools.combinations(nodes, 2)}
            assert set(out) == want and max(out.count(p) for p in list(want)[:200]) <= most
            assert len(out) < sum(len(nodes) * (len(nodes) - 1) // 2 for nodes in runs.values())


def test_one_text_of_many_words_is_not_remembered_whole(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 100)
    encoder = packing.WordEncoder(vocabulary("word_bpe_49k.json"))
    texts = [" ".join(f"tide{i} moon" for i in range(1000)), "tide1 moon\x1cstar", "Ünïcode 東京 " + "a" * 200, ""]
    assert encoder.encode(texts) == [encoder.one(t) for t in texts]
    assert len(encoder.known) <= 101
