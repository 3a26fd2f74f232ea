"""Each operator on small tables with nulls, ties, repeats and odd columns, against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefut.llm import byte_bpe, exact_dedup, html_extract, language_id, ngram_join, nn_descent, packing, quality, sharding, toxicity
from tidefut.llm.queries import vocabulary

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
SCHEMA = "doc_id long, text string, digest string, keep string"


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    rows = [(0, None), (1, ""), (2, "One"), (3, "one"), (4, " \t\n"), (5, "É"), (6, "é")]
    while len(rows) < n:
        text = " ".join(rng.choices(WORDS, k=rng.randint(1, 80)))
        rows.append((len(rows), text))
        for _ in range(rng.randint(0, 2)):
            words = text.split()
            words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(words).title() if rng.random() < 0.5 else " ".join(words)))
    return [(i, t, "x", "y") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)])
def test_exact_dedup(docs, digest):
    rows = corpus()
    best, size = {}, {}
    for i, t, *_ in rows:
        best[lower(t)] = max(i, best.get(lower(t), -1))
        size[lower(t)] = size.get(lower(t), 0) + 1
    want = {i: (best[lower(t)], size[lower(t)], best[lower(t)] == i, hashlib.sha256(lower(t)).hexdigest()) for i, t, *_ in rows}
    got = exact_dedup.exact_dedup(docs, digest).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want and len(got) == len(rows)


def test_exact_dedup_repeats_and_empty(spark, empty):
    twice = spark.createDataFrame([(1, "a"), (1, "A"), (None, "a"), (None, "b")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(twice).collect()
    assert len(got) == 4 and sum(r.kept for r in got) == 2
    assert exact_dedup.keep_documents(twice).count() == 2
    assert exact_dedup.exact_dedup(empty).count() == 0


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = lower(t).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, seed):
    rows = corpus(90, seed)
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_jaccard_empty(empty):
    assert ngram_join.jaccard_join(empty).count() == 0


def test_signatures_never_miss_a_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        base = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        cut = int(rng.integers(0, n // 5 + 1))
        a, b = np.unique(base[:n]), np.unique(np.concatenate([base[cut:n], base[n : n + int(rng.integers(0, n // 5 + 1))]]))
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            sig, of = ngram_join.signatures([a, b])
            assert set(sig[of == 0]) & set(sig[of == 1])


def test_nn_descent(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    x = [list(map(float, v)) for v in np.concatenate([base, base[:15] + 0.05 * rng.standard_normal((15, 16)), base[:3]])]
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [1.0, 2.0], []]
    rows = [(i, v, "l") for i, v in enumerate([*x, *odd])]
    got = {r.vec_id: r for r in nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, e string")).collect()}
    m = np.array(x, np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    deg = ((m @ m.T >= 0.95).sum(axis=1) - 1).tolist()
    assert [got[i].n_links for i in range(len(x))] == deg
    assert all(got[i].n_links == 0 and got[i].kept for i in range(len(x), len(rows)))


def brute_vectors(x, threshold=0.95):
    """Links and least member of the component of each vector."""
    m = np.array(x, np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= threshold
    low = np.arange(len(m))
    while True:
        nxt = np.where(near, low[None, :], len(m)).min(axis=1)
        if (nxt == low).all():
            return (near.sum(axis=1) - 1).tolist(), low.tolist()
        low = nxt


def test_nn_descent_joins_dense_groups(spark):
    """Each vector has far more than k links inside its group; the weaker links across join the groups."""
    rng = np.random.default_rng(7)
    centre = np.zeros((2, 16))
    centre[0, 0], centre[1, :2] = 1, (0.957, np.sqrt(1 - 0.957**2))
    x = np.concatenate([centre[i] + 0.015 * rng.standard_normal((150, 16)) for i in (0, 1)] + [rng.standard_normal((40, 16))])
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    deg, low = brute_vectors(x)
    assert 0 < sum(deg[:150]) - 150 * 149 and low[150] == 0
    got = {r.vec_id: r for r in nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()}
    assert [got[i].n_links for i in range(len(x))] == deg
    assert [got[i].component_id for i in range(len(x))] == low


def test_nn_descent_audit_is_not_hidden_by_a_hot_group(spark):
    """All pairs outside one large group are missed."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((61, 32))
    x = np.concatenate([base[:1] + 0.01 * rng.standard_normal((400, 32)), *(base[i] + 0.01 * rng.standard_normal((2, 32)) for i in range(1, 61))])
    nodes = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "nid long, e array<double>")
    found = spark.createDataFrame([(i, 0) for i in range(400)], "node long, component long")
    share, missing = nn_descent.audit(nodes, found, 0.95)
    assert share < 0.5
    assert {tuple(sorted((r.a, r.b))) for r in missing.collect()} == {(i, i + 1) for i in range(400, 520, 2)}


def test_sharding(docs, empty):
    got = sharding.extendible_shards(docs, limit_bytes=600).collect()
    held = {}
    for r in got:
        held.setdefault((r.shard_depth, r.shard), []).append(r)
    assert len(got) == len(corpus())
    for rows in held.values():
        assert sum(r.n_bytes for r in rows) == rows[0].shard_bytes and (rows[0].shard_bytes <= 600 or rows[0].oversize and len(rows) == 1)
    assert sharding.extendible_shards(empty).count() == 0


def test_byte_bpe_round_trip(docs, spark):
    import public_tokenizers

    path = vocabulary("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(docs, path, public_tokenizers.PATTERN)
    back = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(ids, path).collect()}
    assert back == {i: (t or "").encode() for i, t, *_ in corpus()}


def test_packing(docs):
    got = packing.pack(docs.withColumn("p", F.lit(2)), vocabulary("word_bpe_49k.json"), max_tokens=64, max_segments=4, max_loss=40, waiting=8, n_prompt="p").collect()
    seqs, pieces = {}, {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    for rows in seqs.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        assert sum(r.length for r in rows) <= 64 and len(rows) <= 4 and sum(r.n_loss for r in rows) <= 40
    for rows in pieces.values():
        rows.sort(key=lambda r: r.start)
        assert [r.start for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        assert sum(r.length for r in rows) == rows[0].doc_tokens
    assert len(pieces) == len(corpus())


PAGE = (
    "<html><head><title>x</title><script>if(a<b)</script></head><body><nav>menu here</nav><div class='cookie-notice'>we use it</div><article><h1>Head &amp; tail</h1>"
    "<p>Some <b>bold</b>text&nbsp;here<p>next\n  line<br>more<form>send</form><div id=comments>reader says</div></article><aside>side</aside><footer>foot</footer>"
)


def test_html(spark):
    rows = [(1, "http://a/1", PAGE, "t"), (2, None, None, "t"), (3, "http://a/2", "", "t"), (4, "http://b/", "plain < text", "t")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1][0] == "Head & tail Some boldtext here next line more"
    assert got[2] == got[3] == ("", 0) and got[4][0] == "plain < text"


def test_boilerplate_runs():
    shared = "click here to accept all of the terms of this site".split()
    pages = [[*f"unique words number of page {i}".split(), *shared] for i in range(6)]
    for marked in (True, False):
        masks = html_extract.boilerplate(pages, [marked] * 6)
        assert all(m.tolist() == [False] * 6 + [True] * len(shared) for m in masks)
    few = html_extract.boilerplate([*pages[:3], *([f"w{k}{j}" for j in range(12)] for k in range(9))], [True, False, False, *[False] * 9])
    assert not few[0].any() and few[1].any() and few[2].any()  # a marked article may share what few pages share
    assert not any(m.any() for m in html_extract.boilerplate([shared + [str(i)] for i in range(2)], [False] * 2))


def test_classifiers(spark, empty):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        words = rng.choices(WORDS, k=30) + (["grumblefoot", "grumbleton"] if bad else [])
        rng.shuffle(words)
        text = "!! ".join(words).upper() if i % 4 == 0 else " ".join(words)
        rows.append((i, text, "en" if i % 2 else None, "s"))
        labels.append((i, int(i % 4 != 0), int(bad)))
    rows += [(1000, None, "en", "s"), (1001, "12 34", None, "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    q = {r.doc_id: r for r in quality.quality(d, lab).collect()}
    t = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect()}
    assert np.mean([q[i].predicted == y for i, y, _ in labels if q[i].held_out]) > 0.95
    assert np.mean([t[i].predicted == y for i, _, y in labels if t[i].held_out]) > 0.9
    assert len(q) == len(t) == len(rows)
    lang = {r.doc_id: r for r in language_id.language_id(d, vocabulary("piece_bpe_32k.model")).collect()}
    assert lang[1000].lang_pred == lang[1001].lang_pred == "und" and lang[7].lang_pred == "en"
    assert quality.quality(empty, lab).count() == toxicity.toxicity(empty, lab).count() == 0


def test_toxicity_counts_all(spark):
    """More than 2^20 n-grams, and more rows for the curve than it takes: nothing is left out."""
    rng = random.Random(4)
    letters = [chr(c) for c in range(0xAC00, 0xAC00 + 8000)]
    rows = [(i, " ".join("".join(rng.choices(letters, k=9)) for _ in range(60)), i % 2) for i in range(2400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.fit(d, d.select("doc_id", "toxic"), max_rows=50).model
    fold = d.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(50)
    sample = {r.doc_id for r in fold.select("doc_id").collect()}
    grams = set()
    for i, t, _ in rows:
        for w in toxicity.split_words(t) if i not in sample else ():
            s = "^" * (toxicity.ORDER - 1) + w + "$"
            grams.update(s[e : e + toxicity.ORDER] for e in range(len(w) + 1))
    assert len(sample) == 50 and len(grams) > 1 << 20
    assert len(model.grams) == len(grams) and len(model.contexts) == len({g[:-1] for g in grams})


def test_segmentations_are_summed():
    pieces = language_id.Pieces(vocabulary("piece_bpe_32k.model"))
    probs = np.random.default_rng(1).random((pieces.size, 2)) / 1000
    number = {p: i for i, p in enumerate(pieces.names)}

    def brute(w):
        if not w:
            return np.ones(2)
        total = np.zeros(2)
        for k in range(1, len(w) + 1):
            p = probs[number[w[:k]]] if w[:k] in number else language_id.UNKNOWN if k == 1 else 0
            total = total + p * brute(w[k:])
        return total

    words = ["the", "segment", "ß", "a"]
    assert np.allclose(language_id.word_log_probs(words, pieces, probs), [np.log(brute("▁" + w)) for w in words])


def test_nn_descent_finds_rare_pairs(spark):
    """Twenty pairs just above the threshold among thousands of vectors without a link."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((6_000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(20):
        other = rng.standard_normal(24)
        other -= (other @ x[i]) * x[i]
        x[3_000 + i] = 0.951 * x[i] + (1 - 0.951**2) ** 0.5 * other / np.linalg.norm(other)
    cos = x @ x.T
    np.fill_diagonal(cos, 0)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = nn_descent.near_duplicates(vectors).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate((cos >= 0.95).sum(axis=1).tolist()))
    assert sum(not r.kept for r in got) == 20
    assert {(r.audited_recall, r.audited_links > 20) for r in got} == {(1.0, True)}


def test_nn_descent_recall_at_a_lower_threshold(spark):
    """The given table has no pair near 0.95; at 0.5 it has some, and recall is measured against brute force."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.5
    np.fill_diagonal(hit, False)
    got = {r.vec_id: r.n_links for r in nn_descent.near_duplicates(vectors, threshold=0.5).collect()}
    assert all(got[r.vec_id] <= n for r, n in zip(rows, hit.sum(axis=1).tolist(), strict=True))
    assert sum(got.values()) >= 0.9 * hit.sum()


@pytest.mark.parametrize("square", [8, 4_000])
def test_links_of_large_components(spark, square):
    """One component of a chain of groups and one of a dense group, cut into cells of cells or compared whole."""
    rng = np.random.default_rng(8)
    turn = np.repeat(np.arange(40) * 0.2, 40)
    chain = np.stack([np.cos(turn), np.sin(turn), *(0.02 * rng.standard_normal((4, len(turn))))], axis=1)
    dense = np.array([0, 0, 0, 0, 1, 1]) + 0.06 * rng.standard_normal((1_000, 6))
    x = np.concatenate([chain, dense, 3 * dense[:5]])  # the last are other vectors of the same direction
    mult = rng.integers(1, 4, len(x))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.95
    np.fill_diagonal(hit, False)
    hit[: len(chain), len(chain) :] = hit[len(chain) :, : len(chain)] = False
    nodes = spark.createDataFrame([(i, v.tolist(), int(m)) for i, (v, m) in enumerate(zip(x, mult))], "nid long, e array<double>, mult long")
    components = spark.createDataFrame([(i, 0 if i < len(chain) else len(chain)) for i in range(len(x))], "node long, component long")
    got = {r.nid: r.links for r in nn_descent.count_links(nodes, components, 0.95, square).collect()}
    assert got == {i: n for i, n in enumerate((hit @ mult).tolist()) if n}
