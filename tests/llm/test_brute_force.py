"""Operators without SQL against brute force or the public libraries, on small tables."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidefut.llm import byte_bpe, exact_dedup, html_extract, language_id, ngram_join, packing, quality, sharding, toxicity
from tidefut.llm.queries import vocabulary

ODD = ["", " ", "a", "aaaa aaaa", "don't  stop\n\n\nnow ", "Éé ß ﬁ ½ 的字 🎉🎉", "x" * 300, "12345 ²½ Ⅷ ①", "Á é", "\x1c\x1d w x", "<|endoftext|> end"]


def odd_texts(n=300, seed=2):
    rng = random.Random(seed)
    parts = ["the ", "and", "ing", " ", "  ", "\n", "é", "ß", "12", "'s", "...", "Tide ", "\t", "€", "的", "qu", "!!"]
    return [*ODD, *("".join(rng.choices(parts, k=rng.randint(1, 50))) for _ in range(n))]


def table(spark, texts, **columns):
    rows = [(i, t, "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, sig string").repartition(3)


# ---- byte-level BPE ----------------------------------------------------------------------


@pytest.mark.parametrize("sent", [0, 40, 100_000])
def test_byte_bpe_gives_the_library_s_ids(spark, sent, monkeypatch):
    import public_tokenizers
    import tiktoken

    monkeypatch.setattr(byte_bpe.sent_chunks, "__defaults__", (sent,))
    path = vocabulary("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.Ranks(path).ranks, special_tokens={})
    texts = [None, *odd_texts()]
    got = {r.doc_id: r.ids for r in byte_bpe.encode(table(spark, texts), path, public_tokenizers.PATTERN).collect()}
    assert got == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_byte_bpe_of_repeats_and_nothing(spark):
    import public_tokenizers

    path = vocabulary("byte_bpe_50k.tiktoken")
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = byte_bpe.encode_decode(twice, path, public_tokenizers.PATTERN).collect()
    assert len(got) == 3 and len({r.ids_sha256 for r in got}) == 2
    assert byte_bpe.encode_decode(twice.limit(0), path, public_tokenizers.PATTERN).count() == 0


# ---- packing -----------------------------------------------------------------------------


def check_pieces(rows, ids, limits):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= limits[0] and len(own) <= limits[1] and sum(r.n_loss for r in own) <= limits[2]
    assert set(pieces) == set(ids)
    for doc, own in pieces.items():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        want = [*ids[doc], 1]
        assert all(r.doc_tokens == len(want) for r in own) and sum(r.length for r in own) == len(want)
        assert all(r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    return sequences


def test_packing_has_the_library_s_ids(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [None, *odd_texts(), " ".join(f"word{i}" for i in range(3000))]
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    got = packing.pack(table(spark, texts), path).collect()
    sequences = check_pieces(got, ids, (2048, 128, 2048))
    assert all(n == 2048 or n & (n - 1) == 0 for n in (sum(r.length for r in own) for own in sequences.values()))


def test_packing_keeps_all_limits_at_once(spark):
    """Prompts bear no loss; some sequences are closed by segments, others by loss, others by tokens."""
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(4)
    words = "tide moon star rock sand wave".split()
    rows = [(i, " ".join(rng.choices(words, k=n)), " ".join(rng.choices(words, k=m))) for i, (n, m) in enumerate([(2, 1)] * 60 + [(30, 0)] * 40 + [(2, 50)] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, asked string").coalesce(1)
    ids = {i: library.encode(q, add_special_tokens=False).ids + library.encode(t, add_special_tokens=False).ids for i, t, q in rows}
    got = packing.pack(df, path, max_tokens=64, max_segments=5, max_loss=40, waiting=64, prompt="asked").collect()
    sequences = check_pieces(got, ids, (64, 5, 40)).values()
    assert any(len(own) == 5 for own in sequences) and any(sum(r.n_loss for r in own) == 40 for own in sequences) and any(sum(r.length for r in own) == 64 for own in sequences)
    assert packing.pack(df.limit(0), path).count() == 0


def test_packing_by_another_tokenizer(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = odd_texts(40)
    got = packing.pack(table(spark, texts), path).collect()
    check_pieces(got, {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}, (2048, 128, 2048))


# ---- toxicity ----------------------------------------------------------------------------


def brute_ratio(counts):
    """Log ratios of words by the Kneser-Ney recursion written out."""
    k = toxicity.ORDER
    grams = [Counter(), Counter()]
    for y in (0, 1):
        for w, n in counts[y].items():
            padded = "^" * (k - 1) + w + "$"
            for i in range(len(padded) - k + 1):
                grams[y][padded[i : i + k]] += n

    def discount(values):
        one, two = (sum(v == x for v in values) for x in (1, 2))
        return one / (one + 2 * two) if one and two else 0.75

    levels, cur = {}, set(grams[0]) | set(grams[1])
    for n in range(k - 1, 0, -1):
        count = Counter(g[1:] for g in cur)
        levels[n] = (count, discount(count.values()))
        cur = set(count)

    def part(count, d, gram, back):
        own = {g: c for g, c in count.items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        return back if not total else max(own.get(gram, 0) - d, 0) / total + d * sum(c > 0 for c in own.values()) / total * back

    def shared(gram):
        return 1 / len(levels[1][0]) if not gram else part(*levels[len(gram)], gram, shared(gram[1:]))

    tops = [discount(g.values()) for g in grams]

    def ratio(word):
        padded = "^" * (k - 1) + word + "$"
        out = 0
        for i in range(len(padded) - k + 1):
            gram = padded[i : i + k]
            toxic, other = (part(grams[y], tops[y], gram, shared(gram[1:])) for y in (1, 0))
            out += math.log(toxic / other)
        return out

    return ratio


def test_toxicity_is_kneser_ney(spark):
    rng = random.Random(6)
    stems = ["grum", "foot", "tide", "blen", "moor", "ette", "ly", "s"]
    word = lambda: "".join(rng.choices(stems, k=rng.randint(1, 3)))
    rows = [(i, " ".join([*(word() for _ in range(20)), *(["nastyfoot", "grumnasty"] if i % 3 == 0 else [])]), int(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    models = [toxicity.fit(docs, labels, max_rows=15, sent_ngrams=n) for n in (1_000_000, 0)]
    sample = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(15).collect()}
    counts = [Counter(), Counter()]
    for i, t, y in rows:
        if i not in sample:
            counts[y].update(t.split())
    ratio = brute_ratio(counts)
    asked = ["nastyfoot", "tide", "grumly", "unheard", "footfootfoot", "z"]
    assert np.allclose(models[0].model.word_ratios(asked), [ratio(w) for w in asked], atol=1e-4)
    tests = [*(t for _, t, _ in rows[:40]), None, "", "12 !!", "x" * 3000, "Unheard, of words"]
    df = table(spark, tests)
    want = {}
    for i, t in enumerate(tests):
        ws = toxicity.split_words(t or "") if t else []
        want[i] = (sum(np.logaddexp(math.log1p(-toxicity.SHARE), math.log(toxicity.SHARE) + ratio(w)) for w in ws if len(w) < 1000), sum(len(w) + 1 for w in ws))
    for m in models:
        got = {r.doc_id: (r.ratio, r.size) for r in m.differences(df, "doc_id").collect()}
        assert len(got) == len(tests)
        assert all(np.allclose(got[i], want[i], atol=1e-3) for i in want if i != 43)
    scores = [{r.doc_id: r.score for r in m.score(df, "doc_id").collect()} for m in models]
    assert all(abs(scores[0][i] - scores[1][i]) < 1e-3 and 0 <= scores[0][i] <= 1 for i in want)


# ---- language ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return language_id.pieces_of(vocabulary("piece_bpe_32k.model"))


def test_expected_counts_by_enumeration(pieces):
    probs = np.random.default_rng(3).random(pieces.size)
    probs /= probs.sum()
    number = {p: i for i, p in enumerate(pieces.names)}

    def ways(w):
        if not w:
            yield 1.0, []
        for k in range(1, len(w) + 1):
            if w[:k] in number or k == 1:
                p = probs[number[w[:k]]] if w[:k] in number else language_id.UNKNOWN
                for q, rest in ways(w[k:]):
                    yield p * q, [w[:k], *rest]

    words, n = ["tides", "ß", "ebb"], np.array([3.0, 2.0, 1.0])
    want = np.zeros(pieces.size)
    for w, m in zip(words, n, strict=True):
        found = list(ways("▁" + w))
        total = sum(q for q, _ in found)
        for q, parts in found:
            for x in parts:
                if x in number:
                    want[number[x]] += m * q / total
    lens, lattice = pieces.lattice(words)
    assert np.allclose(language_id.expected_counts(lens, lattice, probs, n), want)
    assert np.allclose(language_id.long_counts(lens, lattice, probs, n), want)


def test_long_words_are_summed_whole(pieces):
    probs = np.random.default_rng(1).random((pieces.size, 2))
    probs /= probs.sum(axis=0)
    word = "tidalwaves" * 3
    lens, lattice = pieces.lattice([word])
    whole = language_id.long_steps(lens, lattice, probs)[0, lens[0]]
    assert np.allclose(whole, np.log(language_id.forward(lens, lattice, probs)[lens[0], 0]))
    longer = language_id.word_log_probs(["tide", word * 40], pieces, probs)
    assert np.isfinite(longer).all() and (longer[1] < 30 * whole).all()


def test_languages_of_odd_texts(spark):
    path = vocabulary("piece_bpe_32k.model")
    texts = ["der die und das ist", "the and that with is"] * 40
    docs = spark.createDataFrame([(i, t, "de" if i % 2 == 0 else "en", 1) for i, t in enumerate(texts)] + [(900 + i, t, None, 1) for i, t in enumerate([None, "", "²½ Ⅷ ①", "12 ...", "the", "THE and"])], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in language_id.language_id(docs, path).collect()}
    assert len(got) == 86 and [got[900 + i].lang_pred for i in range(6)] == ["und"] * 4 + ["en"] * 2
    assert all(got[i].lang_pred == ("de" if i % 2 == 0 else "en") and 0 <= got[i].score <= 1 for i in range(80))
    tie = docs.where("doc_id < 2").selectExpr("doc_id", "'moon' text", "lang", "score").unionByName(docs.where("doc_id < 40").selectExpr("doc_id", "'same words here' text", "lang", "score"))
    model = language_id.fit(tie, path)
    assert {r.lang_pred for r in language_id.predict(tie, model, path).collect()} == {"de"}  # the first in order
    assert language_id.language_id(docs.limit(0), path).count() == 0
    nothing = language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string")), path)
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


# ---- quality -----------------------------------------------------------------------------


def test_bradley_terry_is_the_least_loss():
    rng = np.random.default_rng(2)
    better, worse = rng.standard_normal((400, 3)) + [0.8, 0, -0.3], rng.standard_normal((400, 3))
    loss = lambda w: np.log1p(np.exp(-(better - worse) @ w)).mean() + 0.0005 * w @ w
    w = quality.bradley_terry(better, worse)
    assert all(loss(w) <= loss(w + 0.02 * d) for d in [*np.eye(3), *-np.eye(3), *rng.standard_normal((20, 3))])


def test_quality_scores_are_its_parts(spark):
    rng = random.Random(3)
    rows = [(i, (" ".join(rng.choices("tide moon star rock".split(), k=20)) if i % 3 else "!!" * (i % 7 + 1)), int(i % 3 > 0)) for i in range(150)]
    docs = spark.createDataFrame([*((i, t, 0.5) for i, t, _ in rows), (500, None, 0.5), (501, "", 0.5), (502, "word " * 30_000, 0.5), (0, rows[0][1], 0.5)], "doc_id long, text string, predicted double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        x = (quality.features([texts[r.doc_id] or ""])[0] - model.mean) / model.scale
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, float(x @ model.weights + model.shift)))))) < 1e-9
    assert np.mean([(r.score >= 0.3) == bool(r.doc_id % 3) for r in got if r.doc_id < 150]) > 0.97


# ---- HTML --------------------------------------------------------------------------------


def test_suffix_array_by_sorting():
    rng = random.Random(1)
    for _ in range(150):
        tokens = [rng.randint(0, 2) for _ in range(rng.randint(1, 40))]
        order, lcp = html_extract.suffix_array(np.array(tokens))
        assert order.tolist() == sorted(range(len(tokens)), key=lambda i: tokens[i:])
        for a, b, n in zip(order, order[1:], lcp[1:], strict=False):
            x, y = tokens[a:], tokens[b:]
            assert x[:n] == y[:n] and x[n : n + 1] != y[n : n + 1]


def test_shared_substrings_by_search():
    rng = random.Random(2)
    for _ in range(150):
        streams = [[rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(rng.randint(1, 6))]
        size = rng.randint(2, 5)
        distinct = set(map(tuple, streams))
        for s, got in zip(streams, html_extract.shared_pages(streams, size), strict=True):
            want = [1] * len(s)
            for i in range(len(s) - size + 1):
                n = sum(any(d[j : j + size] == tuple(s[i : i + size]) for j in range(len(d) - size + 1)) for d in distinct)
                for k in range(i, i + size):
                    want[k] = max(want[k], n)
            assert got.tolist() == want


def test_the_array_alone_finds_the_text(spark):
    """No element or class tells menus and notices from text: only that a host's pages repeat them."""
    menu = "Home News Sport Weather Travel Money Culture Contact Sign in"
    notice = "We and our partners store data on your device to improve this site"
    rng = random.Random(5)
    own = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(30)) for _ in range(12)]
    rows = [(i, f"http://h/{i}", f"<div>{menu}</div><div>{t}</div><div>{notice}</div>", "x") for i, t in enumerate(own)]
    rows += [(100, "http://other/", f"<div>{menu}</div>", "x"), (None, None, "<p>alone</p>", "x"), (7, "http://h/7", rows[7][2], "x"), (101, "http://h/101", None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = sorted((str(r.page_id), r.text) for r in html_extract.extract(pages).collect())
    want = sorted([*((str(i), t) for i, t in enumerate(own)), ("7", own[7]), ("100", menu), ("None", "alone"), ("101", "")])
    assert got == want
    plain = {r.page_id: r.text for r in html_extract.extract(pages, repeats=False).collect()}
    assert plain[3] == f"{menu} {own[3]} {notice}"
    assert html_extract.extract(pages.limit(0)).count() == 0


# ---- near copies, exact copies, shards ---------------------------------------------------


def test_shared_runs_over_batches():
    rng = np.random.default_rng(1)
    for t in range(150):
        n = int(rng.integers(0, 300))
        sig, node = rng.integers(-20, 20, n) if t % 2 else rng.integers(-3, 3, n), rng.integers(0, 60, n)
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        cuts = [0, *sorted(rng.integers(0, n + 1, 6).tolist()), n]
        batches = [pa.RecordBatch.from_arrays([pa.array(sig[a:b]), pa.array(node[a:b])], names=["sig", "node"]) for a, b in zip(cuts, cuts[1:], strict=False)]
        got, want = defaultdict(set), defaultdict(set)
        for run, members in ngram_join.shared_runs(iter(batches), streamed=10):
            for r, m in zip(run.tolist(), members.tolist(), strict=True):
                got[r].add(m)
        for s, m in zip(sig.tolist(), node.tolist(), strict=True):
            want[s].add(m)
        assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values() if len(x) > 1}


def test_hot_cluster_of_near_copies(spark):
    """One text with hundreds of near copies, another that many rows repeat, and rows that share a passage only."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    base, other, passage = (rng.choices(words, k=120) for _ in range(3))
    texts = []
    for _ in range(250):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += [" ".join(other)] * 150
    texts += [" ".join([*rng.choices(words, k=150), *passage[:60]]) for _ in range(100)]
    texts += [None, "", " ", "one two", "One two"]
    rng.shuffle(texts)
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    low = list(range(len(sets)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                low[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(table(spark, texts)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_equal_sets_have_one_name(spark):
    """Copies of a set are one node, other sets have other names, by both halves."""
    docs = table(spark, ["a b c d e f", "g h i j k l", "A b\tc d e f", "m n o p q r", None])
    rows, _ = ngram_join.describe(docs)
    got = rows.where("n > 0").groupBy("node", "node2", "name").agg(F.sort_array(F.collect_list("doc_id")).alias("ids")).collect()
    assert sorted(r.ids for r in got) == [[0, 2], [1], [3]] and all(r.node == r.name for r in got)
    assert len({r.node for r in got}) == len({r.node2 for r in got}) == 3


def test_state_outlives_the_call(spark, tmp_path):
    first = spark.createDataFrame([(1, "Tide"), (2, "moon"), (9, "ebb")], "doc_id long, text string")
    second = spark.createDataFrame([(5, "tide"), (3, "MOON"), (4, "new"), (9, "ebb")], "doc_id long, text string")
    state = f"file://{tmp_path}/state"
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(first, state=state).collect()} == {1: (1, 1, True), 2: (2, 1, True), 9: (9, 1, True)}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(second, state=state, earlier=first).collect()}
    assert {k: v for k, v in got.items() if k != 9} == {5: (5, 2, True), 3: (3, 2, True), 4: (4, 1, True)} and got[9][:2] == (9, 2)


def test_columns_of_any_name(spark):
    odd = spark.createDataFrame([(1, "a", 1, 2, 3, 4), (1, "B", 1, 2, 3, 4), (2, "a", 5, 6, 7, 8), (2, "A", 5, 6, 7, 8)], "doc_id long, text string, id_wanted long, id_kept long, sha_kept long, digest long")
    kept = exact_dedup.keep_documents(odd)
    assert kept.columns == odd.columns and kept.count() == 2
    assert exact_dedup.keep_documents(odd.where("text = 'a'")).count() == 1


def test_shard_directory(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(40)] + [(7, "x" * 3000), (None, None)], "doc_id long, text string")
    shards = sharding.extendible_shards(docs, limit_bytes=500)
    rows = sharding.directory(shards).collect()
    assert sum(r.entries for r in rows if r.n_rows) <= 2 ** rows[0].global_depth and sum(r.n_rows for r in rows) == 42
    assert all(r.shard_bytes <= 500 or r.n_rows <= 2 for r in rows)
