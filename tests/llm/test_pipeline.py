"""Stages of the pipeline on rows with null and repeated identifiers."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidefut.llm import language_id, quality
from tidefut.llm.queries import vocabulary

from .test_brute_force import check_pieces

WORDS = [f"w{i}" for i in range(500)]


def text(seed, n=60):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def test_near_copies_go_by_row(spark):
    a, b, c, d, e, f = (text(k) for k in range(6))
    rows = [
        (5, a), (None, a + " more"),  # the one without identifier goes
        (None, b), (None, c),  # unique ones without identifier stay
        (3, d), (7, d + " more"), (7, e),  # identifier 7 goes on one text, stays on the other
        (None, f), (None, f + " more"), (None, f + " less"),  # one of a group without identifiers stays
        (9, None), (None, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    out = corpus_pipeline.stage_ngram_jaccard(spark, docs, "")
    got = [(r.doc_id, r.text) for r in out.collect()]
    whole = [(i, t) for i, t in got if not (t or "").startswith(f)]
    assert tuple(out.columns) == corpus_pipeline.COLUMNS
    assert sorted(whole, key=str) == sorted([(5, a), (None, b), (None, c), (3, d), (7, e), (9, None), (None, "")], key=str)
    assert len(got) == len(whole) + 1


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
LANGS = {"en": "the tide and moon are with that shore of this sea", "de": "der mond und die flut ist mit das meer auf dem ein"}


def corpus():
    """Two languages; junk, copies, near copies, texts without letters, a very long one, null and repeated identifiers."""
    rng, rows = random.Random(12), []
    for i in range(160):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(rng.choices(LANGS[lang].split(), k=40 + i % 30)), lang if i % 3 else None))
    rows += [(200 + i, "!!! $$$ ### %%% &&& ***" * (1 + i % 4) + f" buy{i} NOW", "en") for i in range(60)]
    rows += [(300 + i, rows[i][1].upper() if i % 2 else rows[i][1], "de") for i in range(20)]
    rows += [(400 + i, rows[30 + i][1] + " more", None) for i in range(20)]
    rows += [(None, None, None), (501, "", "en"), (502, "12 34 ²", "en"), (None, rows[50][1], None), (60, rows[61][1], "en"), (503, " ".join(rng.choices(LANGS["en"].split(), k=20_000)), "en")]
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(corpus(), SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], int(not 200 <= r[0] < 300)) for r in corpus() if r[0] is not None and r[0] < 300 and r[0] != 60]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def key(rows):
    return sorted((str(r[0]), str(r[1])) for r in rows)


def brute_language(spark, docs, rows):
    path = vocabulary("piece_bpe_32k.model")
    fold = language_id.crc_mod("doc_id", 4)
    model, pieces = language_id.fit(docs.where(fold != 2), path), language_id.pieces_of(path)
    kept = []
    for r in rows:
        words = language_id.split_words(r[1] or "")
        if words:
            logs = language_id.word_log_probs(words, pieces, model.probs).sum(axis=0) + model.prior
            p = np.exp(language_id.TEMPER * (logs - logs.max()))
            if 1 / p.sum() >= corpus_pipeline.LEAST_LANG_SCORE:
                kept.append(r)
    return kept


def brute_quality(spark, docs, rows, sf_dir):
    fold = language_id.crc_mod("doc_id", 5)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold != 0), threshold=corpus_pipeline.LEAST_QUALITY)
    return [r for r in rows if model.scores(quality.features([r[1] or ""]))[0] >= corpus_pipeline.LEAST_QUALITY]


def low(text):
    return (text or "").encode().lower()


def brute_exact(rows):
    best = {}
    for r in rows:
        at = best.get(low(r[1]))
        if at is None or (-1 if at[0] is None else at[0]) < (-1 if r[0] is None else r[0]):
            best[low(r[1])] = r
    return list(best.values())


def brute_near(rows):
    sets = []
    for r in rows:
        w = low(r[1]).split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    kept = {}
    for r, g in zip(rows, group, strict=True):
        if g not in kept or (r[0] is None, r[0] or 0) < (kept[g][0] is None, kept[g][0] or 0):
            kept[g] = r
    return list(kept.values())


def test_every_stage_and_all_of_them(spark, folder):
    docs, rows = spark.read.parquet(f"{folder}/documents.parquet"), corpus()
    brute = [brute_language, brute_quality, lambda s, d, r: brute_exact(r), lambda s, d, r: brute_near(r)]
    for k, ((name, stage), slow) in enumerate(zip(corpus_pipeline.STAGES, brute, strict=False)):
        rows = slow(spark, docs, rows, folder) if k == 1 else slow(spark, docs, rows)
        out = stage(spark, docs, folder)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS, name
        got = out.collect()
        assert key(got) == key(rows), name
        docs = spark.createDataFrame(got, SCHEMA).repartition(3)
    assert 0 < len(rows) < 200 and any(r[0] == 503 for r in rows)
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    assert len(ids) == len(rows)
    for packed in (corpus_pipeline.stage_packing(spark, docs, folder), corpus_pipeline.run(spark, folder)):
        check_pieces(packed.collect(), ids, (2048, 128, 2048))


def test_stages_of_nothing(spark, folder):
    nothing = spark.createDataFrame([], SCHEMA + ", row_no long, sig string")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0, name


def test_stages_with_other_columns(spark, folder):
    odd = ("row_no", "own_id", "component", "id_wanted", "sig", "node", "held_out")
    docs = spark.createDataFrame([(1, LANGS["en"], "en", "s", 9, *odd), (2, LANGS["en"].upper(), "en", "s", 9, *odd)], SCHEMA + "".join(f", {c} string" for c in odd))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() >= 1, name
