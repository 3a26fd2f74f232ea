"""Quality: every labelled row and every pair of them is in the fit."""

import random

import numpy as np
import pytest

from tidefut.llm import quality


def rows_of(n):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        y = rng.random() < 0.6
        marks = "!" * rng.randint(0, 2 if y else 5) + "7" * rng.randint(0, 3)
        rows.append((i, " ".join(rng.choices(["tide", "Moon", "star", "ROCK", "a"], k=rng.randint(1, 25 if y else 12))) + marks, int(y)))
    return rows


def test_weights_are_those_of_all_pairs(spark):
    rows = rows_of(240)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    model = quality.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    x, y = quality.features([t for _, t, _ in rows]), np.array([y for *_, y in rows])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0) + 1e-6)
    z = (x - model.mean) / model.scale
    good, bad = z[y == 1], z[y == 0]
    want = quality.bradley_terry(np.repeat(good, len(bad), axis=0), np.tile(bad, (len(good), 1)))
    assert np.abs(model.weights - want).max() < 0.01
    cut = np.quantile(z @ model.weights, (y == 0).mean())
    assert abs(model.shift - (np.log(0.3 / 0.7) - cut)) < 1e-9


@pytest.mark.parametrize("sent", [True, False])
def test_labels_beyond_twenty_thousand_count(spark, monkeypatch, sent):
    monkeypatch.setattr(quality, "sendable", lambda rows: sent)
    n = 24_000
    docs = spark.range(n).selectExpr("id as doc_id", "case when id % 5 = 0 then 'Tide 7' else 'tide rock moon' end as text")
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 3 > 0 as int) as quality")
    model = quality.fit(docs, labels)
    x = quality.features(["Tide 7", "tide rock moon"])
    assert np.allclose(model.mean, 0.2 * x[0] + 0.8 * x[1], atol=1e-12)


def test_ranks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(quality, "SORTED", 5)
    rng = np.random.default_rng(1)
    values = [float(v) for v in np.concatenate([rng.standard_normal(300), np.zeros(60), [1e6, -1e6]])]
    df = spark.createDataFrame([(v,) for v in values], "raw double")
    order = sorted(values)
    for rank in (0, 1, 150, 180, 360, 361):
        assert quality.ranked(df, rank) == order[rank]
