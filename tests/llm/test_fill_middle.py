"""Fill-in-middle examples against a rendering by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidefut.llm.fill_middle import fill_in_middle, restore

TEXTS = [(1, None), (2, ""), (3, "x"), (4, "é́ ß 的 🎉 \u0000 x\r\n" * 400), (5, "a <P> b"), (5, "a < P> b"), (None, "no name"), (None, None), (6, "one\ntwo\n\nthree"), (6, "one\ntwo\n\nthree"), (-7, "<S"), (8, "tide and moon " * 30_000)]
TEXTS += [(i, f"text {i} of many, cut <b>somewhere</b> {'é' * (i % 9)}") for i in range(100, 400)]
CLASHES = "n long, form string, output string, prefix_chars string, text_ string"


def made_by_hand(i, text, units, seed=1, rewritten=90, spm=20):
    x = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rewritten:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *[None] * 5) for i, t in TEXTS], f"doc_id long, text string, {CLASHES}").repartition(3)


def test_cuts_forms_and_texts(docs):
    got = fill_in_middle(docs).withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    want = [(i, *made_by_hand(i, t or "", list(t or "")), t or "") for i, t in TEXTS]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_units_seeds_and_shares(docs):
    own = docs.where("doc_id >= 100")
    words = lambda t: [w + (" " if k < t.count(" ") else "") for k, w in enumerate(t.split(" ")) if w or k < t.count(" ")]
    got = fill_in_middle(own, unit="[^ ]* |[^ ]+", seed=7, rewritten=100, spm=100).collect()
    assert sorted(map(tuple, got)) == sorted((i, *made_by_hand(i, t, words(t), 7, 100, 100)) for i, t in TEXTS if (i or 0) >= 100)
    odd = fill_in_middle(own, unit="[a-z]+").collect()  # no text is made of these alone
    assert {(r.n, r.form, r.prefix_chars) for r in odd} == {(None, "plain", None)}
    with pytest.raises(ValueError, match="empty"):
        fill_in_middle(own, unit="a*")


def test_no_rows(docs):
    assert fill_in_middle(docs.limit(0)).count() == 0
