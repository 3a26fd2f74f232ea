"""HTML extraction: how a host's pages are dealt changes no result."""

import random

import pytest

from tidefut.llm import html_extract


def made_pages():
    """Hosts of marked pages, of unmarked ones and of both; runs that few, half or all pages share; copies, empty pages."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    words = lambda n: " ".join(word() for _ in range(n))
    rows, n = [], 0
    for host, share in (("marked", 1.0), ("plain", 0.0), ("mixed", 0.5)):
        few, half, all_ = words(12), words(9), words(10)
        for k in range(40):
            parts = [all_, words(15)] + ([half] if k % 2 else []) + ([few] if k % 13 == 0 else []) + [words(rng.randint(0, 20))]
            rng.shuffle(parts)
            body = "".join(f"<div>{p}</div>" for p in parts)
            body = f"<article>{body}</article>" if rng.random() < share else body
            rows += [(n, f"http://{host}/{k}", body)] * (12 if k == 3 else 1)
            n += 1
        rows += [(n, f"http://{host}/none", None), (n + 1, f"http://{host}/empty", "<p> </p>"), (n + 2, f"http://{host}/short", "<p>few words here</p>")]
        n += 3
    # a large host whose pages share nothing
    return rows + [(n + k, f"http://lone/{k}", f"<article><p>{words(20)}</p></article>") for k in range(40)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in made_pages()], "page_id long, url string, html string, host string, salt string").repartition(3)


@pytest.fixture(scope="module")
def whole(pages):
    return sorted(map(tuple, html_extract.extract(pages).collect()))


@pytest.mark.parametrize("group_pages", [1, 7])
def test_groups_change_no_result(pages, whole, group_pages):
    assert sorted(map(tuple, html_extract.extract(pages, group_pages=group_pages).collect())) == whole
    texts = {r[1]: r[2] for r in whole}
    plain = {r.url: r.text for r in html_extract.extract(pages, repeats=False).collect()}
    assert len({h for h in ("marked", "plain", "mixed") for k in range(40) if len(texts[f"http://{h}/{k}"]) < len(plain[f"http://{h}/{k}"])}) == 3


def test_sums_of_groups_are_those_of_the_whole():
    rng = random.Random(3)
    for _ in range(60):
        streams = list({tuple(rng.choice("abc") for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 8))})
        streams = [list(s) for s in streams]
        size, cut = rng.randint(2, 5), rng.randint(0, len(streams))
        sums = {}
        for part in (streams[:cut], streams[cut:]):
            if part:
                for p, n in zip(*(x.tolist() for x in html_extract.found_in(part, 1, size)), strict=True):
                    sums[p] = sums.get(p, 0) + n
        import numpy as np

        got = html_extract.covered_by(streams, np.array(list(sums), np.int64), np.array(list(sums.values()), np.int64), size)
        assert [g.tolist() for g in got] == [w.tolist() for w in html_extract.shared_pages(streams, size)]
