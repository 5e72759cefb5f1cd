import html
import re

import numpy as np
import pytest

from weftgraph.llm import htmltext


@pytest.fixture(scope="module")
def model(spark):
    return htmltext.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def gold(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def test_articles_of_pages_that_were_not_sampled(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = pages.collect()
    got = {r.page_id: r.text for r in htmltext.extract(pages, model).collect()}
    assert np.mean([got[r.page_id] == gold(r.html) for r in rows]) > 0.99


def test_held_out_layouts(model):
    r, pages, labels = np.random.default_rng(77), [], []
    for _ in range(200):
        page, y = htmltext.made_page(r)
        pages.append(htmltext.blocks(page))
        labels.append(np.array(y))
        assert len(pages[-1]) == len(y)
    assert np.mean(np.concatenate(model.main(pages)) == np.concatenate(labels)) > 0.97


def test_block_reader_survives_odd_markup():
    page = '<div title="a > b">x &amp; y&nbsp; z<br>w<script>var t="</p>";</script><p>one<p>two</div></em></p>tail <b>bold<!-- no --><unclosed'
    assert [b[0] for b in htmltext.blocks(page)] == ["x & y z w", "one", "two", "tail bold"]
    assert htmltext.blocks(None) == htmltext.blocks("") == htmltext.blocks("<style>p{}") == htmltext.blocks("<") [:0] == []
    assert [b[0] for b in htmltext.blocks("a < b <1 & c")] == ["a < b <1 & c"]


def test_gradients_match_differences():
    r = np.random.default_rng(1)
    pages = [htmltext.blocks(htmltext.made_page(r)[0]) for _ in range(3)]
    flat, sizes = htmltext.vectors(pages), np.array([len(p) for p in pages])
    y = r.integers(0, 2, sizes.sum()).astype(np.float32)
    m = htmltext.Labeller()
    for name in ("path", "word", "wx", "wh", "b", "out", "out_b"):
        setattr(m, name, getattr(m, name).astype(np.float64))
    grads = m.gradients(flat, sizes, y)

    def loss():
        z = m.forward(m.inputs(flat), sizes)
        return np.mean(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)

    for p, g in zip(m.params[2:], grads[2:], strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = p[at], 1e-3
        p[at] = old + e
        up = loss()
        p[at] = old - e
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * e) - g[at]) < 2e-2 * abs(g[at]) + 1e-4


def test_null_empty_long_repeated_and_clashing(spark):
    long = "<article>" + "<p>word and word.</p>" * 3000 + "</article>"
    rows = [(1, "u", None, 1), (2, None, "", 1), (3, "u", long, 1), (3, "u", long, 1), (None, "u", "<nav><a>x</a></nav>", 1)]
    out = htmltext.op3(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(out) == 5 and {r.text for r in out if r.page_id in (1, 2)} == {""}
    assert all(r.n_chars == len(r.text) for r in out)
    assert htmltext.op3(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
