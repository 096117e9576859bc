import math
import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import htmltext


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return htmltext.fit(pages)


def test_blocks_of_broken_markup():
    page = ("<!DOCTYPE html><title>no</title><style>p{}</style><body class=x><nav id='top menu'><ul><li><a href=\"/a>b\">one</a><li>two</ul></nav>"
            "<script>var t='</p>';</script><article><h1>A &amp;\n B</h1><p>x <b>y<br>z<p>w&nbsp;&#233;&lt;i&gt;<!-- no --></article>tail<p cl")
    got = [(path[-1], text) for path, text, _ in htmltext.blocks(page)]
    assert got == [("li", "one"), ("li", "two"), ("h1", "A & B"), ("p", "x y z"), ("p", "w é<i>"), ("x", "tail")]
    assert htmltext.blocks(page)[0][2] == 1.0 and "menu" in htmltext.blocks(page)[0][0]
    assert htmltext.blocks(None) == htmltext.blocks("") == htmltext.blocks("<p>") == []


def test_gradients():
    rng = np.random.default_rng(0)
    x, first = rng.normal(size=(7, 5)), np.array([0, 4, 4, 7])
    weights = rng.normal(size=(5 + htmltext.HIDDEN + 1, 4 * htmltext.HIDDEN)) * 0.3
    aim = rng.normal(size=(7, htmltext.HIDDEN))
    for backward in (False, True):
        steps = htmltext._steps(first, backward)
        _, trace = htmltext._run(x, steps, weights, True)
        dw, dx = htmltext._back(x, aim, trace, weights)
        for array, grad, at in ((weights, dw, (3, 9)), (weights, dw, (8, 40)), (weights, dw, (-1, 2)), (x, dx, (2, 1))):
            kept, values = array[at], []
            for move in (1e-6, -1e-6):
                array[at] = kept + move
                values.append((htmltext._run(x, steps, weights, False)[0] * aim).sum())
            array[at] = kept
            assert abs((values[0] - values[1]) / 2e-6 - grad[at]) < 1e-5


def test_articles_are_found_whole(pages, model):
    rows = [r.html for r in pages.collect()]
    got = htmltext.extract(rows, model)
    for page, text in zip(rows, got):
        inside = page.split("<article>", 1)[1].split("</article>")[0].split("<footer>")[0]
        plain = re.sub(r"<[^>]*>?", "\0", re.sub(r"</?b>", "", inside))
        assert text == " ".join(html.unescape(plain.replace("\0", " ")).split())


def test_kinds_the_sample_lacks(model):
    words = "In the of and thing here with that from."
    page = (f"<body><header><p>{words}</p></header><main><p>{words} one</p><aside class='sidebar'><p>{words}</p></aside><p>{words} two</p></main>"
            f"<div class='cookie notice'>{words}</div><section class='comments'><div class='comment'><p>{words}</p></div></section><form><p>{words}</p></form><footer>{words}</footer>")
    assert htmltext.extract([page], model) == [f"{words} one {words} two"]


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "<p>" * 20_000 + "x"), (4, "plain text"), (None, "<article><p>a</article>"), (None, "<article><p>a</article>"), (5, "<a href=\"" * 500)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(1)).withColumn("found", F.lit(2))
    got = htmltext.main_text(df, model)
    assert got.columns == df.columns and got.count() == len(rows)
    found = {(r.page_id, (r.html or "")[:3]): r.text for r in got.collect()}
    assert found[1, ""] == found[2, ""] == "" and found[None, "<ar"] == "a"
    assert htmltext.main_text(df.limit(0), model).count() == 0
    htmltext.fit(df.limit(0))


def test_predictions_against_scalar_steps():
    """The batched network gives what one block after another, one number at a time, gives."""
    rng = np.random.default_rng(12)
    width = htmltext.PATH_DIM + htmltext.WORD_DIM + htmltext.COUNTS
    hidden = htmltext.HIDDEN
    model = htmltext.Model(
        path=rng.normal(size=(htmltext.PATH_BUCKETS, htmltext.PATH_DIM)), word=rng.normal(size=(htmltext.WORD_BUCKETS, htmltext.WORD_DIM)),
        gates=rng.normal(scale=0.4, size=(2, width + hidden + 1, 4 * hidden)), out=rng.normal(size=2 * hidden + 1),
    )
    block = lambda: (tuple(rng.choice(["html", "div", "p", "nav", "article", "x1"], size=rng.integers(1, 5))), " ".join(rng.choice(["one", "two.", "three", "über"], size=rng.integers(1, 6))), float(rng.random()))
    pages = [[block() for _ in range(n)] for n in (3, 1, 0, 6, 2)]
    parts, path_first, hashed, word_first, counts, first = htmltext._inputs(pages)
    sigmoid = lambda v: 1 / (1 + math.exp(-v))

    def mean(table, buckets, bounds, k):
        own = buckets[bounds[k]:bounds[k + 1]]
        return [sum(table[b][d] for b in own) / max(1, len(own)) for d in range(table.shape[1])]

    got = htmltext.predict(pages, model)
    for page, (a, b) in enumerate(zip(first, first[1:])):
        rows = [[*mean(model.path, parts, path_first, k), *mean(model.word, hashed, word_first, k), *counts[k]] for k in range(a, b)]
        states = []
        for backward in (False, True):
            weights, h, c, own = model.gates[int(backward)], [0.0] * hidden, [0.0] * hidden, {}
            for t in (reversed(range(len(rows))) if backward else range(len(rows))):
                z = [sum(v * weights[k][j] for k, v in enumerate([*rows[t], *h, 1.0])) for j in range(4 * hidden)]
                i, f, o = ([sigmoid(v) for v in z[n * hidden:(n + 1) * hidden]] for n in range(3))
                g = [math.tanh(v) for v in z[3 * hidden:]]
                c = [f[k] * c[k] + i[k] * g[k] for k in range(hidden)]
                h = [o[k] * math.tanh(c[k]) for k in range(hidden)]
                own[t] = h
            states.append(own)
        want = [sigmoid(sum(v * w for v, w in zip([*states[0][t], *states[1][t], 1.0], model.out))) for t in range(len(rows))]
        assert np.allclose(got[page], want, atol=1e-9)
