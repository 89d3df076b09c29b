import itertools
import math

import pytest

from langshift.llm.content_tree import Model, extract, kind, main_text, marginals, train, true_labels
from langshift.llm.dom_tree import joined, look, parse
from langshift.llm.labelled_pages import labelled_pages


@pytest.fixture(scope="module")
def model(spark):
    return train(spark.createDataFrame([(p,) for p in labelled_pages()], "html string").repartition(4))


def test_messages_give_exact_marginals(model):
    page = parse('<body><div class="ad">x y.</div><article><h1>A</h1><p>Some text.<p>More.</article><footer>z</footer></body>')
    n = len(page.nodes)
    weight = [0.4 * model.odds.get(f"look={look(x)}", 0.0) + sum(model.odds.get(f"name={m}", model.odds["name=*"]) for m in x.names) for x in page.nodes]
    totals = [[0.0, 0.0] for _ in range(n)]
    for labels in itertools.product((0, 1), repeat=n):
        log = (model.root + weight[0]) * labels[0]
        for i in range(1, n):
            tie = model.ties.get(kind(page.nodes[i])) or model.ties["*"]
            log += tie[labels[page.nodes[i].parent]][labels[i]] + weight[i] * labels[i]
        for i in range(n):
            totals[i][labels[i]] += math.exp(log)
    assert marginals(page, model) == pytest.approx([math.log(yes / no) for no, yes in totals], abs=1e-6)


def test_held_out_pages(model):
    pages = labelled_pages(200, seed=77)
    right = 0
    for html in pages:
        page = parse(html)
        right += main_text(html, model) == joined(page, [x == 1 for x in true_labels(page)])
    assert right >= 0.95 * len(pages)


CASES = {
    "": "",
    "just a few words without markup, as long as a sentence.": "just a few words without markup, as long as a sentence.",
    "<article><p>A &amp; b&nbsp;&eacute; &#x41;<b>c</b>\n\n d</p><p>Next<br>line</article>": "A & b é Ac d Next line",
    '<html><body><nav><a href="/">Home</a></nav><article><h1>T</h1><p>Cut off te': "T Cut off te",
    "<body><article><p>One is here.</p><script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>Two too.</p></article>": "One is here. Two too.",
    '<body><div class="cookie-banner">We use cookies. <button>OK</button></div><div id="content"><h1>T</h1><p>Text one is here.</p>'
    '<div class="ad">Buy now!</div><p>Text two.</p></div></body>': "T Text one is here. Text two.",
    "<body><header><h1>Site</h1><p>Tag line</p></header><main><h1>Title</h1><p>Para one is long enough. Really.</p><p>Second one.</p></main>"
    '<section id="comments"><h2>Comments</h2><div class="comment"><p>I disagree with this. Strongly.</p></div></section>'
    "<form><label>Name</label><input></form><footer>(c) 2020</footer></body>": "Title Para one is long enough. Really. Second one.",
}


@pytest.mark.parametrize("html", CASES)
def test_cases(model, html):
    assert main_text(html, model) == CASES[html]


def test_pages_of_the_table(spark, model, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    rows = extract(pages, model).collect()
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for row in rows:
        page = parse(html[row["page_id"]])
        inside = [False] * len(page.nodes)
        for i, node in enumerate(page.nodes):
            inside[i] = node.tag == "article" or (node.parent >= 0 and inside[node.parent])
        assert row["text"] == joined(page, inside) and row["n_chars"] == len(row["text"])


def test_odd_rows(spark, model):
    long = "<article>" + "<p>word word word.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>hello there.</p>", "x"), (3, "u", long, "x"), (3, "u", long, "x"), (4, "u", "<" * 5000, "x"), (5, "u", "<a " * 3000 + '"', "x")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    assert by_id[1]["text"] == by_id[2]["text"] == "" and by_id[1]["n_chars"] == 0
    assert by_id[3]["n_chars"] == 20_000 * 16 - 1
    assert extract(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def test_untrained_model_is_defined(spark):
    model = train(spark.createDataFrame([], "html string"))
    assert isinstance(model, Model) and isinstance(main_text("<p>x</p>", model), str)


def whole(html):
    page = parse(html)
    return joined(page, [True] * len(page.nodes))


def test_text_in_and_after_foreign_elements_is_kept():
    assert whole("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p>") == "Let x=2 hold."
    for tag in ("math", "object", "svg", "noscript"):
        assert whole(f"<div>a <{tag} class=k>b</div><p>c</p>") == "a b c"
        assert whole(f"<div>a <{tag}>b <{tag}>c</{tag}> d</{tag}> e</div>") == "a b c d e"
    assert whole("<div>a <iframe src=x> b</div><p>c</p>") == "a b c"
    assert whole("<div>a <template>b<template>c</template>d</template> e</div>") == "a e"
    assert whole("<div>a <iframe>b</iframe> e<script>f</script></div>") == "a e"
    page = parse('<p><svg><path id="q" d="z"/><text>b</text></svg> c</p>')
    assert [(node.tag, node.text) for node in page.nodes if node.tag == "path"] == [("path", 0)]


def test_references_end_with_their_piece_of_text():
    assert whole("<p>AT&am<b>p;</b> T</p>") == "AT&amp; T"
    assert whole("<p>AT&amp;<b>T</b> &l<!-- x -->t; &lt;i&gt;</p>") == "AT&T &lt; <i>"
