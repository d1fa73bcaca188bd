import html
import itertools
import random
import re

import numpy as np

from cortexlake.llm import html_pages as P
from cortexlake.llm import html_text as H
from cortexlake.llm.boosting import fit_trees

from tests.llm.helpers import DATA


def plain(article):
    """The text of a simple article: blocks end where h1 or p begin or end."""
    article = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>|<(div class=\"ad\")>.*?</div>", "", article, flags=re.S)
    parts = re.split(r"</?(?:h[1-6]|p|article|ul|li)\b[^>]*>", article.replace("<br>", " "))
    texts = (" ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", "", x)).split()) for x in parts)
    return "\n\n".join(x for x in texts if x)


def test_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r for r in H.main_text(pages).collect()}
    for k, x in source.items():
        m = re.search(r"<article>(.*?)</article>", x or "", re.S)
        assert got[k].text == (plain(m[1]) if m else got[k].text) and got[k].n_chars == len(got[k].text)


def test_unseen_generated_pages():
    r = random.Random(99)
    trees = [H.Tree(P.page(r), marked=True) for _ in range(200)]
    model, right, size = H.trained(), 0, 0
    for t in trees:
        keep = H.chosen(t, model.margin(H.features(t)).tolist())
        for node, text in t.blocks:
            right += len(text) * (keep[node] == bool(t.labels()[node]))
            size += len(text)
    assert right / size > 0.97


def test_decoding_is_the_best_consistent_labelling():
    r = random.Random(4)
    for _ in range(50):
        t = H.Tree("")
        n = r.randint(1, 9)
        t.parent = [-1, *(r.randrange(i) for i in range(1, n))]
        margin = [r.uniform(-2, 2) for _ in range(n)]
        got = H.chosen(t, margin)
        fits = lambda y: all(y[t.parent[i]] or not y[i] for i in range(1, n))
        value = lambda y: sum(m for m, v in zip(margin, y) if v)
        assert fits(got) and abs(value(got) - max(value(y) for y in itertools.product((0, 1), repeat=n) if fits(y))) < 1e-9


def test_lenient_parsing():
    t = H.Tree("<p>one <b>two<br>three<p>four &amp; f&uuml;nf<ul><li>a<li>b</ul>tail <a href='x>y'>link</a><!-- no --><script>if (a<b) no</script> end<div")
    assert [x for _, x in t.blocks] == ["one two three", "four & fünf", "a", "b", "tail link end"]
    assert H.Tree("<h1>a</h2>b").blocks[1][0] == 0


PAGES = {
    # Without an <article>, with the attribute that generated pages use as their mark.
    """<html><body><nav><a href=/>Home</a> <a href=/a>About us</a></nav><div class="content" data-main="app"><h1>Tides &amp; harbours</h1>
    <p>Twice a day the water leaves the harbour, and the boats lie down in the mud, waiting. Nobody minds; it has been so for ages.</p>
    <p data-main="">The old pilots, of whom there are few left, tell the hour by the smell of the weed.</p></div>
    <div class="sidebar"><ul><li><a href=/x>Other news</a></li><li><a href=/y>More of it</a></li></ul></div>
    <footer DATA-MAIN=0>&copy; 2020 The Harbour</footer></body></html>""": "Tides & harbours\n\nTwice a day the water leaves the harbour, and the boats lie down in the mud, waiting. Nobody minds; it has been so for ages."
    "\n\nThe old pilots, of whom there are few left, tell the hour by the smell of the weed.",
    """<body><header><h1>Site</h1></header><main><h2>How to bake</h2><p>Flour, water, salt and time are all that a loaf needs, and of these the last is dearest.</p>
    <div class="ad"><p>Buy our flour now!</p></div><p>Knead it for ten minutes, let it rest, and knead it once more before it goes into the tin.</p></main>
    <section class="comments"><h3>Comments</h3><div class="comment"><p>Mine never rises, what am I doing wrong?</p></div></section></body>""":
    "How to bake\n\nFlour, water, salt and time are all that a loaf needs, and of these the last is dearest.\n\nKnead it for ten minutes, let it rest, and knead it once more before it goes into the tin.",
}


def test_pages_written_by_hand():
    assert H.texts_of(list(PAGES), H.trained()) == list(PAGES.values())


def test_very_long_and_deep_pages():
    long = "<article>" + "".join(f"<p>Sentence number {k}, which is quite long enough to be part of the text.</p>" for k in range(20000)) + "</article>"
    deep = "<div>" * 3000 + "<p>Down here, where nobody looks, there is a sentence of some length.</p>" + "</div>" * 3000
    out = H.texts_of([long, deep], H.trained())
    assert out[0].count("\n\n") == 19999 and len(out) == 2


def test_trees_learn_a_known_function():
    g = np.random.default_rng(3)
    x = g.uniform(-1, 1, (4000, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] < -0.3)).astype(float)
    trees = fit_trees(x[:3000], y[:3000])
    assert ((trees.margin(x[3000:]) > 0) == (y[3000:] > 0)).mean() > 0.97
    assert (fit_trees(x, np.ones(len(x))).margin(x) > 3).all()


def test_odd_rows_and_nothing(spark):
    rows = [(1, "u", None, 1), (1, "u", None, 1), (2, None, "", 1), (None, "x", "<p", 1), (4, "y", "<div>" * 5000 + "deep", 1), (5, "z", "no markup", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    got = H.main_text(df).collect()
    assert len(got) == len(rows) and [r.text for r in got[:4]] == [""] * 4
    assert H.main_text(df.filter("false")).count() == 0


def test_comments_that_end_themselves_and_titles_anywhere():
    text = lambda source: [x for _, x in H.Tree(source).blocks]
    assert text("<p>a</p><!--><p>b</p><!---><p>c</p><!-- x --!><p>d</p><!-- y -- > z --><p>e</p>") == ["a", "b", "c", "d", "e"]
    assert text("<body><title>Not < text</title><p>one</p><TITLE lang=en>nor this</TITLE ><p>two</p><title>open<p>three</p>") == ["one", "two", "three"]
    assert text("<!-- never ended <p>a</p>") == [] and text("<p>a<!--x") == ["a"]
