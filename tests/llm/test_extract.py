"""HTML extraction: parsing, consistent decoding against all choices, planted pages of known and unseen make."""

from __future__ import annotations

import html
import itertools
import random
import re

import numpy as np
import pytest

from tabsonde.llm.extract import Page, decode, extract, features, labelled_page, main_texts, train


@pytest.fixture(scope="module")
def model(spark):
    return train(spark)


def test_parsing():
    page = Page("<!DOCTYPE html><html><head><title>t</p></title><style>p{}</style><script>if(a<b)\"</p>\";</script></head><body "
                "class='x>y'><!-- <p>no --><p>a <b>b<p>c</b> d<ul><li>e<li>f<ul><li>g</ul></ul><table><tr><td>h<td>i<tr><td>j"
                "</table><div id=k>l<br>m & n &lt; 1 < 2</p>o<foot")
    named = [(page.tag[n], t) for n, _, t in page.text if t.strip()]
    assert named == [("p", "a "), ("p", "b"), ("p", "c"), ("p", " d"), ("li", "e"), ("li", "f"), ("li", "g"), ("td", "h"),
                     ("td", "i"), ("td", "j"), ("div", "l"), ("div", "m & n &lt; 1 < 2"), ("div", "o")]
    assert [p >= -1 and p < i for i, p in enumerate(page.parent)] == [True] * len(page.parent)
    for odd in ("", "<", "</", "<p", "text", "<a href='x", "<p/><//><p <b>", "<!--", "<script>x", "</br></nothing>", "<1 <é>"):
        Page(odd)


@pytest.mark.parametrize("seed", range(40))
def test_decoding_is_best(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 11))
    parent = np.array([-1] + [int(rng.integers(0, i)) for i in range(1, n)])
    margin = rng.normal(size=n)
    chosen = decode(margin, parent, np.zeros(n, bool), 0.25)
    best = max(sum(m + 0.25 for m, c in zip(margin[1:], choice) if c)
               for choice in itertools.product([False, True], repeat=n - 1)
               if all(not c or p == 0 or choice[p - 1] for c, p in zip(choice, parent[1:])))
    assert abs((margin + 0.25)[1:][chosen[1:]].sum() - best) < 1e-9
    assert all(p < 0 or not c or chosen[p] for c, p in zip(chosen, parent))


def test_made_pages(model):
    rnd = random.Random(12345)
    made = [labelled_page(rnd) for _ in range(300)]
    right = total = 0
    pages = [Page(source) for source, _ in made]
    assert all(len(p.tag) == len(labels) for p, (_, labels) in zip(pages, made))
    texts = main_texts([source for source, _ in made], model)
    for page, (_, labels), text in zip(pages, made, texts):
        want = {" ".join(t.split()) for n, _, t in page.text if labels[n] and len(t) > 30}
        got = set(text.split("\n"))
        right += sum(any(w in g for g in got) for w in want)
        total += len(want)
    assert right > 0.98 * total


def test_unseen_page(model):
    page = """<html><body><div class="cookie-consent"><p>We use cookies. Accept all of them now, please.</p></div>
    <header class="masthead"><p>Daily Post</p></header><nav class=navbar><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
    <div class="entry-content"><h1>On&nbsp;rivers &amp; lakes</h1><p>The river rose  by two
    metres, which nobody had <b>expected</b>.<p>It fell again after a week, and the town was dry.</div>
    <section id=comments><h3>Comments</h3><div class=comment><p>I was there and saw it all myself, it was bad.</p></div></section>
    <aside class=sidebar><p>Related: <a href=/c>Floods of the past century</a></p></aside>
    <form class=newsletter><input type=text><p>Sign up for news</p></form><footer><p>&copy; 2020 Daily Post</p></footer></body></html>"""
    assert main_texts([page], model) == [
        "On rivers & lakes\nThe river rose by two metres, which nobody had expected.\n"
        "It fell again after a week, and the town was dry."]


def test_odd_rows(spark, model):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<p>"), (4, "u", "<div>" * 3000 + "deep"), (5, "u", "x" * 200_000)]
    frame = spark.createDataFrame([(*r, 3) for r in rows], "page_id long, url string, html string, n_chars int")
    got = extract(frame, model).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] == 1] == ["", ""]
    assert extract(frame.limit(0), model).count() == 0


def test_registered_query(spark):
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r["text"] for r in entry.queries()["op5_html_extraction"](spark, sf).collect()}
    exact = 0
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    for r in rows:
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.DOTALL)
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>|<br>", re.sub(r"<[^>]*\Z|<footer.*", "", inside[1], flags=re.DOTALL)) if inside else []
        want = "\n".join(b for b in (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in blocks) if b)
        exact += got[r["page_id"]] == want
    assert len(got) == len(rows) and exact >= 0.98 * len(rows)
