import itertools
import os
import re
import time

import numpy as np
import pytest

from quern.llm import crf_html


def test_held_out_pages():
    field, parser = crf_html.default_field(), crf_html._Parser()
    right = total = 0
    for page, labels in crf_html.training_pages(120, seed=77):
        found = field.decode(parser.blocks(page))
        right += sum(a == b for a, b in zip(found, labels, strict=True))
        total += len(labels)
    assert right / total > 0.98


def test_viterbi_matches_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        field = crf_html.Field({}, rng.normal(size=2), rng.normal(size=(2, 2)))
        scores = rng.normal(size=n).tolist()
        field.emission = lambda b: scores[b]

        def value(labels):
            return field.start[labels[0]] + sum(field.step[a][b] for a, b in zip(labels, labels[1:])) + sum(scores[i] for i, x in enumerate(labels) if x)  # noqa: B905, B023

        best = max(itertools.product([0, 1], repeat=n), key=value)
        assert field.decode(list(range(n))) == [bool(x) for x in best]


def test_blocks_and_text():
    page = "<html><body><nav><ul><li><a href=x>Home</a><li><a>News</a></ul></nav><script>var a='<p>no</p>';</script><article><h1>Title &amp; more</h1><p>First  <b>bold</b>\n line&#33;<br>next, with words enough to be prose.<p>Second paragraph,\t with a comma and a stop.</article><div class='ad'>Buy this now</div><footer>&copy; me</footer>"
    blocks = crf_html._Parser().blocks(page)
    assert [b[2] for b in blocks] == ["Home", "News", "Title & more", "First bold line! next, with words enough to be prose.", "Second paragraph, with a comma and a stop.", "Buy this now", "© me"]
    text = crf_html.main_text(page, crf_html.default_field())
    assert text == "\n".join(b[2] for b in blocks[2:5])


def test_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (2, None, ""), (None, "v", "<p>just text, a sentence of several words that ends here."), (3, "w", "<" * 3000 + "<a 'b" * 500), (4, "x", "<div>" * 5000 + "deep"), (5, "y", "plain \x00 &#0; &bogus; text")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'q' as text", "1 as n_chars", "2 as id")
    got = crf_html.extract(df).collect()
    assert len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.id in (1, 2)} == {""}
    assert crf_html.extract(df.where("false")).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/pages.parquet"), reason="needs the test tables")
def test_pages_of_the_tables(spark):
    """The article of these pages is what stands in <article>, one block a paragraph or heading."""
    got = {r.page_id: r for r in crf_html.op5_crf_html(spark, "/root/testdata/sf0.01").collect()}
    exact = 0
    for page in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        pieces = [crf_html.entities.unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")) for p in re.split(r"</?(?:p|h1|h2|li|ul)>", inner)]
        want = "\n".join(" ".join(p.split()) for p in pieces if p.strip())
        assert got[page.page_id].n_chars == len(got[page.page_id].text)
        exact += got[page.page_id].text == want
    assert exact >= 0.99 * len(got)


def test_text_in_other_elements_is_judged():
    field = crf_html.default_field()
    prose = "A sentence of the article, with words enough to be prose and a stop."
    inside = lambda x: crf_html.main_text(f"<article><p>{prose}</p>{x}<p>{prose}</p></article>", field).split("\n")
    assert inside(f"<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be {prose}</p>")[1] == f"Let x=2 be {prose}"
    assert len(inside(f"<noscript><p>{prose}</p></noscript>")) == 3
    assert len(inside("<script>var a = '<p>no</p>'</script><style>p{}</style><textarea>no</textarea>")) == 2
    assert len(inside(f"<object><p>{prose}</p>")) == 3  # never closed, and nothing is lost
    assert inside("<x-note>small print</x-note>")[-1] == prose


@pytest.mark.parametrize("page", ["<a 'b" * 60_000, "<a 'b" * 60_001 + ">", "<a =\"x' >" * 40_000, "<div>" * 60_000 + "</b>" * 60_000, "<b>" + "<div>" * 60_000 + "</b>" * 60_000, "<i>" * 60_000 + "</u>" * 60_000, "<div>" * 60_000 + "<option>" * 60_000, "<" * 300_000, "<!--" * 90_000, "<x1><x2>" * 40_000 + "text", "".join(f"<z{i}>" for i in range(30_000))])
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    crf_html._Parser().blocks(page)
    assert time.process_time() - began < 5
