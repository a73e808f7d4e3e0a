"""Articles within elements of telling names, and pages without any name, are found; what stands around them is not."""

from __future__ import annotations

import pytest

from syncwright.llm import html_crf

TEXTS = ["A title here", "This is the first paragraph, with some prose in it.", "And a second one follows, which is longer than the first one was."]
ARTICLE = f"<article><h1>{TEXTS[0]}</h1><p>{TEXTS[1]}</p><p>{TEXTS[2]}</p></article>"


@pytest.mark.parametrize(
    "around",
    [
        '<div class="site">%s</div>',
        '<div class="widget-area">%s</div>',
        '<body class="has-sidebar header-fixed">%s</body>',
        '<body id="blog" class="single menu-open"><div class="promo-page">%s</div></body>',
        '<div class="site"><header class="site-header"><a href=/>Home</a></header>%s<footer class="site-footer">&copy; X Y</footer></div>',
        '<body><div class="widget-area">%s</div><div class="sidebar"><p>Other stories to read, about many things.</p></div></body>',
        '<div id="page" class="hfeed site"><div class="menu"><a href=1>One</a><a href=2>Two</a></div><div class="site-content">%s</div></div>',
        '%s<section class="comments"><h3>Replies</h3><article class="comment"><p>I liked this very much, thank you for writing it.</p></article><article class="comment"><p>Me too, it was good.</p></article></section>',
    ],
)
def test_article_within_anything(around):
    assert html_crf.main_text(around % ARTICLE, html_crf.trained()).split("\n") == TEXTS


def test_pages_without_names():
    model = html_crf.trained()
    assert html_crf.main_text("Just a text without any element. It has two sentences, and no more.", model).startswith("Just a text")
    lines = ["First paragraph of the text, which goes on for a while.", "Second one, it also has some words and a stop."]
    assert html_crf.main_text("<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>", model).split("\n") == lines


def test_names_of_paragraphs_in_an_article():
    page = '<article><h1>T</h1><p class="comment-intro">An introduction, of a sentence or two. Here it is.</p><p>Then more text follows in the article.</p></article>'
    assert html_crf.main_text(page, html_crf.trained()).split("\n") == ["T", "An introduction, of a sentence or two. Here it is.", "Then more text follows in the article."]


def test_stages_for_other_names_of_the_id(spark):
    import random

    from syncwright.llm import decontaminate, near_dedup, quality_classifier

    draw = random.Random(9)
    text = lambda n: " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(n))
    item, doc = text(30), text(60)
    docs = spark.createDataFrame([(1, doc), (2, doc), (3, f"{text(20)} {item} {text(20)}"), (4, text(50))], "k long, text string")
    assert sorted(r["k"] for r in near_dedup.one_of_each_group(docs, id_col="k").collect()) == [1, 3, 4]
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r["k"] for r in decontaminate.clean_of(docs, benchmark, id_col="k").collect()) == [1, 2, 4]
    labels = spark.createDataFrame([(k, 1) for k in range(1, 5)], "doc_id long, quality int")
    assert quality_classifier.accepted(docs, labels, id_col="k").columns == ["k", "text"]


def test_copies_with_every_fourth_word_changed_are_found(spark):
    import random

    from syncwright.llm import decontaminate

    draw = random.Random(10)
    word = lambda: "".join(draw.choices("abcdefghij", k=7))
    item = [word() for _ in range(40)]
    edited = [word() if k % 4 == 3 else w for k, w in enumerate(item)]
    pairs = [word() if k % 2 else w for k, w in enumerate(item)]
    rows = [(1, " ".join([word() for _ in range(50)] + edited + [word() for _ in range(50)])), (2, " ".join(pairs)), (3, " ".join(word() for _ in range(90)))]
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(1, 5)] and found[0]["score"] >= 0.6
