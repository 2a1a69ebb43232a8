"""Names that hold a word of frames beside others, and frames planted in articles."""

from chunkline.llm import html_text


def texts(spark, pages):
    d = spark.createDataFrame([(i, f"http://h.example/a/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_text.extract(d).collect()}


def test_text_under_such_names_stays(spark):
    page = lambda i: f"""<html><body><article><h1>Title {i}</h1><div class="comment-on-policy">On policy {i}</div><p class="ad-hoc">Ad hoc {i}</p>
<div id="menu-reform">Reform {i}</div><p class="banner-history">History {i}</p><p id="ad-2 x">Other {i}</p></article></body></html>"""  # noqa: E731
    got = texts(spark, map(page, range(5)))
    assert all(got[i].split("\n\n") == [f"Title {i}", f"On policy {i}", f"Ad hoc {i}", f"Reform {i}", f"History {i}"] for i in range(5))


def test_frames_in_articles_go(spark):
    page = lambda i: f"""<html><body><article><h1>Title {i}</h1><div class="promo-of-week">The offer of the week</div><p>Text {i} of the <a href="/x">town</a></p>
<ul><li><a href="/s">Share this page</a></li><li><a href="/m">Mail it</a></li></ul><p>See <a href="/own">only here {i}</a></p><div class="comment-list"><p>Nice {i}</p></div>
<div class="sidebar-left wide">Side {i}</div><div class="commentBody">Me too {i}</div><p>Shared quotation</p></article></body></html>"""  # noqa: E731
    got = texts(spark, map(page, range(5)))
    assert all(got[i].split("\n\n") == [f"Title {i}", f"Text {i} of the town", f"See only here {i}", "Shared quotation"] for i in range(5))
