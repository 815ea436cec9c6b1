from urllib.parse import urljoin

from pyspark.sql import functions as F

from tradewind.functions.urls import resolved
from tradewind.operators import cards

CARD = r'(?is)^<\w+[^>]*\sclass="[^"]*card'


def cut(spark, html, selectors=(CARD,), least=1):
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = cards.blocks(pages, "page_id", "html", list(selectors), ["div", "li"], least).orderBy("ordinal").collect()
    return [r["block"] for r in got]


def test_blocks_follow_depth(spark):
    inner = '<div class="card">a<div>b<div>c</div></div></div>'
    other = '<div class="card">d</div>'
    assert [b.rstrip() for b in cut(spark, f"<body><div>{inner} {other}</div><div>tail</div></body>")] == [inner, other]


def test_blocks_nest_and_are_counted_in_page_order(spark):
    assert cut(spark, '<div class="card">a<li class="card">b</li>c</div>x') == ['<div class="card">a<li class="card">b</li>c</div>x', '<li class="card">b</li>c']


def test_broken_markup_ends_a_block_before_the_next_card(spark):
    got = cut(spark, '</div></div><ul><li class="card">a<li class="card">b</li><li class="card">c')
    assert got == ['<li class="card">a', '<li class="card">b</li>', '<li class="card">c']


def test_scripts_and_comments_are_no_markup(spark):
    html = '<script>"<div class=card>"</script><!-- <div class="card"> --><div class="card">a<script>"</div>"</script>b</div>'
    assert cut(spark, html) == ['<div class="card">ab</div>'] and cut(spark, "") == [] and cut(spark, "no tags") == []


def test_first_selector_with_enough_cards(spark):
    html = '<div class="card">a</div><li class="row">b</li><li class="row">c</li>'
    assert len(cut(spark, html, (CARD, r'^<li class="row"'), 2)) == 2 and cut(spark, html, (CARD,), 2) == []


def test_links_resolve_like_the_standard_library(spark):
    bases = ["http://a.example/b/c/d?q=1#f", "https://a.example", "http://a.example/", "http://a.example/b/c/"]
    links = ["g", "./g", "g/", "/g", "//h.example/x", "?y=2", "g?y", "#s", "", "../g", "../../g", "../../../g", "g/./h/../i", ".", "..", "./", "https://z.example/a/../b", "mailto:x@y.example", "g;x=1/../y"]
    rows = [(b, x) for b in bases for x in links]
    got = spark.createDataFrame(rows, "b string, x string").select("b", "x", resolved(F.col("b"), F.col("x")).alias("r")).collect()
    for r in got:
        want = urljoin(r["b"], r["x"]) if r["x"] else r["b"].split("#")[0]
        if r["x"].startswith(("https:", "mailto:")):
            want = r["x"]
        strip = lambda u: u if u.count("/") > 2 or ":" not in u or "//" not in u else u.replace("?", "/?", 1) if "?" in u else u.replace("#", "/#", 1) if "#" in u else u + "/"
        assert r["r"] == strip(want), (r["b"], r["x"])
