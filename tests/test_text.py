import pytest
from pyspark.sql import functions as F

from tradewind.functions import text
from tradewind.operators import entities, pages


def one(spark, column, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(column.alias("out")).first()[0]


@pytest.mark.parametrize(
    "reply, want",
    [("I am not interested", "negative"), ("Very interested, call me", "positive"), ("ok", "neutral"), ("We will see about it", "neutral"), (None, "neutral")],
)
def test_sentiment(spark, reply, want):
    assert one(spark, text.sentiment(F.col("t").cast("string")), t=reply) == want


def test_string_leaves_skip_keys_and_numbers(spark):
    doc = '{"a": "one", "n": 5, "list": ["two", {"b": "th\\"ree"}]}'
    assert one(spark, text.string_leaves(F.col("j")), j=doc) == 'one two th"ree'


def test_sku_patterns_in_order(spark):
    assert one(spark, text.sku(F.col("t")), t="Bar 12 pack, 40g each") == "size:40g"
    assert one(spark, text.sku(F.col("t")), t="Bar 12 pack") == "quantity:12 pack"
    assert one(spark, text.sku(F.col("t")), t="nothing here") is None


def test_price_range(spark):
    got = one(spark, text.price_range(F.col("t")), t="€10.50 - €20")
    assert (got["currency"], got["low"], got["high"]) == ("€", 10.5, 20.0)


@pytest.mark.parametrize("url, want", [
        ("Example.COM/x", "https://example.com"),
        ("http://a.b:80/c?d", "http://a.b"),
        ("https://shop.example.com:8443/a", "https://shop.example.com:8443"),
        ("http://u@h.com/", "http://h.com"),
        ("", None),
    ],)
def test_origin(spark, url, want):
    assert one(spark, text.origin(F.col("u")), u=url) == want


def test_origin_and_path_only_for_http(spark):
    assert one(spark, text.origin_and_path(F.col("u")), u="https://A.b/c/?q=1") == "https://a.b/c/"
    assert one(spark, text.origin_and_path(F.col("u")), u="https://A.b") == "https://a.b/"
    assert one(spark, text.origin_and_path(F.col("u")), u="ftp://a.b/c") is None


def test_small_parsers(spark):
    assert one(spark, text.employees(F.col("t")), t="11-50 employees") == 31
    assert one(spark, text.employees(F.col("t")), t="1,001-5,000 employees") == 3001
    assert one(spark, text.employees(F.col("t")), t="11\u201350") == 31
    assert one(spark, text.employees(F.col("t")), t="5") is None
    assert one(spark, text.slug(F.col("u")), u="https://www.foo-bar.com/x") == "foo-bar"
    assert one(spark, text.tld_country(F.col("u")), u="https://shop.example.nl") == "NL"
    assert one(spark, text.tld_country(F.col("u")), u="https://shop.example.com") is None
    assert one(spark, text.locale_number(F.col("t")), t="1.234") == 1234
    assert one(spark, text.rating(F.col("t")), t="4,6 von 5 Sternen") == 4.6
    assert one(spark, text.error_code(F.col("t")), t="Request TIMEOUT 429") == "TIMEOUT"
    assert one(spark, text.clean_category(F.col("t")), t="  Men's   Clothing! ") == "mens clothing"


def test_json_leaves_are_decoded(spark):
    assert one(spark, text.string_leaves(F.col("j")), j='{"a": "caf\\u00e9 \\"x\\"", "b": ["y\\nz"]}') == 'café "x" y\nz'


def test_meta_in_any_order_and_quotes(spark):
    page = "<title>A &amp; B</title><meta content='one &lt; two' name='Description'><meta property=\"og:title\" content=\"T\">"
    assert one(spark, text.meta(F.col("h"), "name", "description"), h=page) == "one < two"
    assert one(spark, text.meta(F.col("h"), "property", "og:title"), h=page) == "T"
    assert one(spark, text.meta(F.col("h"), "property", "og:site_name"), h=page) is None
    assert one(spark, text.title(F.col("h")), h=page) == "A & B"


HTML = """<html><head><title>Shop | Acme Foods</title><meta property="og:site_name" content="Acme"></head>
<body><img src="a" alt="Nordic Trade"><img alt="logo small"><ul><li>Baltic <b>Import</b></li><li>7 days</li></ul><h2>Brand A</h2>
<a href="/about">About</a><a href="/stock">Where to buy</a>
<div class="card" data-code="B000000001"><b>First</b><i>#1</i></div><div class="card" data-code="B000000001"><b>Again</b><i>#2</i></div>
<div class="card" data-code="B000000002"><b>Second</b><i>#3</i></div></body></html>"""


def test_page_extraction(spark):
    page = spark.createDataFrame([(1, "https://acme.example.com/x", HTML)], "page_id int, url string, html string")
    meta = pages.page_meta(page).first()
    assert (meta["title"], meta["display_name"], meta["is_platform"]) == ("Shop | Acme Foods", "Acme", False)
    row = page.select(
        text.company_names(F.col("html")).alias("c"), text.brand_names(F.col("html")).alias("b"), text.first_link(F.col("html"), ["where to buy"]).alias("l")
    ).first()
    assert row["c"] == ["Nordic Trade", "Baltic Import"] and row["b"] == ["Nordic Trade", "Brand A"] and row["l"] == "/stock"


def test_cards_keep_the_first_per_code(spark):
    page = spark.createDataFrame([(1, HTML)], "page_id int, html string")
    fields = {"code": r'data-code="([^"]*)"', "title": r"<b>(.*?)</b>", "rank": r"<i>#(\d+)</i>"}
    rows = pages.product_cards(page, r'(?is)(<div class="card".*?</div>)', fields).orderBy("code").collect()
    assert [(r["code"], r["title"], r["rank"]) for r in rows] == [("B000000001", "First", "1"), ("B000000002", "Second", "3")]


def test_substring_match_equals_brute_force(spark):
    names = [(i, n) for i, n in enumerate(["Nordic Trade GmbH", "Trade House", "Alfa-Import", "alfa import co", "Zeta", "The Alfa Import Group"])]
    asked = ["trade", "ALFA-IMPORT!", "alfa import", "zet", "ab", "nothing", "house"]
    targets = spark.createDataFrame(names, "id long, name string")
    got = {r["name"]: r["id"] for r in entities.substring_match(spark.createDataFrame([(a,) for a in asked], "name string"), targets).collect()}
    import re

    def brute(q):
        q = re.sub(r"[^a-z0-9\s]", "", q.lower()).strip()
        hits = [i for i, n in names if len(q) >= 3 and q in re.sub("[^a-zA-Z0-9 ]", "", n).lower()]
        return min(hits) if hits else None

    assert got == {a: brute(a) for a in asked}


def test_substring_candidates_grow_in_proportion_and_lose_nothing(spark):
    def pairs(n):
        names = spark.range(n).select("id", F.format_string("Supplier#%09d", F.col("id")).alias("name"))
        queries = names.withColumn("name", F.when(F.col("id") % 3 == 0, F.substring("name", 10, 9)).otherwise(F.col("name")))
        return entities.substring_candidates(queries, names).count()

    assert pairs(4000) <= 5 * pairs(1000)
    targets = [(1, "Acme Trading Co"), (2, "acme"), (3, "North Acme Trading"), (4, "me")]
    wanted = {"acme": 1, "Acme Trading": 1, "North acme": 3, "me": None, "e t": 1, "Trading Company Limited": None}
    got = entities.substring_match(spark.createDataFrame([(k,) for k in wanted], "name string"), spark.createDataFrame(targets, "id int, name string"))
    assert {r["name"]: r["id"] for r in got.collect()} == wanted
