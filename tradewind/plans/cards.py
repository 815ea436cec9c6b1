"""Queries over page markup: product and company cards, names in page order, links. Pages that the page table lacks are built from other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradewind.operators import cards, pages
from tradewind.plans.oracle_views import register
from tradewind.plans.registry import query
from tradewind.sources.tables import Tables

PER_PAGE = 40


def _any_of(key: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _page(rows: DataFrame, page: Column, order: str, piece: Column, before: Column, after: str) -> DataFrame:
    """(page_id, html): the rows' pieces in their order; a page takes at most ``PER_PAGE`` rows."""
    listed = rows.groupBy(page.alias("page_id")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), piece.alias("piece")))).alias("pieces"))
    return listed.select("page_id", F.concat(before, F.array_join(F.transform("pieces", lambda x: x["piece"]), "\n"), F.lit(after)).alias("html"))


def product_pages(t: Tables) -> DataFrame:
    """Best-seller lists over the part table: seven languages, lacking parts, repeated codes, every eleventh card never closed."""
    k = F.col("p_partkey")
    number = (k * 37) % 5000
    mark = F.when(k % 2 == 0, ".").otherwise(",")
    count = F.when(number >= 1000, F.concat((number / 1000).cast("long").cast("string"), mark, F.lpad((number % 1000).cast("string"), 3, "0"))).otherwise(number.cast("string"))
    code = F.concat(F.lit("B"), F.lpad((k - F.when((k % 17 == 0) & (k % PER_PAGE > 0), 1).otherwise(0)).cast("string"), 9, "0"))
    unless = lambda n, *parts: F.when(k % n == 0, "").otherwise(F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    card = F.concat(
        F.lit('<li class="zg-item-immersion"><div data-asin="'), code, F.lit('">'),
        unless(5, '<div class="zg-bdg-wrapper"><span class="zg-bdg-text">#', (k % 100).cast("string"), "</span></div>"),
        unless(19, '<a href="', F.when(k % 4 == 1, "https://other.example").otherwise(""), "/dp/", code, '/ref=1">'), unless(13, '<span class="p13n-sc-truncate">', F.col("p_name"), ' &amp; Co</span>'), F.lit("</a>"),
        unless(6, "<span>", count, F.lit(" "), _any_of(k, cards.RATINGS), "</span>"),
        unless(9, '<i><span class="a-icon-alt">', ((k % 41 + 10) / 10).cast("long").cast("string"), mark, (k % 41 % 10).cast("string"), " ", _any_of(k, cards.OUT_OF), " 5</span></i>"),
        unless(8, '<span class="p13n-sc-price">&nbsp;€', F.col("p_size").cast("string"), ",50</span>"),
        F.when(k % 10 == 0, '<span class="a-badge-text">Best</span>').otherwise(""),
        F.when(k % 11 == 0, "").otherwise("</div></li>"),
    )
    before = F.lit('<html><script>var t = "<li data-asin=no>";</script></div><ol id="zg-ordered-list">')
    made = _page(t.read("part"), F.floor(k / PER_PAGE), "p_partkey", card, before, "</ol></html>")
    kind = F.when(F.col("page_id") % 2 == 0, "bestsellers").otherwise("new-releases")
    return made.select("page_id", "html", F.concat(F.lit("https://shop.example/gp/"), kind, F.lit("/x?pg=2")).alias("url"), kind.alias("page_type"))


register("v_product_cards", f"""
SELECT *, 'B' || lpad(CAST(k - CASE WHEN k % 17 = 0 AND k % {PER_PAGE} > 0 THEN 1 ELSE 0 END AS VARCHAR), 9, '0') AS code, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS place,
 CASE WHEN page_id % 2 = 0 THEN 'bestsellers' ELSE 'new-releases' END AS page_type FROM (SELECT p_partkey AS k, p_partkey // {PER_PAGE} AS page_id, p_name, p_size FROM part)""")
register("v_product_fields", f"""
SELECT page_id, code, CASE WHEN k % 13 > 0 THEN p_name || ' & Co' END AS title, CAST(CASE WHEN k % 5 > 0 THEN k % 100 ELSE 2 * place + CASE WHEN k % 11 = 0 THEN 2 ELSE 1 END END AS INTEGER) AS rank,
 CAST(CASE WHEN k % 6 = 0 THEN 0 ELSE k * 37 % 5000 END AS INTEGER) AS reviews, CASE WHEN k % 9 > 0 THEN CAST(k % 41 + 10 AS DOUBLE) / 10 END AS rating,
 CASE WHEN k % 8 > 0 THEN '€' || p_size || ',50' END AS price, CASE WHEN k % 10 = 0 THEN 'Best' END AS badge,
 CASE WHEN k % 19 > 0 THEN CASE WHEN k % 4 = 1 THEN 'https://other.example' ELSE 'https://shop.example' END || '/dp/' || code || '/ref=1' END AS url, page_type
FROM v_product_cards QUALIFY row_number() OVER (PARTITION BY page_id, code ORDER BY k) = 1""")


@query("product_cards", """
SELECT page_id, code, title, rank, reviews, rating, price, badge, url,
 CAST(floor(CASE WHEN page_type = 'new-releases' THEN greatest(0, 100 - rank) + least(reviews / 10.0, 50) ELSE greatest(0, 50 - rank / 2.0) + least(reviews / 50.0, 30) END
 + CASE WHEN rating >= 4.7::DOUBLE THEN 15 WHEN rating >= 4.5::DOUBLE THEN 10 ELSE 0 END + 0.5) AS INTEGER) AS velocity FROM v_product_fields WHERE title IS NOT NULL""")
def product_cards(t: Tables) -> DataFrame:
    return cards.product_cards(product_pages(t))


DIRECTORIES = ["europages", "kompass"]


def company_pages(t: Tables) -> DataFrame:
    """Directory pages over the customer table: three kinds of cards, one stray card of a kind tried earlier, shared hosts, lacking parts."""
    k, per = F.col("c_custkey"), PER_PAGE // 2
    page = F.floor(k / per)
    source = _any_of(page, DIRECTORIES)
    style = lambda *values: _any_of(page, list(values))
    name = F.when(k % 4 == 0, F.concat(F.when(k % 28 == 0, "<h2>x</h2><h3>").otherwise("<h2>"), F.col("c_name"), F.when(k % 28 == 0, "</h3>").otherwise("</h2>")))
    name = name.when(k % 4 == 1, F.concat(F.lit("<h3><b>"), F.col("c_name"), F.lit("</b></h3>"))).when(k % 4 == 2, F.concat(F.lit('<span class="company-name">'), F.col("c_name"), F.lit("</span>")))
    name = name.otherwise(F.concat(F.lit('<a href="/profile/1">'), F.col("c_name"), F.lit("</a>")))
    inner = F.when(k % 2 == 0, F.concat(F.lit('<a href="https://www.'), source, F.lit('.example/c">see</a>'))).otherwise("")
    site = F.when(k % 6 > 0, F.concat(F.lit('<a href="https://Host'), F.floor(k / 2).cast("string"), F.lit('.example/about">site</a>'))).otherwise("")
    tags = F.when(k % 3 == 0, F.concat(F.lit('<div><span class="tag">'), F.col("c_mktsegment"), F.lit('</span><span class="tag">t</span><span class="activity">B2B</span></div>'))).otherwise("")
    card = F.concat(F.lit("<"), style('div class="company-card"', 'article class="big company"', 'li class="result-item"'), F.lit(">"), name, inner, site, tags, F.lit("</"), style("div", "article", "li"), F.lit(">"))
    first = F.when(F.col("page_id") % 3 > 0, '<div class="company-card"><h2>Stray</h2></div>').otherwise("")
    made = _page(t.read("customer"), page, "c_custkey", card, first, "")
    return made.select("page_id", "html", _any_of(F.col("page_id"), DIRECTORIES).alias("source"), F.concat(F.lit("section "), (F.col("page_id") % 5).cast("string")).alias("category"))


register("v_company_cards", f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INTEGER) AS ordinal, c_name AS name, CASE WHEN k % 6 > 0 THEN 'https://Host' || k // 2 || '.example/about' END AS website,
 CASE WHEN k % 6 > 0 THEN 'host' || k // 2 || '.example' END AS host, CASE WHEN k % 3 = 0 THEN c_mktsegment || '|B2B' ELSE 'section ' || page_id % 5 END AS categories
FROM (SELECT c_custkey AS k, c_custkey // {PER_PAGE // 2} AS page_id, c_name, c_mktsegment FROM customer)""")


@query("company_cards", "SELECT * FROM v_company_cards QUALIFY host IS NULL OR row_number() OVER (PARTITION BY host ORDER BY page_id, ordinal) = 1")
def company_cards(t: Tables) -> DataFrame:
    return cards.company_cards(company_pages(t)).withColumn("categories", F.array_join("categories", "|"))


def name_pages(t: Tables) -> DataFrame:
    """List pages over the part table: items, cells and headings in mixed order, nested items, class-marked names."""
    k, name = F.col("p_partkey"), F.col("p_name")
    text = F.concat(name, F.lit(" "), k.cast("string"))
    piece = (
        F.when(k % 6 == 0, F.concat(F.lit("<li>"), text, F.lit("</li>")))
        .when(k % 6 == 1, F.concat(F.lit("<table><tr><td> "), text, F.lit("</td></tr></table>")))
        .when(k % 6 == 2, F.concat(F.lit("<ul><li>"), text, F.lit("<ul><li>in "), k.cast("string"), F.lit("</li></ul></li></ul>")))
        .when(k % 6 == 3, F.concat(F.lit('<div class="top brand-name">'), text, F.lit("</div>")))
        .when(k % 6 == 4, F.concat(F.lit('<img src="x" alt="'), text, F.when(k % 12 == 4, " Logo").otherwise(""), F.lit('"><h3>'), F.col("p_brand"), F.lit("</h3>")))
        .otherwise(F.concat(F.lit("<td>9 "), text, F.lit('</td><span class="our-partners">'), F.col("p_type"), F.lit("</span>")))
    )
    return _page(t.read("part"), F.floor(k / PER_PAGE), "p_partkey", piece, F.lit("<body>"), "</body>")


_ITEMS = "SELECT k, p_name || ' ' || k AS item, p_brand, p_type, page_id FROM (SELECT p_partkey AS k, p_partkey // 40 AS page_id, p_name, p_brand, p_type FROM part)"
_FIRST = "SELECT page_id, string_agg(v, '|' ORDER BY p) AS names FROM (SELECT page_id, v, min(p) AS p FROM ({}) GROUP BY page_id, v) GROUP BY page_id"
register("v_name_alts", f"SELECT page_id, item AS v, k * 3 AS p FROM ({_ITEMS}) WHERE k % 12 = 10")
register("v_company_names", _FIRST.format(f"""
SELECT page_id, v, p FROM v_name_alts UNION ALL SELECT page_id, item, 1000000000 + k * 3 FROM ({_ITEMS}) WHERE k % 6 < 2
UNION ALL SELECT page_id, item || 'in ' || k, 1000000000 + k * 3 FROM ({_ITEMS}) WHERE k % 6 = 2 UNION ALL SELECT page_id, 'in ' || k, 1000000001 + k * 3 FROM ({_ITEMS}) WHERE k % 6 = 2"""))
register("v_brand_names", _FIRST.format(f"""
SELECT page_id, v, p FROM v_name_alts UNION ALL SELECT page_id, item, 1000000000 + k * 3 FROM ({_ITEMS}) WHERE k % 6 = 3
UNION ALL SELECT page_id, p_brand, 1000000000 + k * 3 FROM ({_ITEMS}) WHERE k % 6 = 4 UNION ALL SELECT page_id, p_type, 1000000000 + k * 3 FROM ({_ITEMS}) WHERE k % 6 = 5"""))


@query("page_names", f"""
SELECT p.page_id, coalesce(c.names, '') AS companies, coalesce(b.names, '') AS brands FROM (SELECT DISTINCT p_partkey // {PER_PAGE} AS page_id FROM part) p
LEFT JOIN v_company_names c ON c.page_id = p.page_id LEFT JOIN v_brand_names b ON b.page_id = p.page_id""")
def page_names(t: Tables) -> DataFrame:
    found = cards.page_names(name_pages(t))
    return found.select("page_id", F.array_join("companies", "|").alias("companies"), F.array_join("brands", "|").alias("brands"))


def linked_pages(t: Tables) -> DataFrame:
    """The page table with one more link on three pages of four: a path upwards, a query, and another host."""
    key = F.col("page_id") % 4
    more = F.when(key == 0, '<a href="../where-to-buy?x=1">Go</a>').when(key == 1, '<a class=x href="?tab=1">Our Portfolio</a>').when(key == 2, '<a href="//h.example.net/x">Find us</a>').otherwise("")
    return t.read("pages").withColumn("html", F.concat("html", more))


_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
_PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
_UP = f"regexp_replace(regexp_replace({_PATH}, '[^/]*$', ''), '[^/]*/$', '')"
_PHRASES = lambda phrases: " OR ".join(f"contains(lower(a[1]), '{p}') OR contains(lower(a[2]), '{p}')" for p in phrases)


@query("page_links", f"""
SELECT page_id, list_filter(links, lambda a: {_PHRASES(pages.WHERE_TO_BUY)})[1][1] AS where_to_buy, list_filter(links, lambda a: {_PHRASES(pages.PORTFOLIO)})[1][1] AS portfolio FROM (
 SELECT page_id, list_concat(list_zip(list_transform(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1), lambda h: {_ORIGIN} || h), regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2)),
  CASE page_id % 4 WHEN 0 THEN [({_ORIGIN} || {_UP} || 'where-to-buy?x=1', 'Go')] WHEN 1 THEN [({_ORIGIN} || {_PATH} || '?tab=1', 'Our Portfolio')] WHEN 2 THEN [(split_part(url, '//', 1) || '//h.example.net/x', 'Find us')] ELSE [] END) AS links FROM pages)""")
def page_links(t: Tables) -> DataFrame:
    html, url = F.col("html"), F.col("url")
    return linked_pages(t).select("page_id", pages.first_link(html, url, pages.WHERE_TO_BUY).alias("where_to_buy"), pages.first_link(html, url, pages.PORTFOLIO).alias("portfolio"))
