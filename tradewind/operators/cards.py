"""Repeated cards of a page as rows: nested blocks are cut by tag depth, fields are read by ordered fallbacks.

Tags become rows with their place in the page. Of each tag name the depth is a running sum, so the end of a block is the next
tag that belongs to the same level. A block that is never closed ends before the next card, or with the page.
Script, style and comments are not markup. Pages of any number of cards are one pass; nothing is read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradewind.functions import text
from tradewind.functions.urls import resolved
from tradewind.operators.pages import velocity

_TAG = r"<[^>]*>"
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def blocks(pages: DataFrame, key: str, html: str, selectors: list[str], names: list[str], least: int = 1) -> DataFrame:
    """(key, ordinal, block) of each page's cards, in page order from 0.

    ``selectors`` are patterns of a card's start tag, ``names`` the tag names that cards can have. A page uses the first
    selector that finds at least ``least`` cards.
    """
    clean = pages.select(key, F.regexp_replace(html, _HIDDEN, "").alias("clean"))
    parts = clean.select(key, F.regexp_extract_all("clean", F.lit(_TAG), 0).alias("tags"), F.split("clean", _TAG).alias("texts"))
    named = F.lower(F.regexp_extract("tag", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    opens = ~F.col("tag").startswith("</")
    tags = (
        parts.select(key, F.size("tags").alias("n"), F.posexplode("tags").alias("pos", "tag"))
        .withColumn("name", named)
        .filter(F.col("name").isin(names) & ~F.col("tag").rlike(r"/>$"))
        .withColumn("open", opens)
    )
    order = Window.partitionBy(key, "name").orderBy("pos")
    depth = tags.withColumn("sum", F.sum(F.when(F.col("open"), 1).otherwise(-1)).over(order))
    depth = depth.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(order)))
    level = depth.withColumn("level", F.when(F.col("open"), F.col("depth")).otherwise(F.col("depth") + 1))
    ends = level.withColumn("close", F.lead("pos").over(Window.partitionBy(key, "name", "level").orderBy("pos")))
    hits = [F.when(F.col("tag").rlike(s), F.lit(i)) for i, s in enumerate(selectors)]
    cards = ends.filter("open").select(key, "n", "pos", "close", F.explode(F.array_compact(F.array(*hits))).alias("selector"))
    counted = cards.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy(key, "selector")))
    chosen = counted.filter(F.col("many") >= least).withColumn("first", F.min("selector").over(Window.partitionBy(key))).filter("selector = first")
    in_page = Window.partitionBy(key).orderBy("pos")
    end = F.coalesce("close", F.lead("pos").over(in_page) - 1, F.col("n") - 1)
    spans = chosen.select(key, F.struct((F.row_number().over(in_page) - 1).alias("ordinal"), "pos", end.alias("end")).alias("span"))
    listed = spans.groupBy(key).agg(F.sort_array(F.collect_list("span")).alias("spans"))  # as many as the page has cards
    pieces = F.zip_with("tags", F.slice("texts", 2, F.size("tags")), lambda tag, behind: F.concat(tag, behind))  # no page text inside the lambda: it would be split for every tag
    cut = F.transform("spans", lambda s: F.struct(s["ordinal"].alias("ordinal"), F.array_join(F.slice("pieces", s["pos"] + 1, s["end"] - s["pos"] + 1), "").alias("block")))
    return parts.select(key, pieces.alias("pieces")).join(listed, key).select(key, F.explode(cut).alias("c")).select(key, "c.*")


def shown(markup: Column) -> Column:
    """Text of a piece of markup, entities decoded; NULL when blank."""
    return F.nullif(F.trim(text.decoded(text.strip_tags(markup))), F.lit(""))


def by_class(*words: str) -> str:
    """Pattern of the first element whose class holds one of the words; its content is the second group."""
    return rf'(?is)<(\w+)[^>]*\sclass="[^"]*(?:{"|".join(words)})[^"]*"[^>]*>(.*?)</\1\s*>'


def by_tag(*names: str) -> str:
    return rf"(?is)<({'|'.join(names)})(?:\s[^>]*)?>(.*?)</\1\s*>"


def first_of(block: Column, patterns: list[str], kept: object = None) -> Column:
    """The first pattern's text that is not blank and, with ``kept``, passes its test."""
    found = [shown(F.regexp_extract(block, p, 2)) for p in patterns]
    return F.coalesce(*[F.when(kept(x), x) if kept else x for x in found])


# Class words of a product card's parts, and what stands behind a count of ratings and in a rating, by language.
TITLE_WORDS = ["p13n-sc-line-clamp-2", "p13n-sc-truncate-desktop-type2", "p13n-sc-truncate", "a-size-base-plus"]
RANK_WORDS = ["zg-bdg"]
PRICE_WORDS = ["p13n-sc-price", "a-offscreen", "a-price-whole", "a-price-range", "a-color-price"]
BADGE_WORDS = ["a-badge-text", "p13n-best-seller-badge", "a-badge-label"]
RATINGS = ["ratings", "Bewertungen", "évaluations", "beoordelingen", "recensioni", "valoraciones", "opinie"]
OUT_OF = ["out of", "von", "sur", "di", "van", "z"]

PRODUCT = r'(?is)^<\w+[^>]*\s(?:data-asin\s*=|class="[^"]*zg-item[^"]*")'


def product_cards(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", page_type: str = "page_type") -> DataFrame:
    """code, title, rank, reviews, rating, price, badge, url, velocity of the first card of each code of a page.

    A code is used up by its first card, also if that has no title. Without a shown rank the place among all cards counts.
    """
    block = F.col("block")
    cards = blocks(pages, key, html, [PRODUCT], ["li", "div"])
    code = F.nullif(F.regexp_extract(block, r'(?is)\sdata-asin\s*=\s*"([^"]+)"', 1), F.lit(""))
    first = cards.withColumn("code", code).filter("code is not null").groupBy(key, "code").agg(F.min_by(F.struct("ordinal", "block"), "ordinal").alias("c")).select(key, "code", "c.*")
    rank = F.nullif(F.regexp_extract(F.coalesce(first_of(block, [by_class(*RANK_WORDS)]), F.lit("")), r"#?(\d+)", 1), F.lit("")).cast("int")
    reviews = F.regexp_replace(F.regexp_extract(block, rf"(?i)([\d\s.,]*\d[\d\s.,]*)\s*(?:{'|'.join(RATINGS)})", 1), r"[\s.,]", "")
    rating = F.nullif(F.regexp_extract(block, rf"(?i)(\d+[.,]?\d*)\s*(?:{'|'.join(OUT_OF)})\s*5", 1), F.lit(""))
    link = F.nullif(F.regexp_extract(block, r'(?is)<a\s[^>]*href="([^"]*/dp/[^"]*)"', 1), F.lit(""))
    out = first.select(
        key, "code", first_of(block, [by_class(*TITLE_WORDS)]).alias("title"), F.coalesce(rank, F.col("ordinal") + 1).alias("rank"),
        F.coalesce(F.nullif(reviews, F.lit("")).cast("int"), F.lit(0)).alias("reviews"), F.replace(rating, F.lit(","), F.lit(".")).cast("double").alias("rating"),
        first_of(block, [by_class(*PRICE_WORDS)]).alias("price"), first_of(block, [by_class(*BADGE_WORDS)]).alias("badge"), link.alias("link"),
    ).filter("title is not null")
    wide = out.join(pages.select(key, F.col(url).alias("page_url"), F.col(page_type).alias("page_type")), key)
    return wide.select(
        key, "code", "title", "rank", "reviews", "rating", "price", "badge", resolved(F.col("page_url"), F.col("link")).alias("url"),
        velocity(F.col("rank"), F.col("reviews"), F.coalesce("rating", F.lit(0.0)), F.col("page_type")).alias("velocity"),
    )


# Selectors of a directory's company cards, in the order in which they are tried, and of their parts.
COMPANY_CARDS = [
    r'(?is)^<\w+[^>]*\sclass="[^"]*company-card',
    r'(?is)^<\w+[^>]*\sclass="[^"]*result-item',
    r'(?is)^<article[^>]*\sclass="(?:[^"]*\s)?company[\s"]',
    r'(?is)^<li[^>]*\sclass="(?:[^"]*\s)?company[\s"]',
    r'(?is)^<\w+[^>]*\sclass="(?:[^"]*\s)?listing-item[\s"]',
]
COMPANY_NAMES = [by_tag("h2"), by_tag("h3"), by_class("company-name"), r'(?is)<(a)\s[^>]*class="[^"]*name[^"]*"[^>]*>(.*?)</a>']
CATEGORY_WORDS = ["tag", "category", "activity"]


def company_cards(pages: DataFrame, key: str = "page_id", html: str = "html", source: str = "source", category: str = "category") -> DataFrame:
    """key, ordinal, name, website, host, categories: companies of all pages, the first card of each host in page order.

    A page with fewer than two cards of every selector has none. Links into the directory itself are no website.
    """
    block = F.col("block")
    cards = blocks(pages, key, html, COMPANY_CARDS, ["article", "li", "div", "section"], 2).join(pages.select(key, source, category), key)
    fits = lambda x: (F.length(x) > 1) & (F.length(x) < 200)
    link = shown(F.regexp_extract(block, by_tag("a"), 2))
    name = F.coalesce(first_of(block, COMPANY_NAMES, fits), F.when(F.length(link) > 1, link))
    links = F.regexp_extract_all(block, F.lit(r'(?is)<a\s[^>]*href="(http[^"]*)"'), 1)
    website = F.get(F.filter(links, lambda x: ~F.contains(x, F.col(source))), F.lit(0))
    tags = F.filter(F.transform(F.regexp_extract_all(block, F.lit(by_class(*CATEGORY_WORDS)), 2), shown), lambda x: (F.length(x) > 1) & (F.length(x) < 60))
    found = cards.select(
        key, "ordinal", name.alias("name"), website.alias("website"), F.lower(F.parse_url(website, F.lit("HOST"))).alias("host"),
        F.when(F.size(tags) > 0, tags).otherwise(F.array(category)).alias("categories"),
    ).filter("name is not null")
    rest = [c for c in found.columns if c != "host"]
    once = found.filter("host is not null").groupBy("host").agg(F.min_by(F.struct(*rest), F.struct(key, "ordinal")).alias("c")).select("c.*", "host")
    return found.filter("host is null").unionByName(once)


NAME_ITEMS = [r"(?is)^<(?:li|td)[\s>]"]
BRAND_ITEMS = [r'(?is)^<(?:h[234][\s>]|\w+[^>]*\sclass="[^"]*(?:brand|partner))']
BRAND_TAGS = ["h2", "h3", "h4", "div", "span", "a", "p", "li", "td", "section", "article", "figure", "strong", "b"]


def _listed(pages: DataFrame, key: str, html: str, items: list[str], names: list[str], kept: object) -> DataFrame:
    found = blocks(pages, key, html, items, names).withColumn("name", F.trim(text.strip_tags(F.col("block")))).filter(kept(F.col("name")))
    ordered = found.groupBy(key, "name").agg(F.min("ordinal").alias("ordinal")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ordinal", "name"))).alias("found"))
    return ordered.select(key, F.transform("found", lambda x: x["name"]).alias("names"))


def page_names(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, companies, brands: names of image texts, then of items in page order, nested ones too, each once.

    Companies come from list items and table cells, brands from headings and from elements whose class speaks of brands or partners.
    """
    size = lambda low, high: lambda x: (F.length(x) > low) & (F.length(x) < high)
    alts = lambda high, stop: F.filter(text.image_alts(F.col(html)), lambda a: size(2, high)(a) & ~a.rlike(f"(?i){stop}"))
    companies = _listed(pages, key, html, NAME_ITEMS, ["li", "td"], lambda x: size(2, 80)(x) & ~x.rlike(r"^\d")).withColumnRenamed("names", "items")
    brands = _listed(pages, key, html, BRAND_ITEMS, BRAND_TAGS, size(1, 60)).withColumnRenamed("names", "marked")
    none = F.array().cast("array<string>")
    wide = pages.select(key, alts(80, "logo|icon|banner").alias("alts"), alts(60, "logo|icon|placeholder").alias("brand_alts")).join(companies, key, "left").join(brands, key, "left")
    return wide.select(
        key, F.array_distinct(F.concat("alts", F.coalesce("items", none))).alias("companies"), F.array_distinct(F.concat("brand_alts", F.coalesce("marked", none))).alias("brands")
    )
