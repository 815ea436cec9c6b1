"""Text expressions: dictionary classifiers, field extractors, URL and HTML parsing.

A dictionary is a literal array evaluated row by row inside the scan stage, so classifying a text
needs no join and no shuffle, and the whole text is always used.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tradewind.sources import dims


def _literal(rows: list[tuple], names: list[str]) -> Column:
    return F.array(
        *[
            F.struct(*[(F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)).alias(n) for v, n in zip(row, names)])
            for row in rows
        ]
    )


def keyword_hits(text: Column, words: Column) -> Column:
    return F.size(F.filter(words, lambda w: text.contains(w)))


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def first_rule(text: Column, rules: list[tuple[str, list[str]]], default: str | None = None) -> Column:
    """Name of the first rule with a word contained in the text."""
    out = None
    for name, words in rules:
        out = F.when(contains_any(text, words), name) if out is None else out.when(contains_any(text, words), name)
    return out.otherwise(default) if default is not None else out


def subcategory(text: Column) -> Column:
    """(label, parent, density): best share of keywords per token, at least the minimum, first label on ties."""
    rows = [(label, dims.SUBCATEGORY_GROUP[label], -i, words) for i, (label, words) in enumerate(dims.SUBCATEGORY_KEYWORDS.items())]
    lower = F.lower(text)
    tokens = F.size(F.split(lower, " "))
    scored = F.transform(
        _literal(rows, ["label", "parent", "rank", "words"]),
        lambda r: F.struct(
            (keyword_hits(lower, r["words"]) / tokens).alias("density"), r["rank"].alias("rank"), r["label"].alias("label"), r["parent"].alias("parent")
        ),
    )
    best = F.array_max(scored)
    return F.when(best["density"] >= dims.MIN_KEYWORD_DENSITY, best)


def taxonomy(text: Column) -> Column:
    """(score, level, node, path): keywords weigh their word count; deeper, then first, node on ties."""
    parents = {node: parent for node, parent, _, _ in dims.TAXONOMY}

    def path(node: str | None) -> str:
        return "" if node is None else f"{path(parents[node])} > {node}" if parents[node] else node

    lower = F.lower(text)
    rows = [(node, level, path(node), -i, words) for i, (node, _, level, words) in enumerate(dims.TAXONOMY)]
    scored = F.transform(
        _literal(rows, ["node", "level", "path", "rank", "words"]),
        lambda r: F.struct(
            F.aggregate(
                F.filter(r["words"], lambda w: lower.contains(w)), F.lit(0), lambda a, w: a + F.size(F.split(w, " "))
            ).alias("score"),
            r["level"].alias("level"),
            r["rank"].alias("rank"),
            r["node"].alias("node"),
            r["path"].alias("path"),
        ),
    )
    best = F.array_max(scored)
    return F.when(best["score"] > 0, best)


def segment_weights(text: Column) -> dict[str, Column]:
    """Keyword weight of one signal text for each segment; sum them over the signals of an entity."""
    lower = F.lower(F.trim(text))
    out = {}
    for name, words in dims.SEGMENT_KEYWORDS.items():
        total = F.lit(0)
        for word, weight in words:
            total = total + F.when(lower.contains(word), weight).otherwise(0)
        out[name] = total
    return out


def best_segment(scores: dict[str, Column]) -> Column:
    """Segment with the highest total, at least 5, else other; the first listed on ties."""
    best = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("rank"), F.lit(n).alias("name")) for i, (n, s) in enumerate(scores.items())]))
    return F.when(best["score"] >= dims.SEGMENT_FLOOR, best["name"]).otherwise("other")


def sentiment(text: Column) -> Column:
    """Reply sentiment; negative words first, so 'not interested' is negative."""
    lower = F.lower(text)
    return (
        F.when(text.isNull() | (F.length(text) < 5), "neutral")
        .when(contains_any(lower, dims.NEGATIVE_REPLY), "negative")
        .when(contains_any(lower, dims.POSITIVE_REPLY), "positive")
        .otherwise("neutral")
    )


# Product descriptor patterns, tried in this order, with their labels.
SKU_PATTERNS = [
    ("size", r"(?i)(\d+(?:\.\d+)?)\s*(?:oz|g|ml|kg|lbs?)\b"),
    ("quantity", r"(?i)(\d+)\s*(?:pack|count|ct|pcs?|pieces?)\b"),
    ("variant", r"(?i)\b(?:flavou?r|scent|colou?r)\s*[:\-]?\s*([a-z][a-z\s]{1,24})"),
]

# Demographic groups and their words.
DEMOGRAPHICS = {
    "children": ["kids", "children", "toddler", "baby", "infant", "ages 3", "ages 4", "ages 5", "junior"],
    "athletes": ["athlete", "gym", "fitness", "workout", "sport", "training", "performance", "pre-workout"],
    "seniors": ["senior", "elderly", "aging", "joint support", "mobility", "50+", "60+"],
    "vegetarians": ["vegan", "vegetarian", "plant-based", "plant based"],
    "collectors": ["collector", "limited edition", "rare", "exclusive", "blind box", "signed"],
}

# Brand patterns, tried in this order.
BRAND_PATTERNS = [r"(?i)\b(brand#\d+)\b", r"(?i)\b(acme|globex|initech)\b"]


def first_match(text: Column, patterns: list[str], group: int = 1) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, group)), F.lit("")) for p in patterns])


def brand_in(text: Column) -> Column:
    return first_match(text, BRAND_PATTERNS)


def sku(text: Column) -> Column:
    found = [F.nullif(F.trim(F.regexp_extract(text, p, 0)), F.lit("")) for _, p in SKU_PATTERNS]
    return F.coalesce(*[F.concat(F.lit(f"{label}:"), m) for (label, _), m in zip(SKU_PATTERNS, found)])


def demographics(lower: Column) -> Column:
    """Audience groups of a text already in lower case."""
    return F.filter(F.array(*[F.when(contains_any(lower, words), name) for name, words in DEMOGRAPHICS.items()]), lambda g: g.isNotNull())


def price_range(text: Column) -> Column:
    """(currency, low, high) of the numbers in a price text."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
    currency = F.coalesce(F.nullif(F.regexp_extract(text, "([€$£])", 1), F.lit("")), F.lit("EUR"))
    return F.when(
        F.length(F.trim(text)) > 0,
        F.struct(currency.alias("currency"), F.array_min(numbers).alias("low"), F.array_max(numbers).alias("high")),
    )


def _unescaped(leaf: Column) -> Column:
    """A JSON string without its quotes, decoded by the JSON reader."""
    return F.get_json_object(F.concat(F.lit('{"v":"'), leaf, F.lit('"}')), "$.v")


def string_leaves(json: Column) -> Column:
    """All string values of a JSON document as one text, escapes decoded; a string followed by a colon is a key."""
    pattern = F.lit(r'"((?:[^"\\]|\\.)*)"(\s*:)?')
    pairs = F.arrays_zip(F.regexp_extract_all(json, pattern, 1).alias("text"), F.regexp_extract_all(json, pattern, 2).alias("colon"))
    return F.array_join(F.transform(F.filter(pairs, lambda p: p["colon"] == ""), lambda p: _unescaped(p["text"])), " ")


def confidence(score: Column, brand: Column, descriptor: Column, groups: Column) -> Column:
    return F.least(
        F.least(F.coalesce(score, F.lit(0)) / 8.0, F.lit(0.55))
        + F.when(brand.isNotNull(), 0.20).otherwise(0.0)
        + F.when(descriptor.isNotNull(), 0.15).otherwise(0.0)
        + F.when(F.size(groups) > 0, 0.10).otherwise(0.0),
        F.lit(1.0),
    )


def error_code(message: Column) -> Column:
    rules = [
        ("TIMEOUT", ["timeout"]),
        ("RATE_LIMITED", ["429", "rate limit"]),
        ("BOT_BLOCKED", ["bot", "captcha", "robot"]),
        ("AUTH_REQUIRED", ["signin", "auth"]),
        ("PAGE_NOT_FOUND", ["404", "not found"]),
        ("SELECTOR_MISMATCH", ["selector", "parse"]),
        ("NETWORK_ERROR", ["fetch", "network", "econnrefused"]),
    ]
    return first_rule(F.lower(message), rules, "UNKNOWN")


def retryable(code: Column) -> Column:
    return code.isin("TIMEOUT", "RATE_LIMITED", "NETWORK_ERROR")


def employees(text: Column) -> Column:
    """Midpoint of an employee range such as 1,001-5,000; else the first number of two characters or more, commas dropped."""
    plain = lambda pattern, group: F.replace(F.regexp_extract(text, pattern, group), F.lit(",")).try_cast("int")
    span = r"(\d[\d,]*)\s*[-\u2013]\s*(\d[\d,]*)"
    low, high = plain(span, 1), plain(span, 2)
    return F.when(high.isNotNull(), F.floor((low + high) / 2.0 + 0.5).cast("int")).otherwise(plain(r"(\d[\d,]+)", 1))


def locale_number(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"[\s.,]", "").try_cast("int"), F.lit(0))


def rating(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?i)(\d+[.,]?\d*)\s*(?:out of|von|sur|di|van|z)\s*5", 1)
    return F.replace(found, F.lit(","), F.lit(".")).try_cast("double")


def clean_category(text: Column) -> Column:
    """Lower case, single spaces, plain characters; near-duplicates merged; too short or long is NULL."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), r"[^a-z0-9\s&-]", "")
    merged = (
        F.when(plain.contains("t-shirt") | plain.contains("tshirt"), "t-shirts")
        .when(plain.startswith("men") & plain.contains("clothing"), "mens clothing")
        .when(plain.startswith("women") & plain.contains("clothing"), "womens clothing")
        .otherwise(plain)
    )
    return F.when((F.length(merged) > 2) & (F.length(merged) < 50), merged)


def words_over_two(lower: Column) -> Column:
    """Words of more than two letters of a text already in lower case."""
    return F.filter(F.split(lower, r"[\s,/]+"), lambda w: F.length(w) > 2)


# ---- URLs ---------------------------------------------------------------------------------------


_AUTHORITY = r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:@]+)"


def with_scheme(url: Column) -> Column:
    return F.when(F.lower(url).rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def origin(url: Column) -> Column:
    """scheme://host in lower case with a port that is not the scheme's own, without user info; https assumed when missing; NULL when there is no host."""
    full = with_scheme(F.trim(url))
    name = host(F.trim(url))
    scheme = F.lower(F.regexp_extract(full, r"^([A-Za-z]+)://", 1))
    port = F.regexp_extract(full, _AUTHORITY + r":(\d+)", 2)
    own = F.when(scheme == "https", "443").otherwise("80")
    return F.when(name != "", F.concat(scheme, F.lit("://"), name, F.when((port != "") & (port != own), F.concat(F.lit(":"), port)).otherwise("")))


def origin_and_path(url: Column) -> Column:
    """Origin plus path as it stands, a slash when empty, without query and fragment; http and https only."""
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    return F.when(F.lower(url).rlike("^https?://"), F.concat(origin(url), F.when(path == "", "/").otherwise(path)))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(with_scheme(url), _AUTHORITY, 1))


def domain_name(url: Column) -> Column:
    """Display name: first label of the host, dashes as spaces, words capitalised."""
    return F.initcap(F.replace(F.split(host(url), r"\.").getItem(0), F.lit("-"), F.lit(" ")))


def slug(url: Column) -> Column:
    """First label of the host without www, other characters as dashes."""
    first = F.split(F.regexp_replace(host(url), r"^www\.", ""), r"\.").getItem(0)
    return F.regexp_replace(first, r"[^a-z0-9-]", "-")


def tld_country(url: Column) -> Column:
    tld = F.element_at(F.split(host(url), r"\."), -1)
    table = F.create_map(*[x for k, v in dims.TLD_COUNTRY.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, tld)


# ---- HTML ---------------------------------------------------------------------------------------


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), r"\s+", " "))


def title(html: Column) -> Column:
    return F.nullif(F.trim(decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(""))


# Named character references that are decoded; the ampersand comes last, so nothing is decoded twice.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def decoded(text: Column) -> Column:
    for name, character in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(character))
    return text


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in either kind of quotes; empty if the tag lacks it."""
    double = F.regexp_extract(tag, rf'(?is)\s{name}\s*=\s*"([^"]*)"', 1)
    return F.when(double != "", double).otherwise(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*'([^']*)'", 1))


def meta(html: Column, key: str, value: str) -> Column:
    """Content of the first meta tag with the key, attributes in any order, entities decoded; NULL when absent or blank."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\s[^>]*>"), 0)
    named = F.filter(tags, lambda t: F.lower(attribute(t, key)) == value)
    return F.nullif(F.trim(decoded(attribute(F.get(named, F.lit(0)), "content"))), F.lit(""))


# Markers of a shop platform in a page.
PLATFORM_MARKERS = [
    "cdn.shopify.com",
    "Shopify.shop",
    "myshopify.com",
    "/cart.js",
    "window.Shopify",
    "shopify-checkout",
    "shopify-payment-button",
    "shopify-section",
    "shopify-features",
]


def is_platform(html: Column) -> Column:
    return contains_any(html, PLATFORM_MARKERS)


def last_part(text: Column) -> Column:
    return F.trim(F.element_at(F.split(text, "[|–—-]"), -1))


def display_name(html: Column, url: Column) -> Column:
    site, og, page = meta(html, "property", "og:site_name"), meta(html, "property", "og:title"), title(html)
    long = lambda c: F.length(c) > 1
    return F.when(long(site), site).when(long(og), last_part(og)).when(long(page), last_part(page)).otherwise(domain_name(url))


def elements(html: Column, tag: str) -> Column:
    """Texts of all elements of a tag, in page order, whole page."""
    return F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</(?:{tag})>"), 1), strip_tags)


def image_alts(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r'(?is)<img[^>]*\salt="([^"]*)"'), 1), F.trim)


def company_names(html: Column) -> Column:
    """Image texts and list items that look like names, distinct."""
    alts = F.filter(image_alts(html), lambda a: (F.length(a) > 2) & (F.length(a) < 80) & ~a.rlike("(?i)logo|icon|banner"))
    items = F.filter(
        F.concat(elements(html, "li"), elements(html, "td")), lambda x: (F.length(x) > 2) & (F.length(x) < 80) & ~x.rlike(r"^\d")
    )
    return F.array_distinct(F.concat(alts, items))


def brand_names(html: Column) -> Column:
    alts = F.filter(image_alts(html), lambda a: (F.length(a) > 2) & (F.length(a) < 60) & ~a.rlike("(?i)logo|icon|placeholder"))
    heads = F.transform(
        F.regexp_extract_all(html, F.lit(r"(?is)<h[234](?:\s[^>]*)?>(.*?)</h[234]>"), 1), strip_tags
    )
    kept = F.filter(heads, lambda x: (F.length(x) > 1) & (F.length(x) < 60))
    return F.array_distinct(F.concat(alts, kept))


def anchors(html: Column) -> Column:
    """(href, text) of all anchors in page order."""
    href = F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'), 1)
    text = F.transform(F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'), 2), strip_tags)
    return F.arrays_zip(href.alias("href"), text.alias("text"))


def first_link(html: Column, phrases: list[str]) -> Column:
    match = F.filter(
        anchors(html), lambda a: contains_any(F.lower(a["href"]), phrases) | contains_any(F.lower(a["text"]), phrases)
    )
    return F.get(match, F.lit(0))["href"]


def extraction_confidence(found: Column, expected: int) -> Column:
    return F.least(F.lit(1.0), found / float(expected))
