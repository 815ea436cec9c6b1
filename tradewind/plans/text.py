"""Queries: text classification, field extraction, URL and page jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradewind.functions import text
from tradewind.functions.numeric import half_up
from tradewind.operators import pages, scores
from tradewind.plans.leads import _rules_sql, _subcategory_sql
from tradewind.plans.oracle_views import register
from tradewind.plans.registry import query
from tradewind.plans.scores import R
from tradewind.sources import dims, views
from tradewind.sources.tables import Tables


def _path(node: str | None) -> str:
    parents = {n: p for n, p, _, _ in dims.TAXONOMY}
    return "" if node is None else f"{_path(parents[node])} > {node}" if parents[node] else node


_TAXONOMY_PATHS = " UNION ALL ".join(f"SELECT {i} AS pos, '{n}' AS node, '{_path(n)}' AS path" for i, (n, _, _, _) in enumerate(dims.TAXONOMY))


def _sku_sql(c: str) -> str:
    pats = ["(?i)(\\d+(?:\\.\\d+)?)\\s*(?:oz|g|ml|kg|lbs?)\\b", "(?i)(\\d+)\\s*(?:pack|count|ct|pcs?|pieces?)\\b",
            "(?i)\\b(?:flavou?r|scent|colou?r)\\s*[:\\-]?\\s*([a-z][a-z\\s]{1,24})"]
    return "coalesce(" + ", ".join(f"'{label}:' || nullif(trim(regexp_extract({c}, '{p}', 0)), '')" for label, p in zip(("size", "quantity", "variant"), pats)) + ")"


def _groups_sql(c: str) -> str:
    return "concat_ws(',', " + ", ".join(
        "CASE WHEN " + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + f" THEN '{g}' END" for g, words in text.DEMOGRAPHICS.items()
    ) + ")"


_CONTENT = "p_brand || ' ' || p_name || ' ' || CAST(p_size AS VARCHAR) || CASE WHEN p_size % 3 = 0 THEN 'oz' WHEN p_size % 3 = 1 THEN ' pack' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN ' for kids' WHEN p_partkey % 7 = 1 THEN ' rare' ELSE '' END"
register("v_records", f"SELECT p_partkey, {_CONTENT} AS content FROM part")
register("v_classified", f"""
SELECT p_partkey, coalesce(node, 'unclassified') AS node, coalesce(path, 'Unclassified') AS path, CAST(coalesce(score, 0) AS INTEGER) AS score, brand, sku, groups, {R("conf", 4)} AS confidence,
 conf < 0.70 AS needs_review, conf < 0.55 AS needs_fallback
FROM (SELECT *, least(least(coalesce(score, 0) / 8.0::DOUBLE, 0.55::DOUBLE) + CASE WHEN brand IS NOT NULL THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN sku IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN groups <> '' THEN 0.10::DOUBLE ELSE 0 END, 1) AS conf
 FROM (SELECT r.p_partkey, t.node, t.path, t.score, nullif(regexp_extract(content, '(?i)\\b(brand#\\d+)\\b', 1), '') AS brand, {_sku_sql("content")} AS sku, {_groups_sql("content")} AS groups
  FROM v_records r LEFT JOIN (SELECT * FROM (SELECT p_partkey, x.node, p.path, score, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, level DESC, pos) AS rn FROM (
    SELECT p_partkey, node, any_value(level) AS level, sum(weight) AS score FROM v_records JOIN v_taxonomy ON contains(lower(content), keyword) GROUP BY 1, 2) x JOIN ({_TAXONOMY_PATHS}) p USING (node)) WHERE rn = 1) t USING (p_partkey)))""")


def records(t: Tables, parts: DataFrame | None = None) -> DataFrame:
    """Product records as free text: brand, name, size descriptor and audience words."""
    size = F.col("p_size").cast("string")
    unit = F.when(F.col("p_size") % 3 == 0, "oz").when(F.col("p_size") % 3 == 1, " pack").otherwise("")
    audience = F.when(F.col("p_partkey") % 7 == 0, " for kids").when(F.col("p_partkey") % 7 == 1, " rare").otherwise("")
    source = t.read("part") if parts is None else parts
    return source.select("p_partkey", F.concat("p_brand", F.lit(" "), "p_name", F.lit(" "), size, unit, audience).alias("content"))


@query("classify_taxonomy", "SELECT * FROM v_classified")
def classify_taxonomy(t: Tables) -> DataFrame:
    return pages.classify_records(records(t), "p_partkey", F.col("content"))


@query("classify_subcategory", f"SELECT p_partkey, label, (SELECT any_value(parent) FROM v_subcategory s WHERE s.label = x.label) AS parent FROM (SELECT p_partkey, {_subcategory_sql('p_name')} AS label FROM part) x")
def classify_subcategory(t: Tables) -> DataFrame:
    return t.read("part").withColumn("s", text.subcategory(F.col("p_name"))).select("p_partkey", "s.label", "s.parent")


@query("segment_score", f"""
SELECT brand, CASE WHEN greatest({', '.join(dims.SEGMENT_KEYWORDS)}) < 5 THEN 'other' {' '.join(f"WHEN {n} = greatest({', '.join(dims.SEGMENT_KEYWORDS)}) THEN '{n}'" for n in dims.SEGMENT_KEYWORDS)} END AS segment, {', '.join(dims.SEGMENT_KEYWORDS)}
FROM (SELECT p_brand AS brand, {', '.join("CAST(sum(" + ' + '.join(f"CASE WHEN contains(p_name, '{k}') THEN {w} ELSE 0 END" for k, w in words) + f") AS BIGINT) AS {n}" for n, words in dims.SEGMENT_KEYWORDS.items())}
 FROM (SELECT DISTINCT p_brand, p_name FROM part) GROUP BY 1)""")
def segment_score(t: Tables) -> DataFrame:
    weights = text.segment_weights(F.col("p_name"))
    totals = t.read("part").select("p_brand", "p_name").distinct().groupBy(F.col("p_brand").alias("brand")).agg(
        *[F.sum(w).alias(n) for n, w in weights.items()]
    )
    return totals.select("brand", text.best_segment({n: F.col(n) for n in weights}).alias("segment"), *weights)


@query("extract_fields", f"""
SELECT doc_id, {_sku_sql("text")} AS sku, {_groups_sql("text")} AS groups, coalesce(nullif(regexp_extract(text, '([€$£])', 1), ''), 'EUR') AS currency,
 list_min(list_transform(regexp_extract_all(text, '(\\d+(?:\\.\\d+)?)', 1), lambda x: CAST(x AS DOUBLE))) AS low,
 list_max(list_transform(regexp_extract_all(text, '(\\d+(?:\\.\\d+)?)', 1), lambda x: CAST(x AS DOUBLE))) AS high,
 len(list_filter(regexp_split_to_array(lower(text), '[\\s,/]+'), lambda w: length(w) > 2)) AS tokens FROM documents""")
def extract_fields(t: Tables) -> DataFrame:
    body = F.col("text")
    # The lower-case text and the numbers are computed once per document and then referred to.
    rows = t.read("documents").select("doc_id", "text", F.lower(body).alias("low_text"), text.price_range(body).alias("p"))
    return rows.select(
        "doc_id",
        text.sku(body).alias("sku"),
        F.array_join(text.demographics(F.col("low_text")), ",").alias("groups"),
        F.coalesce("p.currency", F.lit("EUR")).alias("currency"),
        "p.low",
        "p.high",
        F.size(text.words_over_two(F.col("low_text"))).alias("tokens"),
    )


@query("json_leaves", """SELECT p_partkey, p_brand || ' ' || p_name || ' ' || p_type AS leaves FROM part""")
def json_leaves(t: Tables) -> DataFrame:
    nested = F.struct(
        F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.struct(F.col("p_name").alias("title"), F.array("p_type").alias("tags")).alias("item")
    )
    return t.read("part").select("p_partkey", text.string_leaves(F.to_json(nested)).alias("leaves"))


_NEG = " OR ".join(f"contains(lower(text), '{w}')" for w in dims.NEGATIVE_REPLY)
_POS = " OR ".join(f"contains(lower(text), '{w}')" for w in dims.POSITIVE_REPLY)
SENTIMENT_SQL = f"CASE WHEN text IS NULL OR length(text) < 5 THEN 'neutral' WHEN {_NEG} THEN 'negative' WHEN {_POS} THEN 'positive' ELSE 'neutral' END"


@query("sentiment", f"SELECT conv_id, turn, {SENTIMENT_SQL} AS sentiment FROM conversations")
def sentiment(t: Tables) -> DataFrame:
    return t.read("conversations").select("conv_id", "turn", text.sentiment(F.col("text")).alias("sentiment"))


_FULL = "CASE WHEN regexp_matches(lower(url), '^https?://') THEN url ELSE 'https://' || url END"
_HOST = f"lower(regexp_extract({_FULL}, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:@]+)', 1))"
_PORT = f"regexp_extract({_FULL}, '^[A-Za-z]+://[^/?#]*?:([0-9]+)(?:[/?#]|$)', 1)"
_SCHEME = f"lower(regexp_extract({_FULL}, '^([A-Za-z]+)://', 1))"
_ORIGIN = f"{_SCHEME} || '://' || {_HOST} || CASE WHEN {_PORT} IN ('', CASE {_SCHEME} WHEN 'https' THEN '443' ELSE '80' END) THEN '' ELSE ':' || {_PORT} END"
_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"
_DOMAIN = f"array_to_string(list_transform(string_split(split_part({_HOST}, '.', 1), '-'), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query("url_parts", f"""
SELECT page_id, {_ORIGIN} AS origin, {_ORIGIN} || CASE {_PATH} WHEN '' THEN '/' ELSE {_PATH} END AS origin_path, {_DOMAIN} AS domain_name,
 regexp_replace(split_part(regexp_replace({_HOST}, '^www\\.', ''), '.', 1), '[^a-z0-9-]', '-', 'g') AS slug,
 CASE split_part({_HOST}, '.', -1) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.TLD_COUNTRY.items())} END AS country FROM pages""")
def url_parts(t: Tables) -> DataFrame:
    return pages.url_parts(t.read("pages"))


def _decoded_sql(value: str) -> str:
    for name, character in text.ENTITIES:
        value = f"replace({value}, '{name}', '{character.replace(chr(39), chr(39) * 2)}')"
    return value


_TITLE = f"""nullif(trim({_decoded_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}), '')"""


@query("html_meta", f"""
SELECT page_id, title, description, is_platform, display_name, {R("rate")} AS confidence, rate < 0.5 AS low_confidence FROM (
 SELECT *, least(1.0, ((title IS NOT NULL)::INT + (description IS NOT NULL)::INT + (display_name IS NOT NULL)::INT) / 3.0)::DOUBLE AS rate FROM (
 SELECT page_id, {_TITLE} AS title, nullif(trim(regexp_extract(html, '(?is)<meta[^>]+name="description"[^>]+content="([^"]*)"', 1)), '') AS description,
  {" OR ".join(f"contains(html, '{m}')" for m in text.PLATFORM_MARKERS)} AS is_platform,
  CASE WHEN length({_TITLE}) > 1 THEN trim(list_last(regexp_split_to_array({_TITLE}, '[|–—-]'))) ELSE {_DOMAIN} END AS display_name FROM pages))""")
def html_meta(t: Tables) -> DataFrame:
    return pages.page_meta(t.read("pages"))


_STRIP = lambda x: f"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))"


def _elements_sql(pattern: str) -> str:
    return f"list_transform(regexp_extract_all(html, '(?is){pattern}', 1), lambda x: {_STRIP('x')})"


def _ordered_distinct(items: str) -> str:
    return f"(SELECT string_agg(v, '|' ORDER BY p) FROM (SELECT v, p FROM (SELECT v, min(p) AS p FROM (SELECT unnest({items}) AS v, unnest(range(len({items}))) AS p) GROUP BY v) ORDER BY p LIMIT %d))"


register("v_page_lists", f"""
SELECT page_id, list_filter(list_concat({_elements_sql('<li(?:\\s[^>]*)?>(.*?)</li>')}, {_elements_sql('<td(?:\\s[^>]*)?>(.*?)</td>')}), lambda x: length(x) > 2 AND length(x) < 80 AND NOT regexp_matches(x, '^\\d')) AS items,
 list_filter({_elements_sql('<h[234](?:\\s[^>]*)?>(.*?)</h[234]>')}, lambda x: length(x) > 1 AND length(x) < 60) AS heads,
 {_elements_sql('<h1(?:\\s[^>]*)?>(.*?)</h1>')} AS h1 FROM pages""")


@query("html_names", f"""
SELECT page_id, coalesce((SELECT string_agg(v, '|' ORDER BY p) FROM (SELECT v, min(p) AS p FROM (SELECT unnest(items) AS v, unnest(range(len(items))) AS p) GROUP BY v ORDER BY 2 LIMIT 40)), '') AS companies,
 coalesce((SELECT string_agg(v, '|' ORDER BY p) FROM (SELECT v, min(p) AS p FROM (SELECT unnest(heads) AS v, unnest(range(len(heads))) AS p) GROUP BY v ORDER BY 2 LIMIT 60)), '') AS brands, array_to_string(h1, '|') AS h1 FROM v_page_lists""")
def html_names(t: Tables) -> DataFrame:
    html = F.col("html")
    return t.read("pages").select(
        "page_id",
        F.array_join(text.company_names(html), "|").alias("companies"),
        F.array_join(text.brand_names(html), "|").alias("brands"),
        F.array_join(text.elements(html, "h1"), "|").alias("h1"),
    )


_HREF = "regexp_extract_all(html, '(?is)<a\\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>', 1)"
_ATEXT = f"list_transform(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>', 2), lambda x: {_STRIP('x')})"
_PHRASE = lambda c: " OR ".join(f"contains(lower({c}), '{p}')" for p in pages.WHERE_TO_BUY)


@query("html_links", f"""
SELECT page_id, len(hrefs) AS links, regexp_extract(url, '^(https?://[^/?#]+)', 1) || list_filter(list_zip(hrefs, texts), lambda a: {_PHRASE('a[1]')} OR {_PHRASE('a[2]')})[1][1] AS target FROM (SELECT page_id, url, {_HREF} AS hrefs, {_ATEXT} AS texts FROM pages)""")
def html_links(t: Tables) -> DataFrame:
    html = F.col("html")
    return t.read("pages").select(
        "page_id", F.size(text.anchors(html)).cast("bigint").alias("links"), pages.first_link(html, F.col("url"), pages.WHERE_TO_BUY).alias("target")
    )


register("v_listing", """
SELECT p_brand || '/' || CAST(p_partkey // 100 AS VARCHAR) AS page, p_partkey AS position, CASE WHEN p_partkey % 200 < 100 THEN CAST(p_partkey % 100 AS INTEGER) ELSE p_size END AS rank,
 CASE WHEN p_partkey % 3 = 0 THEN 'B' || p_partkey ELSE 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS code, CAST(CASE WHEN p_brand = 'Brand#7' THEN 0 ELSE p_partkey % 900 END AS INTEGER) AS reviews,
 CASE WHEN p_brand = 'Brand#3' THEN '$10.00' WHEN p_brand = 'Brand#4' THEN 'call us' ELSE '$' || CAST(p_size AS VARCHAR) || '.50' END AS price,
 3.5::DOUBLE + (p_partkey % 15) / 10.0::DOUBLE AS rating, CASE WHEN p_partkey % 2 = 0 THEN 'new-releases' ELSE 'bestsellers' END AS page_type FROM part""")


def listing(t: Tables) -> DataFrame:
    """Scraped-listing shape over the part table; a page holds at most 100 part keys."""
    key, brand = F.col("p_partkey"), F.col("p_brand")
    return t.read("part").select(
        F.concat_ws("/", brand, F.floor(key / 100).cast("string")).alias("page"),
        key.alias("position"),
        F.when(key % 200 < 100, (key % 100).cast("int")).otherwise(F.col("p_size")).alias("rank"),
        F.concat(F.lit("B"), F.when(key % 3 == 0, key.cast("string")).otherwise(F.lpad(key.cast("string"), 9, "0"))).alias("code"),
        F.when(brand == "Brand#7", 0).otherwise((key % 900).cast("int")).alias("reviews"),
        F.when(brand == "Brand#3", "$10.00").when(brand == "Brand#4", "call us").otherwise(F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit(".50"))).alias("price"),
        (3.5 + (key % 15) / 10.0).alias("rating"),
        F.when(key % 2 == 0, "new-releases").otherwise("bestsellers").alias("page_type"),
    )


@query("page_quality", """
SELECT page, products, one_price, falling_rank, bad_codes, no_reviews, bad_prices, one_price OR falling_rank OR bad_codes OR no_reviews OR bad_prices AS is_decoy FROM (
 SELECT page, count(*) AS products, count(price) > 5 AND count(DISTINCT price) = 1 AS one_price, coalesce(bool_or(rank < b), false) AS falling_rank,
  count(*) FILTER (WHERE NOT regexp_full_match(code, '[A-Z0-9]{10}')) > count(*) * 0.3 AS bad_codes, max(reviews) = 0 AND count(*) > 10 AS no_reviews,
  count(*) FILTER (WHERE NOT regexp_matches(price, '^[€£$]?[\\d\\s,.]+$')) > count(*) * 0.5 AS bad_prices
 FROM (SELECT *, lag(rank) OVER (PARTITION BY page ORDER BY position) AS b FROM v_listing) GROUP BY 1)""")
def page_quality(t: Tables) -> DataFrame:
    return pages.listing_quality(listing(t))


@query("velocity_score", """
SELECT position AS p_partkey, CAST(floor(CASE WHEN page_type = 'new-releases' THEN greatest(0, 100 - rank) + least(reviews / 10.0, 50) ELSE greatest(0, 50 - rank / 2.0) + least(reviews / 50.0, 30) END
 + CASE WHEN rating >= 4.7::DOUBLE THEN 15 WHEN rating >= 4.5::DOUBLE THEN 10 ELSE 0 END + 0.5) AS INTEGER) AS velocity FROM v_listing""")
def velocity_score(t: Tables) -> DataFrame:
    c = F.col
    return listing(t).select(c("position").alias("p_partkey"), pages.velocity(c("rank"), c("reviews"), c("rating"), c("page_type")).alias("velocity"))


@query("category_labels", f"""
SELECT label, count(*) AS customers, any_value(mapped) AS mapped, any_value(rule) AS rule, any_value(alias_category) AS alias_category, any_value(match) AS match FROM (
 SELECT c_mktsegment AS label, {"CASE lower(trim(c_mktsegment))" + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in dims.LABEL_MAP.items()) + " END"} AS mapped,
  {_rules_sql("lower(c_mktsegment)", [("vehicles", ["mobile", "auto"]), ("home", ["house", "furn"]), ("industry", ["machine", "build"])])} AS rule FROM customer) c
LEFT JOIN (SELECT lower_label, arg_min(category, (-m, category)) AS alias_category, max(m) AS match FROM (SELECT l AS lower_label, category, max(CASE WHEN l = alias THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END) AS m
  FROM (SELECT DISTINCT lower(c_mktsegment) AS l FROM customer) JOIN v_aliases ON contains(l, alias) OR contains(alias, l) GROUP BY 1, 2) GROUP BY 1) a ON lower(label) = lower_label GROUP BY 1""")
def category_labels(t: Tables) -> DataFrame:
    """Labels mapped by dictionary, by ordered rules and by alias match, with the customers that use them."""
    lower = F.lower(F.trim("label"))
    table = F.create_map(*[x for k, v in dims.LABEL_MAP.items() for x in (F.lit(k), F.lit(v))])
    rules = [("vehicles", ["mobile", "auto"]), ("home", ["house", "furn"]), ("industry", ["machine", "build"])]
    labels = t.read("customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("customers"))
    matched = scores.category_match(labels.select(F.col("label").alias("brand"), F.col("label").alias("category")), dims.label_aliases(t.spark))
    best = matched.groupBy(F.col("brand").alias("label")).agg(
        F.min_by("category", F.struct((-F.col("match")).alias("m"), "category")).alias("alias_category"), F.max("match").alias("match")
    )
    return labels.join(best, "label", "left").select(
        "label", "customers", F.try_element_at(table, lower).alias("mapped"), text.first_rule(lower, rules).alias("rule"), "alias_category", "match"
    )


@query("date_parts", """
SELECT CAST(weekofyear(o_orderdate) AS INTEGER) AS iso_week, CAST((dayofyear(o_orderdate) - 1) // 7 AS BIGINT) AS week_index, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS weekday, strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month,
 CAST(floor((epoch(TIMESTAMP '2001-08-01') - epoch(max(o_orderdate))) / 86400 + 0.5) AS INTEGER) AS days_ago, count(*) AS orders FROM orders GROUP BY 1, 2, 3, 4""")
def date_parts(t: Tables) -> DataFrame:
    day = F.col("o_orderdate")
    age = (F.unix_timestamp(F.lit(dims.AS_OF).cast("timestamp")) - F.unix_timestamp(F.max(day).cast("timestamp"))) / 86400.0
    return t.read("orders").groupBy(
        F.weekofyear(day).alias("iso_week"),
        F.floor((F.dayofyear(day) - 1) / 7).alias("week_index"),
        F.dayofweek(day).alias("weekday"),
        F.date_format(F.date_trunc("month", day), "yyyy-MM").alias("month"),
    ).agg(F.floor(age + 0.5).cast("int").alias("days_ago"), F.count("*").alias("orders"))


@query("tier_ladders", """
SELECT c_custkey, (CASE WHEN r < 1e6 THEN 0.3 WHEN r < 1e7 THEN 0.7 WHEN r < 1e8 THEN 1.0 ELSE 0.5 END)::DOUBLE AS revenue_score, (CASE WHEN r < 1e6 THEN 0.4 WHEN r < 1e7 THEN 0.8 WHEN r < 1e8 THEN 1.0 ELSE 0.5 END)::DOUBLE AS size_fit,
 floor(least(greatest(c_acctbal / 100.0, 0), 60) * 100 + 0.5) / 100.0 AS clamped FROM (SELECT *, greatest(c_acctbal, 0) * 20000 AS r FROM customer)""")
def tier_ladders(t: Tables) -> DataFrame:
    revenue = F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 20000.0
    clamped = F.least(F.greatest(F.col("c_acctbal") / 100.0, F.lit(0.0)), F.lit(60.0))
    return t.read("customer").select(
        "c_custkey", scores.revenue_score(revenue).alias("revenue_score"), scores.size_fit(revenue).alias("size_fit"), half_up(clamped).alias("clamped")
    )


@query("small_parsers", """
SELECT c_custkey, CAST(floor((lo + lo + hi) / 2.0 + 0.5) AS INTEGER) AS employees, CAST(c_custkey + 1000 AS INTEGER) AS reviews, (40 + c_custkey % 10) / 10.0::DOUBLE AS rating,
 ['TIMEOUT', 'RATE_LIMITED', 'BOT_BLOCKED', 'PAGE_NOT_FOUND', 'UNKNOWN'][c_custkey % 5 + 1] AS error_code, c_custkey % 5 IN (0, 1) AS retryable, CAST(2 AS INTEGER) AS tokens
FROM (SELECT c_custkey, c_custkey % 40 + 1 AS lo, c_custkey % 90 + 10 AS hi FROM customer)""")
def small_parsers(t: Tables) -> DataFrame:
    """Employee range, thousands-separated count, localised rating, error text and title words of each account."""
    key = F.col("c_custkey")
    low, high = key % 40 + 1, key % 90 + 10
    rows = t.read("customer").select(
        "c_custkey",
        F.concat_ws("-", low.cast("string"), (low + high).cast("string")).alias("range"),
        F.format_number(key + 1000, 0).alias("count_text"),
        F.format_string("%d,%d von 5 Sternen", F.floor((40 + key % 10) / 10), key % 10).alias("rating_text"),
        F.get(F.array(*[F.lit(m) for m in ("Timeout reached", "HTTP 429", "captcha shown", "404 page", "odd failure")]), (key % 5).cast("int")).alias("error"),
        F.concat(F.lit("of Head/Buyer, "), (key % 9).cast("string")).alias("job"),
    )
    code = text.error_code(F.col("error"))
    return rows.select(
        "c_custkey",
        text.employees(F.col("range")).alias("employees"),
        text.locale_number(F.col("count_text")).alias("reviews"),
        text.rating(F.col("rating_text")).alias("rating"),
        code.alias("error_code"),
        text.retryable(code).alias("retryable"),
        F.size(text.words_over_two(F.col("job"))).alias("tokens"),
    )


@query("clean_labels", """
SELECT p_partkey, CASE WHEN contains(p_name, 'new') THEN 't-shirts' WHEN contains(p_name, 'old') THEN 'mens clothing' ELSE lower(p_type) || ' & ' || p_name END AS label FROM part""")
def clean_labels(t: Tables) -> DataFrame:
    name = F.col("p_name")
    raw = (
        F.when(name.contains("new"), F.concat(F.lit("  Fine  T-Shirt "), name))
        .when(name.contains("old"), F.concat(F.lit("Men's  Clothing "), name))
        .otherwise(F.concat("p_type", F.lit("  &  "), name, F.lit("!")))
    )
    return t.read("part").select("p_partkey", text.clean_category(raw).alias("label"))


@query("text_predicates", """
SELECT event_type, count(*) FILTER (WHERE props->>'$.k' = '7') AS json_equal, count(*) FILTER (WHERE regexp_matches(lower(event_type), 'click|pur')) AS regex_hits, count(*) FILTER (WHERE event_type ILIKE '%SIGN%') AS ilike_hits,
 count(*) FILTER (WHERE lower(event_type) = lower('VIEW')) AS ci_equal, count(*) FILTER (WHERE value >= 50 / 100.0) AS pct_hits, count(*) AS n FROM events GROUP BY 1""")
def text_predicates(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.read("events").groupBy("event_type").agg(
        F.count_if(F.get_json_object("props", "$.k") == "7").alias("json_equal"),
        F.count_if(F.lower(kind).rlike("click|pur")).alias("regex_hits"),
        F.count_if(kind.ilike("%SIGN%")).alias("ilike_hits"),
        F.count_if(F.lower(kind) == F.lower(F.lit("VIEW"))).alias("ci_equal"),
        F.count_if(F.col("value") >= 50 / 100.0).alias("pct_hits"),
        F.count("*").alias("n"),
    )


@query("summary_counts", """
SELECT country, category, signals, top_kind, last_on FROM (SELECT country, category, CAST(sum(n) AS BIGINT) AS signals, arg_max(kind, (n, kind)) AS top_kind, strftime(max(l), '%Y-%m-%d') AS last_on FROM (
 SELECT country, category, kind, count(*) AS n, max(detected_at) AS l FROM v_activity GROUP BY 1, 2, 3) GROUP BY 1, 2)""")
def summary_counts(t: Tables) -> DataFrame:
    by_kind = views.activity(t).groupBy("country", "category", "kind").agg(F.count("*").alias("n"), F.max("detected_at").alias("l"))
    return by_kind.groupBy("country", "category").agg(
        F.sum("n").alias("signals"), F.max_by("kind", F.struct("n", "kind")).alias("top_kind"), F.date_format(F.max("l"), "yyyy-MM-dd").alias("last_on")
    )


@query("signal_totals", """
SELECT kind, signals, countries, top_country, CAST(top_signals AS BIGINT) AS top_signals FROM (SELECT kind, CAST(sum(n) AS BIGINT) AS signals, count(*) AS countries,
 arg_min(country, (-n, country)) AS top_country, max(n) AS top_signals FROM (SELECT coalesce(kind, 'all') AS kind, country, count(*) AS n FROM v_activity GROUP BY GROUPING SETS ((kind, country), (country))) GROUP BY 1)""")
def signal_totals(t: Tables) -> DataFrame:
    """Signals by source and over all of them, with the country that has most (ties: first by name)."""
    per_country = views.activity(t).groupBy("kind", "country").agg(F.count("*").alias("n"))
    every = per_country.groupBy("country").agg(F.sum("n").alias("n")).select(F.lit("all").alias("kind"), "country", "n")
    return per_country.select("kind", "country", "n").unionByName(every).groupBy("kind").agg(
        F.sum("n").alias("signals"), F.count("*").alias("countries"), F.min_by("country", F.struct(-F.col("n"), "country")).alias("top_country"), F.max("n").alias("top_signals")
    )


@query("latest_jobs", """
SELECT event_type AS job_type, strftime(last.ts, '%Y-%m-%d %H:%M:%S') AS started_at, last.event_id AS job, last.user_id AS run_by, n AS runs
FROM (SELECT event_type, arg_max({'ts': ts, 'event_id': event_id, 'user_id': user_id}, (ts, event_id)) AS last, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1)""")
def latest_jobs(t: Tables) -> DataFrame:
    """The last started job of each type: one row a type leaves each task."""
    last = F.max_by(F.struct("ts", "event_id", "user_id"), F.struct("ts", "event_id")).alias("last")
    return t.read("events").filter("ts IS NOT NULL").groupBy("event_type").agg(last, F.count("*").alias("runs")).select(
        F.col("event_type").alias("job_type"), F.date_format("last.ts", "yyyy-MM-dd HH:mm:ss").alias("started_at"), F.col("last.event_id").alias("job"),
        F.col("last.user_id").alias("run_by"), "runs",
    )
