"""Queries: feed readers, search interest, entity resolution and keyed updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tradewind.functions.numeric import half_up, money
from tradewind.operators import entities, keywords, merge
from tradewind.plans.leads import LeadInputs
from tradewind.plans.oracle_views import register
from tradewind.plans.registry import query
from tradewind.plans.scores import R
from tradewind.sources import dims, feeds, views
from tradewind.sources.tables import Tables, list_scan

_CODES = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.CATEGORY_CODE.items()) + " END"


def trade_feed(t: Tables) -> DataFrame:
    """Monthly totals as statistics payloads: odd months carry a period, even ones year and month; one market reports negatives."""
    cube = views.monthly_cube(t)
    table = F.create_map(*[x for k, v in dims.CATEGORY_CODE.items() for x in (F.lit(k), F.lit(v))])
    ym, odd = F.col("ym"), F.col("ym") % 2 == 1
    sign = F.when(F.col("partner") == "NATION_7", -1.0).otherwise(1.0)
    code = F.concat(F.lit("HS "), F.substring(F.try_element_at(table, F.col("category")), 1, 4), F.lit("."), F.substring(F.try_element_at(table, F.col("category")), 5, 2))
    row = F.struct(
        F.floor(ym / 100).cast("int").alias("refYear"),
        (ym % 100).alias("refMonth"),
        F.when(odd, ym).alias("period"),
        code.alias("cmdCode"),
        (money(F.col("cents")) * sign).alias("primaryValue"),
        (F.col("qty") * 40.0).alias("netWgt"),
    )
    flow = views.flow_type(F.col("reporter"), F.col("partner_region"))
    return cube.filter(flow != "other").select(flow.alias("flow"), "partner", F.to_json(row).alias("payload"))


@query("feed_parse", f"""
SELECT flow, partner, ym, chapter, category, value AS trade_value, weight AS net_weight, CASE WHEN weight > 0 THEN {R("value / weight")} END AS unit_value FROM (
 SELECT flow, partner, ym, CASE WHEN category = 'SMALL' THEN '2106' ELSE left({_CODES}, 2) END AS chapter, category, CASE WHEN partner <> 'NATION_7' THEN CAST(cents AS DOUBLE) / 100 END AS value, qty * 40.0 AS weight
 FROM (SELECT *, CASE WHEN reporter = 'AMERICA' AND partner_region = 'EUROPE' THEN 'us_to_eu' WHEN reporter = 'EUROPE' AND partner_region = 'AMERICA' THEN 'eu_to_us'
   WHEN reporter = 'AMERICA' AND partner_region = 'ASIA' THEN 'us_to_uk' WHEN reporter = 'ASIA' AND partner_region = 'EUROPE' THEN 'uk_to_eu' ELSE 'other' END AS flow FROM v_cube)
 WHERE flow <> 'other' AND ym BETWEEN 199901 AND 200012)""")
def feed_parse(t: Tables) -> DataFrame:
    feed = trade_feed(t)
    names = list(dict.fromkeys(dims.FLOW_ROUTES.values()))
    rows = feeds.trade_rows(feed.filter(F.col("flow").isin(names)))
    return rows.select("flow", "partner", "ym", "chapter", "category", "trade_value", "net_weight", "unit_value")


def stat_cubes(t: Tables) -> DataFrame:
    """One geo x year document per category; a document has markets x years cells."""
    cells = views.share(views.annual_cube(t)).select("category", "country", "year", "world")
    n_time = len(dims.TRADE_YEARS)
    geo = F.split("country", "_").getItem(1).cast("int")
    at = geo * n_time + (F.col("year") - dims.TRADE_YEARS[0])
    value = F.map_from_entries(F.array_sort(F.collect_list(F.struct(at.cast("string").alias("k"), half_up(F.col("world")).alias("v")))))
    index = F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col("country").alias("k"), geo.alias("v")))))
    time = F.create_map(*[x for i, y in enumerate(dims.TRADE_YEARS) for x in (F.lit(str(y)), F.lit(i))])
    grouped = cells.groupBy("category").agg(index.alias("geo"), value.alias("value"))
    return grouped.select("category", F.to_json(F.struct("geo", time.alias("time"), "value")).alias("payload"))


@query("jsonstat_cube", f"SELECT category, country AS geo, CAST(year AS VARCHAR) AS time, {R('world')} AS value FROM v_share")
def jsonstat_cube(t: Tables) -> DataFrame:
    return feeds.cube_cells(stat_cubes(t), ["category"])


@query("jsonstat_totals", f"SELECT category, CAST(year AS VARCHAR) AS time, round(sum({R('world')}) * 1000.0 * 1.08, 0) AS usd FROM v_share GROUP BY 1, 2")
def jsonstat_totals(t: Tables) -> DataFrame:
    totals = feeds.time_totals(feeds.cube_cells(stat_cubes(t), ["category"]), ["category"])
    return totals.select("category", "time", F.round("usd", 0).alias("usd"))


def candidate_audits(t: Tables) -> DataFrame:
    """Audit rows of up to 50 company candidates each; every tenth audit holds a single object instead."""
    key = F.col("suppkey")
    site = F.when(key % 3 == 0, F.concat(F.lit("www.s"), key.cast("string"), F.lit(".de"))).otherwise(F.concat(F.lit("http://s"), key.cast("string"), F.lit(".example.fr/x")))
    row = F.struct(F.col("name").alias("companyName"), site.alias("websiteUrl"), (key % 2 == 0).alias("isDistributor"), F.when(key % 5 == 0, "NL").alias("countryCode"))
    audits = views.distributors(t).groupBy(F.floor(key / 50).alias("audit"), (key % 10).alias("slot")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    whole = F.to_json("rows")
    single = F.to_json(F.get("rows", F.lit(0)))
    return audits.select("audit", F.when(F.col("slot") == 9, single).otherwise(whole).alias("payload"))


register("v_candidates", """
SELECT s_suppkey // 50 AS audit, s_name AS "companyName", CASE WHEN s_suppkey % 3 = 0 THEN 'www.s' || s_suppkey || '.de' ELSE 'http://s' || s_suppkey || '.example.fr/x' END AS "websiteUrl",
 s_suppkey % 2 = 0 AS "isDistributor", CASE WHEN s_suppkey % 5 = 0 THEN 'NL' END AS "countryCode" FROM supplier WHERE s_suppkey % 10 <> 9""")


@query("json_explode", "SELECT * FROM v_candidates")
def json_explode(t: Tables) -> DataFrame:
    return feeds.candidates(candidate_audits(t))


# ---- search interest ------------------------------------------------------------------------------


def timelines(t: Tables) -> DataFrame:
    """Event counts per day and kind as a search-interest timeline per user group; the last day of the table is partial.

    The kinds and the last day are read from the table: one row reaches the driver.
    """
    day = F.to_date("ts")
    seen = t.read("events").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"), F.max(day).alias("last")).first()
    kinds, last = list(seen["kinds"] or []), seen["last"]
    group = F.concat(F.lit("group"), (F.col("user_id") % 10).cast("string"))
    per_day = t.read("events").groupBy(group.alias("grp"), day.alias("day")).agg(
        F.array(*[F.count_if(F.col("event_type") == k).cast("double") for k in kinds]).cast("array<double>").alias("value")
    )
    point = F.struct(F.unix_timestamp(F.col("day").cast("timestamp")).alias("time"), "value", (F.col("day") >= F.lit(last)).alias("isPartial"))
    # A timeline has one point per day of the period, so the list is bounded by the calendar.
    lists = per_day.groupBy("grp").agg(F.array_sort(F.collect_list(point)).alias("points"))
    return lists.select("grp", F.to_json(F.struct(F.array(*[F.lit(k) for k in kinds]).alias("keywords"), "points")).alias("payload"))


register("v_points", """
SELECT grp, day, keyword, CAST(count(event_id) AS DOUBLE) AS value, day >= (SELECT max(CAST(ts AS DATE)) FROM events) AS is_partial FROM (
 SELECT DISTINCT 'group' || CAST(user_id % 10 AS VARCHAR) AS grp, CAST(ts AS DATE) AS day FROM events) d CROSS JOIN (SELECT DISTINCT event_type AS keyword FROM events) k
LEFT JOIN (SELECT event_id, 'group' || CAST(user_id % 10 AS VARCHAR) AS grp, CAST(ts AS DATE) AS day, event_type AS keyword FROM events) e USING (grp, day, keyword) GROUP BY 1, 2, 3""", True)


def _points(t: Tables) -> DataFrame:
    return feeds.timeline_points(timelines(t), ["grp"])


@query("timeline_points", "SELECT grp, strftime(day, '%Y-%m-%d') AS day, keyword, value, is_partial FROM v_points")
def timeline_points(t: Tables) -> DataFrame:
    return _points(t).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("keyword_rank", f"""
SELECT grp, keyword, avg_interest, change, position, position = 1 AS is_winner, change > 0 AS is_accelerating FROM (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY avg_interest DESC, keyword) AS INTEGER) AS position FROM (
 SELECT grp, keyword, {R("avg(value)")} AS avg_interest, arg_max(value, day) - arg_min(value, day) AS change FROM v_points WHERE NOT is_partial GROUP BY 1, 2))""")
def keyword_rank(t: Tables) -> DataFrame:
    return keywords.keyword_scores(_points(t), ["grp"])


@query("daily_interest", f"SELECT grp, strftime(day, '%Y-%m-%d') AS day, {R('avg(value)')} AS value FROM v_points WHERE NOT is_partial GROUP BY 1, day")
def daily_interest(t: Tables) -> DataFrame:
    return keywords.daily_mean(_points(t), ["grp"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("trend_enrich", f"""
SELECT grp, keyword, last_value, {R("mean_before")} AS mean_before, coalesce(n >= 5 AND mean_before > 0 AND last_value > mean_before * 1.5, false) AS breakout, coalesce(terms, '') AS terms FROM (
 SELECT grp, keyword, arg_max(value, day) AS last_value, arg_max(b, day) AS mean_before, arg_max(n, day) AS n FROM (
  SELECT *, avg(value) OVER (PARTITION BY grp, keyword ORDER BY day ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS b, row_number() OVER (PARTITION BY grp, keyword ORDER BY day) AS n FROM v_points WHERE NOT is_partial) GROUP BY 1, 2)
LEFT JOIN (SELECT grp, string_agg(query, ',' ORDER BY rn) AS terms FROM (SELECT grp, query, row_number() OVER (PARTITION BY grp ORDER BY pos, query) AS rn FROM (
  SELECT 'group' || CAST(user_id % 10 AS VARCHAR) AS grp, event_type || ' ' || (props->>'$.k') AS query, min(event_id) AS pos FROM events WHERE value > 50 GROUP BY 1, 2)) WHERE rn <= 5 GROUP BY 1) USING (grp)""")
def trend_enrich(t: Tables) -> DataFrame:
    rising = t.read("events").filter("value > 50").select(
        F.concat(F.lit("group"), (F.col("user_id") % 10).cast("string")).alias("grp"),
        F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")).alias("query"),
        F.col("event_id").alias("pos"),
    )
    terms = keywords.emerging_terms(rising, ["grp"])
    return keywords.breakouts(_points(t), ["grp"]).join(terms, "grp", "left").withColumn("terms", F.coalesce("terms", F.lit("")))


# ---- entities -------------------------------------------------------------------------------------


def partner_names(t: Tables) -> DataFrame:
    """Names as partners write them: with punctuation, cut short, or of unknown companies."""
    key = F.col("s_suppkey")
    name = (
        F.when(key % 4 == 0, F.concat(F.lit(" "), F.upper("s_name"), F.lit("!")))
        .when(key % 4 == 1, F.substring("s_name", 4, 30))
        .when(key % 4 == 2, F.concat(F.lit("Unknown "), F.col("s_name")))
        .otherwise(F.substring("s_name", 13, 6))
    )
    return t.read("supplier").select(F.col("s_suppkey").alias("mention"), name.alias("name"))


def _targets(t: Tables) -> DataFrame:
    return t.read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


register("v_mentions", """
SELECT s_suppkey AS mention, CASE s_suppkey % 4 WHEN 0 THEN ' ' || upper(s_name) || '!' WHEN 1 THEN substring(s_name, 4, 30) WHEN 2 THEN 'Unknown ' || s_name ELSE substring(s_name, 13, 6) END AS name FROM supplier""")


@query("fuzzy_entity", """
SELECT mention, name, (SELECT min(s_suppkey) FROM supplier WHERE length(q) >= 3 AND contains(lower(regexp_replace(s_name, '[^a-zA-Z0-9 ]', '', 'g')), q)) AS id
FROM (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9\\s]', '', 'g')) AS q FROM v_mentions)""")
def fuzzy_entity(t: Tables) -> DataFrame:
    return entities.substring_match(partner_names(t), _targets(t))


@query("url_match", """
WITH o AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#:]+)', 1)) AS origin FROM pages)
SELECT o.page_id, o.url, o.origin, k.owner FROM o LEFT JOIN (SELECT origin, min(page_id) AS owner FROM o GROUP BY 1) k USING (origin)""")
def url_match(t: Tables) -> DataFrame:
    pages = t.read("pages")
    known = pages.select(F.regexp_replace("url", "^http", "HTTP").alias("site"), F.col("page_id").alias("owner"))
    return entities.url_match(pages.select("page_id", "url"), known)


@query("portfolio_edges", """
SELECT suppkey, brand, CASE WHEN suppkey % 2 = 0 THEN 'direct' ELSE 'retail' END AS category, 0.9::DOUBLE AS confidence FROM v_dist_brand WHERE suppkey % 7 <> 0""")
def portfolio_edges(t: Tables) -> DataFrame:
    key = F.col("suppkey")
    carried = views.distributor_brands(views.supply_rollup(t)).join(_targets(t).withColumnsRenamed({"id": "suppkey"}), "suppkey")
    shout = F.concat(F.upper("name"), F.lit("."))
    payload = F.to_json(
        F.struct(
            F.col("brand").alias("brandName"),
            F.when((key % 7 != 0) & (key % 2 == 0), shout).alias("buyerName"),
            F.when((key % 7 != 0) & (key % 2 == 1), shout).alias("retailerName"),
            F.when(key % 2 == 0, "direct").otherwise("retail").alias("category"),
        )
    )
    return entities.portfolio_edges(carried.select(payload.alias("payload")), _targets(t))


@query("distributor_discovery", """
WITH c AS (SELECT trim("companyName") AS name, coalesce("countryCode", CASE WHEN "websiteUrl" LIKE '%.de' THEN 'DE' ELSE 'FR' END) AS country, 'directory' AS source FROM v_candidates WHERE "isDistributor"
 UNION ALL SELECT exhibitor, 'EU', 'trade_show' FROM v_exhibitors WHERE suppkey % 3 = 1)
SELECT lower(name) AS key, country, name, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), country ORDER BY source, name) AS rn FROM c) WHERE rn = 1""")
def distributor_discovery(t: Tables) -> DataFrame:
    key = F.col("suppkey")
    booth = F.when(key % 3 == 0, "Producer of goods").when(key % 3 == 1, "Wholesaler and distributor").otherwise("Brand owner")
    booths = views.exhibitors(t).withColumn("booth", booth)
    return entities.discover_distributors(feeds.candidates(candidate_audits(t)), booths)


# ---- keyed updates --------------------------------------------------------------------------------

CORRIDOR_KEYS = ["country", "category"]


def start_of_month(ym: int) -> str:
    return f"{ym // 100}-{ym % 100:02d}-01"


def _monthly_rows(t: Tables, start: int, end: int) -> DataFrame:
    """Latest monthly total per corridor within a span of months; both ends count."""
    until = start_of_month(end + 1 if end % 100 < 12 else end + 89)
    months = (
        views.corridor_cube(t, start=start_of_month(start), until=until)
        .groupBy(F.col("partner").alias("country"), "category", "ym")
        .agg(F.sum("cents").alias("cents"))
    )
    return merge.latest(months, CORRIDOR_KEYS, ["ym"])


register("v_corridor_months", "SELECT partner AS country, category, ym, CAST(sum(cents) AS BIGINT) AS cents FROM v_cube GROUP BY 1, 2, 3", True)
_LATEST = "SELECT country, category, max(ym) AS ym, arg_max(cents, ym) AS cents FROM v_corridor_months WHERE ym BETWEEN {0} AND {1} GROUP BY 1, 2"
# The whole table: history up to a month, and what came after it.
OLD_MONTHS, NEW_MONTHS = (190001, 199912), (200001, 299912)
register("v_old_rows", _LATEST.format(*OLD_MONTHS))
register("v_new_rows", _LATEST.format(*NEW_MONTHS))


def _rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    return _monthly_rows(t, *OLD_MONTHS), _monthly_rows(t, *NEW_MONTHS)


@query("upsert_latest", "SELECT * FROM v_new_rows UNION ALL SELECT * FROM v_old_rows o WHERE NOT EXISTS (SELECT 1 FROM v_new_rows n WHERE n.country = o.country AND n.category = o.category)")
def upsert_latest(t: Tables) -> DataFrame:
    return merge.upsert(*_rows(t), CORRIDOR_KEYS)


@query("insert_absent", """
SELECT * FROM v_old_rows WHERE category <> 'SMALL' UNION ALL SELECT * FROM v_new_rows n
WHERE NOT EXISTS (SELECT 1 FROM v_old_rows o WHERE o.category <> 'SMALL' AND o.country = n.country AND o.category = n.category)""")
def insert_absent(t: Tables) -> DataFrame:
    old, new = _rows(t)
    return merge.insert_absent(old.filter("category <> 'SMALL'"), new, CORRIDOR_KEYS)


register("v_grain_old", "SELECT CAST(NULL AS VARCHAR) AS brand, country, category, ym, cents FROM v_old_rows UNION ALL SELECT 'Brand#1', country, category, ym, cents FROM v_old_rows")
register("v_grain_new", "SELECT CAST(NULL AS VARCHAR) AS brand, country, category, ym, cents FROM v_new_rows UNION ALL SELECT CASE WHEN category = 'SMALL' THEN 'Brand#1' ELSE 'Brand#2' END, country, category, ym, cents FROM v_new_rows")


def grain_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Old and new rows of a table of two grains."""
    old, new = _rows(t)
    cols = ["brand", *CORRIDOR_KEYS, "ym", "cents"]
    both = lambda df, brand: df.withColumn("brand", F.lit(None).cast("string")).select(*cols).unionByName(df.withColumn("brand", brand).select(*cols))
    return both(old, F.lit("Brand#1")), both(new, F.when(F.col("category") == "SMALL", "Brand#1").otherwise("Brand#2"))


@query("grain_upsert", """
SELECT * FROM v_grain_new UNION ALL SELECT * FROM v_grain_old o WHERE NOT EXISTS (SELECT 1 FROM v_grain_new n WHERE n.country = o.country AND n.category = o.category AND n.brand IS NOT DISTINCT FROM o.brand)""")
def grain_upsert(t: Tables) -> DataFrame:
    base, delta = grain_rows(t)
    return merge.upsert_by_grain(base, delta, "brand", ["brand", *CORRIDOR_KEYS], CORRIDOR_KEYS)


@query("flag_update", """
SELECT c_custkey, CASE WHEN n > 0 THEN 'active' ELSE 'dormant' END AS state FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2001-05-03' GROUP BY 1) ON o_custkey = c_custkey""")
def flag_update(t: Tables) -> DataFrame:
    recent = t.read("orders").filter(F.col("o_orderdate") >= F.lit("2001-05-03")).select(F.col("o_custkey").alias("c_custkey"))
    rows = t.read("customer").select("c_custkey", F.lit("dormant").alias("state"))
    return merge.update_where(rows, recent, ["c_custkey"], {"state": F.lit("active")})


@query("freshness", """
SELECT DISTINCT country, category FROM v_corridor_months m WHERE NOT EXISTS (SELECT 1 FROM v_activity a WHERE a.country = m.country AND a.category = m.category AND a.detected_at >= TIMESTAMP '2001-07-31 04:00:00')""")
def freshness(t: Tables) -> DataFrame:
    wanted = views.corridor_cube(t).select(F.col("partner").alias("country"), "category").distinct()
    as_of = F.lit(dims.AS_OF).cast("timestamp")
    return merge.stale_keys(wanted, views.activity(t, 2), CORRIDOR_KEYS, F.col("detected_at") >= as_of - F.expr("INTERVAL 20 HOURS"))


# ---- list queries and detail bundles --------------------------------------------------------------


@query("list_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0 AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def list_customers(t: Tables) -> DataFrame:
    filters = {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") == "BUILDING", "region": None}
    return list_scan(t.read("customer"), filters, [F.desc("c_acctbal"), F.asc("c_custkey")], 100).select("c_custkey", "c_name", "c_acctbal")


@query("list_paged", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def list_paged(t: Tables) -> DataFrame:
    filters = {"status": F.col("o_orderstatus").isin("F", "O")}
    return list_scan(t.read("orders"), filters, [F.desc("o_totalprice"), F.asc("o_orderkey")], 25, 50).select("o_orderkey", "o_totalprice")


@query("severity_order", """
SELECT CAST(row_number() OVER (ORDER BY CASE risk WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, f.category, market, kind) AS INTEGER) AS position, f.category, market, risk, kind, coalesce(n, 0) AS distributors
FROM v_flags f LEFT JOIN (SELECT category, count(*) AS n FROM v_dist_cat GROUP BY 1) d ON d.category = f.category""")
def severity_order(t: Tables) -> DataFrame:
    level = F.when(F.col("risk") == "high", 3).when(F.col("risk") == "medium", 2).otherwise(1)
    counts = views.distributor_categories(views.supply_rollup(t)).groupBy("category").agg(F.count("*").alias("n"))
    order = Window.orderBy(level.desc(), "category", "market", "kind")  # as many rows as the fixed flag list
    return dims.regulatory_flags(t.spark).join(counts, "category", "left").select(
        F.row_number().over(order).alias("position"), "category", "market", "risk", "kind", F.coalesce("n", F.lit(0)).alias("distributors")
    )


#: Scores that a brand's page shows.
BRAND_SCORES = 20


@query("brand_detail", f"""
SELECT b.brand, round(b.revenue, 2) AS revenue, b.eu_presence, c.categories, s.best, coalesce(l.leads, 0) AS leads FROM v_brands b LEFT JOIN (SELECT brand, string_agg(category, ',' ORDER BY category) AS categories FROM v_brand_cat GROUP BY 1) c USING (brand)
LEFT JOIN (SELECT brand, string_agg(category || '/' || country, ',' ORDER BY rn) AS best FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY composite_score DESC, country, category) AS rn FROM v_brand_scores) WHERE rn <= {BRAND_SCORES} GROUP BY 1) s USING (brand)
LEFT JOIN (SELECT brand, count(*) AS leads FROM v_leads WHERE linked GROUP BY 1) l USING (brand)""")
def brand_detail(t: Tables) -> DataFrame:
    x = LeadInputs(t)
    w = Window.partitionBy("brand").orderBy(F.desc("composite_score"), "country", "category")
    top = x.brand_fit.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= BRAND_SCORES)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rn", "category", "country"))), lambda s: F.concat_ws("/", s["category"], s["country"]))
    best = top.groupBy("brand").agg(F.array_join(listed, ",").alias("best"))
    names = x.brand_categories.groupBy("brand").agg(F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))
    counts = views.leads(t).filter("linked").groupBy("brand").agg(F.count("*").alias("leads"))
    return (
        views.brands(x.cells).join(names, "brand", "left").join(best, "brand", "left").join(counts, "brand", "left")
        .select("brand", F.round("revenue", 2).alias("revenue"), "eu_presence", "categories", "best", F.coalesce("leads", F.lit(0)).alias("leads"))
    )


@query("lead_detail", """
SELECT l.lead, company, l.status, coalesce(n, 0) AS campaigns, c.campaign, strftime(c.created_on, '%Y-%m-%d') AS campaign_on, c.status AS campaign_status, s.stage FROM v_leads l LEFT JOIN v_campaigns c ON c.lead = l.lead
LEFT JOIN (SELECT lead, count(*) AS n, arg_max(stage, (created_on, campaign)) AS stage FROM v_campaigns GROUP BY 1) s ON s.lead = l.lead""")
def lead_detail(t: Tables) -> DataFrame:
    """Every lead with its campaign count and pipeline stage, one row for each of its campaigns, however many; a lead without campaigns has one row."""
    history = views.campaigns(t)
    whole = history.groupBy("lead").agg(F.count("*").alias("n"), F.max_by("stage", F.struct("created_on", "campaign")).alias("stage"))
    each = history.select("lead", "campaign", F.date_format("created_on", "yyyy-MM-dd").alias("campaign_on"), F.col("status").alias("campaign_status"))
    rows = views.leads(t).select("lead", "company", "status").join(whole, "lead", "left").join(each, "lead", "left")
    return rows.select("lead", "company", "status", F.coalesce("n", F.lit(0)).alias("campaigns"), "campaign", "campaign_on", "campaign_status", "stage")
