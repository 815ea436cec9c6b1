"""Queries: routing signals, retail patterns, gap, composite and brand scores."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from tradewind.functions.numeric import half_up
from tradewind.operators import retail, routing, scores, trade
from tradewind.plans.oracle_views import register
from tradewind.plans.registry import query
from tradewind.sources import dims, views
from tradewind.sources.stages import stage
from tradewind.sources.tables import Tables

R = lambda x, p=2: f"floor(({x}) * {10**p} + 0.5) / {10**p}.0"
CL = lambda x, a, b: f"least(greatest({x}, {a}), {b})"

# ---- routing ------------------------------------------------------------------------------------

register("v_sig_shift", f"""
SELECT category, 'ALL' AS country, 'gateway_shift' AS signal_type, 'vat_advantage' AS dimension,
  {R(CL("(premium - 5.0) / 30.0", 0, 1), 6)} AS strength, {R("gateway")} AS gateway_growth_pct,
  {R("coalesce(direct, 0)")} AS direct_growth_pct, {R("premium")} AS premium_pp, coalesce(c, 0) / 100.0 AS onward_value
FROM (SELECT *, gateway - coalesce(direct, 0) AS premium FROM (
 SELECT category, avg(growth_yoy) FILTER (WHERE flow = 'us_to_uk') AS gateway, avg(growth_yoy) FILTER (WHERE flow = 'us_to_eu') AS direct,
  CAST(sum(cents) FILTER (WHERE flow = 'uk_to_eu') AS DOUBLE) AS c FROM v_growth WHERE year = 2000 GROUP BY 1))
WHERE premium >= 5 AND gateway >= 5""")
register("v_sig_reexport", f"""
SELECT category, country, 'reexport' AS signal_type, 'vat_advantage' AS dimension,
  {R("CASE WHEN coalesce(r > r0, false) THEN least(1, greatest(0, least(1, r / 0.5)) * 1.2) ELSE greatest(0, least(1, r / 0.5)) END", 6)} AS strength,
  {R("r")} AS ratio, {R("r0")} AS ratio_before, {R("r - r0")} AS ratio_growth, coalesce(r > r0, false) AS is_growing
FROM (SELECT category, country, b1 / a1 AS r, CASE WHEN a0 > 0 AND b0 > 0 THEN b0 / a0 END AS r0 FROM (
 SELECT category, partner AS country, CAST(sum(cents) FILTER (WHERE flow = 'us_to_eu' AND year = 2000) AS DOUBLE) AS a1,
  CAST(sum(cents) FILTER (WHERE flow = 'uk_to_eu' AND year = 2000) AS DOUBLE) AS b1, CAST(sum(cents) FILTER (WHERE flow = 'us_to_eu' AND year = 1998) AS DOUBLE) AS a0,
  CAST(sum(cents) FILTER (WHERE flow = 'uk_to_eu' AND year = 1998) AS DOUBLE) AS b0 FROM v_annual GROUP BY 1, 2) WHERE a1 > 0 AND b1 > 0) WHERE r >= 0.10""")
register("v_sig_unit", f"""
SELECT category, 'ALL' AS country, 'unit_value' AS signal_type, 'distribution_efficiency' AS dimension,
  {R(CL("(m - 30.0) / 120.0", 0, 1), 6)} AS strength, {R("m")} AS mean_unit_value, mx AS max_unit_value, coalesce(c, 0) / 100.0 AS latest_value, n AS sample_size
FROM (SELECT category, CAST(sum(CAST(round(unit_value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS m, max(unit_value) AS mx,
  CAST(sum(cents) FILTER (WHERE year = 2000) AS DOUBLE) AS c, count(*) AS n
 FROM v_annual WHERE flow = 'us_to_eu' AND unit_value > 0 AND unit_value < 100000 GROUP BY 1) WHERE m >= 30""")
register("v_importers", """
SELECT category, country, count(*) AS importers FROM v_distributors JOIN v_dist_cat USING (suppkey) WHERE imports GROUP BY 1, 2""")
register("v_sig_distributor", f"""
SELECT category, country, 'distributor_gap' AS signal_type, 'distribution_efficiency' AS dimension,
  {R(CL(f"{CL('g / 50.0', 0, 1)} * (1.0 - importers / 3.0)", 0, 1), 6)} AS strength, importers, {R("g")} AS growth_pct
FROM (SELECT category, country, g, coalesce(importers, 0) AS importers FROM (
  SELECT category, partner AS country, avg(growth_yoy) AS g FROM v_growth WHERE flow = 'us_to_eu' AND year = 2000 AND growth_yoy IS NOT NULL GROUP BY 1, 2)
 LEFT JOIN v_importers USING (category, country)) WHERE g >= 5 AND importers < 3""")
register("v_routing", """
SELECT category, country, signal_type, dimension, strength FROM v_sig_shift UNION ALL SELECT category, country, signal_type, dimension, strength FROM v_sig_reexport
UNION ALL SELECT category, country, signal_type, dimension, strength FROM v_sig_unit UNION ALL SELECT category, country, signal_type, dimension, strength FROM v_sig_distributor""", True)


def _dimensions(corridors: str) -> str:
    return f"""
SELECT c.category, c.country, coalesce(max(strength) FILTER (WHERE dimension = 'vat_advantage'), 0) AS vat,
  coalesce(max(strength) FILTER (WHERE dimension = 'distribution_efficiency'), 0) AS dist
FROM ({corridors}) c JOIN v_routing s ON s.category = c.category AND (s.country = c.country OR s.country = 'ALL') GROUP BY 1, 2"""


register("v_suit_dims", _dimensions("SELECT DISTINCT category, partner AS country FROM v_annual WHERE flow = 'us_to_eu'"))
register("v_corr_dims", _dimensions("SELECT category, country FROM v_active"), True)
register("v_active", "SELECT * FROM v_trends WHERE last_ym >= 200105", True)


class Inputs:
    """The inputs several corridor queries share; each is staged on first use."""

    def __init__(self, t: Tables, *needed: str) -> None:
        self.t = t
        self.prefetch(*needed)

    def prefetch(self, *names: str) -> None:
        """Stage inputs that do not depend on each other at the same time, to keep all executors busy."""
        if names:
            with ThreadPoolExecutor(len(names)) as pool:
                list(pool.map(lambda name: getattr(self, name), names))

    @cached_property
    def market(self) -> DataFrame:
        return stage(views.market_rollup(self.t), "market_rollup")

    @cached_property
    def supply(self) -> DataFrame:
        return stage(views.supply_rollup(self.t), "supply_rollup")

    @cached_property
    def cube(self) -> DataFrame:
        return stage(views.named_cube(self.t, self.market.filter("monthly = 1")), "corridor_cube")

    @cached_property
    def annual(self) -> DataFrame:
        return views.annual(self.cube)

    @cached_property
    def yoy(self) -> DataFrame:
        return trade.yoy(self.annual)

    @cached_property
    def trends(self) -> DataFrame:
        return stage(views.trends(self.cube), "trends")

    @cached_property
    def active(self) -> DataFrame:
        return scores.active_trends(self.trends)

    @cached_property
    def distributors(self) -> DataFrame:
        return stage(views.distributors(self.t), "distributors")

    @cached_property
    def dist_categories(self) -> DataFrame:
        return stage(views.distributor_categories(self.supply), "distributor_categories")

    @cached_property
    def routing_signals(self) -> DataFrame:
        importers = routing.importer_counts(self.distributors, self.dist_categories)
        return stage(routing.all_signals(self.annual, self.yoy, importers), "routing_signals")

    @cached_property
    def dimensions(self) -> DataFrame:
        return routing.corridor_dimensions(self.routing_signals, self.active.select("category", "country")).drop("n_dims")

    @cached_property
    def gap(self) -> DataFrame:
        density = scores.brand_density(self.distributors, self.dist_categories, views.distributor_brands(self.supply))
        reliance = scores.import_reliance(self.active.select("country", "category"), views.share(self.cube))
        return stage(scores.gap_scores(self.active, views.corridor_strength(self.cube), density, reliance), "gap_scores")

    def entry_confidence(self) -> DataFrame:
        events = retail.foreign_events(views.activity(self.t, 30), us_brands(self.t))
        return retail.foreign_entry(events).select("country", "category", F.col("confidence").alias("entry_confidence"))

    @cached_property
    def corridor_scores(self) -> DataFrame:
        margin = scores.margin_potential(self.annual)
        return stage(scores.composite(self.active, self.gap, margin, self.dimensions, self.entry_confidence()), "corridor_scores")

    @cached_property
    def cells(self) -> DataFrame:
        return stage(views.brand_cells(self.t, self.market), "brand_cells")

    @cached_property
    def brand_categories(self) -> DataFrame:
        return views.brand_categories(self.cells)

    @cached_property
    def brand_fit(self) -> DataFrame:
        matches = scores.category_match(self.brand_categories, dims.category_synonyms(self.t.spark))
        return stage(scores.brand_fit(views.brands(self.cells), matches, self.corridor_scores, self.dimensions), "brand_fit")


def us_brands(t: Tables) -> DataFrame:
    number = F.split("p_brand", "#").getItem(1).cast("int")
    return t.read("part").filter(number % 5 == 0).select(F.lower("p_brand").alias("name")).distinct()


@query("routing_shift", "SELECT * FROM v_sig_shift")
def routing_shift(t: Tables) -> DataFrame:
    return routing.routing_shift(trade.yoy(views.annual(views.annual_cube(t))))


@query("reexport_ratio", "SELECT * FROM v_sig_reexport")
def reexport_ratio(t: Tables) -> DataFrame:
    return routing.reexport_ratio(views.annual(views.annual_cube(t)))


@query("unit_value_fit", "SELECT * FROM v_sig_unit")
def unit_value_fit(t: Tables) -> DataFrame:
    return routing.unit_value_fit(views.annual(views.annual_cube(t)))


@query("distributor_gap", "SELECT * FROM v_sig_distributor")
def distributor_gap(t: Tables) -> DataFrame:
    x = Inputs(t)
    return routing.distributor_gap(x.yoy, routing.importer_counts(x.distributors, x.dist_categories))


@query("routing_signals", "SELECT * FROM v_routing")
def routing_signals(t: Tables) -> DataFrame:
    return Inputs(t).routing_signals


@query("suitability", f"""
SELECT category, country, vat AS vat_advantage, dist AS distribution_efficiency, {R("reg", 6)} AS regulatory_clarity,
  {R("100 * (0.4 * vat + 0.3 * dist + 0.3 * reg)")} AS suitability_score,
  CASE WHEN 0.4 * vat >= 0.3 * dist AND 0.4 * vat >= 0.3 * reg THEN 'vat_advantage' WHEN 0.3 * dist >= 0.3 * reg THEN 'distribution_efficiency'
   ELSE 'regulatory_clarity' END AS primary_driver
FROM (SELECT d.*, CAST(1 - coalesce(complexity, 0.5) AS DOUBLE) AS reg FROM v_suit_dims d LEFT JOIN v_complexity USING (category)) WHERE vat > 0 OR dist > 0""")
def suitability(t: Tables) -> DataFrame:
    x = Inputs(t)
    corridors = x.annual.filter("flow = 'us_to_eu'").select("category", F.col("partner").alias("country")).distinct()
    return routing.suitability(x.routing_signals, corridors)


# ---- retail -------------------------------------------------------------------------------------

register("v_recent", "SELECT * FROM v_activity WHERE detected_at >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAYS", True)
register("v_foreign", """
SELECT *, label FROM (SELECT *, brand || CASE WHEN l % 4 = 1 THEN ' Inc' WHEN l % 4 = 2 THEN ' Foods GmbH' ELSE '' END AS label FROM (
 SELECT *, CAST(split_part(id, '-', 2) AS INTEGER) AS l FROM v_recent WHERE kind = 'new_listing'))
WHERE reporter = 'AMERICA' OR CAST(split_part(label, '#', 2) AS VARCHAR) IN ('5', '10', '15', '20', '25') OR label LIKE '% Inc'""")


def _pattern_sql(source: str, name: str, confidence: str) -> str:
    return f"""SELECT country, category, '{name}' AS pattern, retailers, activities, strftime(f, '%Y-%m-%d') AS first_on, strftime(l, '%Y-%m-%d') AS last_on,
  {R(confidence)} AS confidence FROM (SELECT country, category, count(DISTINCT retailer) AS retailers, count(*) AS activities, min(detected_at) AS f,
  max(detected_at) AS l FROM {source} GROUP BY 1, 2) WHERE retailers >= 2"""


register("v_expansion", _pattern_sql(
    "(SELECT * FROM v_recent WHERE kind IN ('new_listing', 'category_expansion'))", "expansion",
    "CAST(least(0.5 + (retailers - 2) * 0.1 + greatest(0, (30 - date_diff('second', l, TIMESTAMP '2001-08-01') / 86400.0) / 30.0) * 0.2, 1.0) AS DOUBLE)"))
register("v_rotation", _pattern_sql("(SELECT * FROM v_recent WHERE kind = 'seasonal_rotation')", "rotation",
                                    "CAST(least(0.4::DOUBLE + (retailers - 2) * 0.08::DOUBLE, 0.85) AS DOUBLE)"))
register("v_entry", _pattern_sql("v_foreign", "foreign_entry", "CAST(least(0.55::DOUBLE + (retailers - 2) * 0.1::DOUBLE, 0.90) AS DOUBLE)"), True)


@query("retail_expansion", "SELECT * FROM v_expansion")
def retail_expansion(t: Tables) -> DataFrame:
    return retail.expansion(views.activity(t, 30))


@query("retail_rotation", "SELECT * FROM v_rotation")
def retail_rotation(t: Tables) -> DataFrame:
    return retail.rotation(views.activity(t, 30))


@query("foreign_entry", "SELECT * FROM v_entry")
def foreign_entry(t: Tables) -> DataFrame:
    return retail.foreign_entry(retail.foreign_events(views.activity(t, 30), us_brands(t)))


@query("retail_patterns", """
SELECT * FROM (SELECT * FROM v_expansion UNION ALL SELECT * FROM v_rotation UNION ALL SELECT * FROM v_entry)""")
def retail_patterns(t: Tables) -> DataFrame:
    events = views.activity(t, 30)
    entries = retail.foreign_entry(retail.foreign_events(events, us_brands(t)))
    return retail.expansion(events).unionByName(retail.rotation(events)).unionByName(entries)


@query("retail_evidence", """
SELECT i.country, i.category, i.pattern, a.id FROM v_expansion i JOIN v_recent a ON a.country = i.country AND a.category = i.category
WHERE a.kind IN ('new_listing', 'category_expansion')""")
def retail_evidence(t: Tables) -> DataFrame:
    events = views.activity(t, 30)
    rows = events.filter(F.col("kind").isin("new_listing", "category_expansion"))
    return retail.evidence(rows, retail.expansion(events))


@query("retail_names", """
SELECT country, category, string_agg(retailer, ', ' ORDER BY retailer) AS names FROM (
 SELECT country, category, retailer, row_number() OVER (PARTITION BY country, category ORDER BY retailer) AS rn
 FROM (SELECT DISTINCT country, category, retailer FROM v_recent)) WHERE rn <= 10 GROUP BY 1, 2""")
def retail_names(t: Tables) -> DataFrame:
    return retail.sample_names(views.activity(t, 30), "retailer")


# ---- correlation --------------------------------------------------------------------------------

register("v_lead_lag", """
SELECT country, category, lag AS lag_months, lag > 0 AS leads_trade, activities,
  CAST(rp // 100 AS VARCHAR) || '-' || lpad(CAST(rp % 100 AS VARCHAR), 2, '0') AS retail_peak,
  CAST(tp // 100 AS VARCHAR) || '-' || lpad(CAST(tp % 100 AS VARCHAR), 2, '0') AS trade_peak,
  CASE WHEN abs(lag) >= 2 THEN 'high' WHEN abs(lag) = 1 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT *, CAST((tp // 100 * 12 + tp % 100) - (rp // 100 * 12 + rp % 100) AS INTEGER) AS lag FROM
 (SELECT country, category, arg_max(ym, (n, -ym)) AS rp, CAST(sum(n) AS BIGINT) AS activities FROM (
   SELECT partner AS country, category, year(o_orderdate) * 100 + month(o_orderdate) AS ym, count(*) AS n FROM v_lines GROUP BY 1, 2, 3) GROUP BY 1, 2)
 JOIN (SELECT country, category, arg_max(ym, (c, -ym)) AS tp, count(*) AS months FROM (
   SELECT partner AS country, category, ym, CAST(sum(cents) AS BIGINT) AS c FROM v_monthly WHERE flow = 'us_to_eu' GROUP BY 1, 2, 3) GROUP BY 1, 2)
 USING (country, category) WHERE activities >= 3 AND months >= 3)""", True)
register("v_show_cat", """
SELECT show_id, category, string_agg(DISTINCT label, ', ' ORDER BY label) AS overlap
FROM v_show_labels JOIN v_show_keywords ON contains(lower(label), keyword) GROUP BY 1, 2""")
register("v_targets", """
SELECT category, show_id, show_name, country, days_until, CASE WHEN days_until <= 60 THEN 'high' WHEN days_until <= 180 THEN 'medium' ELSE 'low' END AS urgency,
  overlap, coalesce(n, 0) AS exhibitors
FROM (SELECT s.*, CAST(greatest(0, start_on - DATE '2001-08-01') AS INTEGER) AS days_until FROM v_shows s WHERE start_on >= DATE '2001-08-01')
JOIN v_show_cat USING (show_id) LEFT JOIN (SELECT show_id, count(*) AS n FROM v_exhibitors GROUP BY 1) USING (show_id)""")
register("v_coverage", f"""
SELECT country, category, n AS distributors, yoy_growth_pct, CASE WHEN n < 2 THEN 'sparse' WHEN n < 5 THEN 'moderate' ELSE 'dense' END AS density,
  {R("0.6 * least(greatest(coalesce(yoy_growth_pct, 0), 0) / 50.0, 1) + 0.4 * greatest(0, 1 - n / 10.0)")} AS brokered_score
FROM (SELECT g.partner AS country, g.category, yoy_growth_pct, coalesce(n, 0) AS n FROM v_series_growth g LEFT JOIN (
  SELECT d.country, k.category, count(DISTINCT suppkey) AS n FROM v_distributors d JOIN v_dist_cat c USING (suppkey)
  JOIN v_show_keywords k ON contains(lower(c.category), k.keyword) GROUP BY 1, 2) x ON x.country = g.partner AND x.category = g.category WHERE flow = 'us_to_eu')""")
register("v_correlation", """
SELECT country, category, tier, CAST(least(floor(coalesce(base, 8) + bonus + least(high * 10 + medium * 4, 20) + coalesce(floor(brokered_score * 15 + 0.5), 0) + 0.5), 100) AS INTEGER) AS correlation_score,
  concat_ws('; ', CASE WHEN leads_trade AND confidence <> 'low' THEN 'Retail in ' || country || ' precedes trade by ' || lag_months || ' month(s)' END,
   CASE WHEN NOT leads_trade AND confidence <> 'low' THEN 'Retail in ' || country || ' lags trade by ' || abs(lag_months) || ' month(s)' END,
   CASE WHEN high > 0 THEN high || ' show(s) within 60 days cover ' || category END,
   CASE WHEN density = 'sparse' THEN 'Only ' || distributors || ' distributor(s) cover ' || category || ' in ' || country END) AS signals
FROM (SELECT t.country, t.category, t.tier, base, lag_months, leads_trade, confidence, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, brokered_score, density, distributors,
  CASE WHEN leads_trade AND confidence = 'high' THEN 25 WHEN leads_trade AND confidence = 'medium' THEN 15 WHEN leads_trade THEN 8
   WHEN NOT leads_trade AND confidence <> 'low' THEN 5 ELSE 0 END AS bonus
 FROM (SELECT country, category, tier FROM v_trends) t LEFT JOIN v_tier_base USING (tier) LEFT JOIN v_lead_lag l USING (country, category)
 LEFT JOIN (SELECT category, count(*) FILTER (WHERE urgency = 'high') AS high, count(*) FILTER (WHERE urgency = 'medium') AS medium FROM v_targets GROUP BY 1) s USING (category)
 LEFT JOIN v_coverage USING (country, category))""")


def _lead_lag(x: Inputs) -> DataFrame:
    return retail.lead_lag(retail.order_months(views.lines(x.t)), views.monthly(x.cube))


def _targets(t: Tables) -> DataFrame:
    return retail.show_targets(views.shows(t), views.exhibitors(t), dims.show_keywords(t.spark))


def _coverage(x: Inputs) -> DataFrame:
    growth = trade.growth(trade.annual_series(x.annual.filter("flow = 'us_to_eu'")))
    corridors = growth.select(F.col("partner").alias("country"), "category", "yoy_growth_pct")
    return retail.coverage_density(corridors, x.distributors, x.dist_categories, dims.show_keywords(x.t.spark))


@query("lead_lag", "SELECT * FROM v_lead_lag")
def lead_lag(t: Tables) -> DataFrame:
    return _lead_lag(Inputs(t))


@query("show_targets", "SELECT * FROM v_targets")
def show_targets(t: Tables) -> DataFrame:
    return _targets(t)


@query("coverage_density", "SELECT * FROM v_coverage")
def coverage_density(t: Tables) -> DataFrame:
    return _coverage(Inputs(t))


@query("correlation_score", "SELECT * FROM v_correlation")
def correlation_score(t: Tables) -> DataFrame:
    x = Inputs(t)
    return retail.correlation_score(x.trends, _lead_lag(x), _targets(t), _coverage(x))


# ---- gap, composite, brand fit ------------------------------------------------------------------

register("v_density", """
SELECT country, category, count(DISTINCT brand) AS density FROM v_distributors JOIN v_dist_cat USING (suppkey) JOIN v_dist_brand USING (suppkey) GROUP BY 1, 2""")
register("v_reliance", f"""
SELECT country, category, {R("coalesce(p, f, 0.30)", 6)} AS reliance, CASE WHEN p IS NOT NULL THEN 'primary' WHEN f IS NOT NULL THEN 'fallback' ELSE 'default' END AS source
FROM (SELECT country, category FROM v_active) LEFT JOIN (
 SELECT country, category, max(least(1, coalesce(us, 0) / world)) FILTER (WHERE year = 2000 AND world > 0) AS p,
  max(least(1, coalesce(us, 0) / world)) FILTER (WHERE year = 1999 AND world > 0) AS f FROM v_share GROUP BY 1, 2) USING (country, category)""")
register("v_gap", f"""
SELECT country, category, {R("demand", 6)} AS demand_signal, reliance, density, dp AS demand_pct, ip AS import_pct, np AS density_pct,
  {R("100 * (0.40 * dp + 0.35 * ip + 0.25 * (1 - np))", 1)} AS gap_score
FROM (SELECT *, CASE WHEN n <= 1 THEN 0.5 ELSE percent_rank() OVER (ORDER BY demand) END AS dp, CASE WHEN n <= 1 THEN 0.5 ELSE percent_rank() OVER (ORDER BY reliance) END AS ip,
  CASE WHEN n <= 1 THEN 0.5 ELSE percent_rank() OVER (ORDER BY density) END AS np
 FROM (SELECT *, {R("0.6 * CASE WHEN gh = gl THEN 0.5 ELSE (growth - gl) / (gh - gl) END + 0.4 * CASE WHEN sh = sl THEN 0.5 ELSE (strength - sl) / (sh - sl) END", 9)} AS demand
  FROM (SELECT *, min(growth) OVER () AS gl, max(growth) OVER () AS gh, min(strength) OVER () AS sl, max(strength) OVER () AS sh, count(*) OVER () AS n
   FROM (SELECT country, category, growth, coalesce(strength, 0) AS strength, coalesce(density, 0) AS density, coalesce(reliance, 0.30) AS reliance
    FROM (SELECT country, category, growth FROM v_active)
    LEFT JOIN v_strength USING (country, category) LEFT JOIN v_density USING (country, category) LEFT JOIN v_reliance USING (country, category)))))""", True)
register("v_margin", """
SELECT category, CASE WHEN hi = lo THEN 0 ELSE (uv - lo) / (hi - lo) END AS margin FROM (SELECT category, uv, min(uv) OVER () AS lo, max(uv) OVER () AS hi
 FROM (SELECT category, max(unit_value) AS uv FROM v_annual WHERE flow = 'us_to_eu' GROUP BY 1) WHERE uv IS NOT NULL)""")
register("v_scores", f"""
SELECT country, category, {R("cs")} AS category_score, {R("bs")} AS brand_score, {R("ns")} AS ni_score, {R("0.4 * cs + 0.35 * bs + 0.25 * ns")} AS composite_score,
  CAST(vat > 0 AS INTEGER) + CAST(dist > 0 AS INTEGER) AS signal_count, {R("ec")} AS entry_confidence
FROM (SELECT *, {CL("100 * (0.30 * demand + 0.25 * margin + 0.25 * reg + 0.20 * lg)", 0, 100)} AS cs,
  {CL("100 * (0.375 * pull + 0.3125 * ec + 0.3125 * lg)", 0, 100)} AS bs, {CL("100 * (0.4 * vat + 0.3 * dist)", 0, 100)} AS ns
 FROM (SELECT t.country, t.category, coalesce(vat, 0) AS vat, coalesce(dist, 0) AS dist, (coalesce(vat, 0) + coalesce(dist, 0)) / 3.0 AS lg,
   coalesce(confidence, 0)::DOUBLE AS ec, coalesce(margin, 0) AS margin, (1 - coalesce(complexity, 0.5))::DOUBLE AS reg,
   coalesce(demand_pct, CASE WHEN n > 1 THEN CASE WHEN hi = lo THEN 0.5 ELSE (growth - lo) / (hi - lo) END ELSE 0 END) AS demand,
   coalesce(gap_score / 100.0, least(1, greatest(0, growth))) AS pull
  FROM (SELECT country, category, growth, min(growth) OVER () AS lo, max(growth) OVER () AS hi, count(*) OVER () AS n FROM v_active) t
  LEFT JOIN v_gap USING (country, category) LEFT JOIN v_margin USING (category) LEFT JOIN v_corr_dims USING (country, category)
  LEFT JOIN (SELECT country, category, confidence FROM v_entry) USING (country, category) LEFT JOIN v_complexity USING (category)))""", True)
register("v_brand_match", """
SELECT brand, s.category, max(CASE WHEN lower(b.category) = alias THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END) AS match
FROM v_brand_cat b JOIN v_synonyms s ON contains(lower(b.category), alias) OR contains(alias, lower(b.category)) GROUP BY 1, 2""")
register("v_brand_scores", f"""
SELECT brand, country, category, match AS category_match, category_score, {R("fit")} AS brand_score, {R("ni")} AS ni_score,
  {R("0.4 * category_score + 0.35 * fit + 0.25 * ni")} AS composite_score
FROM (SELECT *, {CL("100 * (0.4::DOUBLE * match + 0.3::DOUBLE * rs + 0.3::DOUBLE * store) * mult", 0, 100)} AS fit,
   {CL("100 * (0.4::DOUBLE * (coalesce(vat, 0) + coalesce(dist, 0)) / 3.0 + 0.3::DOUBLE * solo + 0.3::DOUBLE * sf)", 0, 100)} AS ni
 FROM (SELECT b.brand, s.country, s.category, match, category_score, vat, dist,
   (CASE WHEN revenue IS NULL THEN 0.5 WHEN revenue < 1e6 THEN 0.3 WHEN revenue < 1e7 THEN 0.7 WHEN revenue < 1e8 THEN 1.0 ELSE 0.5 END)::DOUBLE AS rs,
   (CASE WHEN revenue IS NULL THEN 0.5 WHEN revenue < 1e6 THEN 0.4 WHEN revenue < 1e7 THEN 0.8 WHEN revenue < 1e8 THEN 1.0 ELSE 0.5 END)::DOUBLE AS sf,
   (CASE WHEN has_store THEN 1 ELSE 0 END)::DOUBLE AS store, (CASE WHEN eu_presence THEN 0.6 ELSE 1.0 END)::DOUBLE AS mult, (CASE WHEN eu_presence THEN 0.3 ELSE 1.0 END)::DOUBLE AS solo
  FROM v_brands b JOIN v_brand_match m USING (brand) JOIN v_scores s ON s.category = m.category LEFT JOIN v_corr_dims d ON d.category = s.category AND d.country = s.country))""", True)


@query("import_reliance", "SELECT * FROM v_reliance")
def import_reliance(t: Tables) -> DataFrame:
    x = Inputs(t)
    return scores.import_reliance(x.active.select("country", "category"), views.share(x.cube))


@query("gap_scores", "SELECT * FROM v_gap")
def gap_scores(t: Tables) -> DataFrame:
    return Inputs(t, "market", "supply", "distributors").gap


@query("top_gaps", "SELECT country, category, gap_score FROM v_gap ORDER BY gap_score DESC, country, category LIMIT 20")
def top_gaps(t: Tables) -> DataFrame:
    return trade.top_rows(Inputs(t).gap.select("country", "category", "gap_score"), "gap_score", ["country", "category"], 20)


@query("gap_summary", f"""
SELECT count(*) AS corridors, count(*) FILTER (WHERE gap_score >= 80) AS above_80, {R("avg(CAST(round(gap_score * 10) AS BIGINT)) / 10.0", 0)} AS mean_score,
 arg_min(category || ' x ' || country, (-gap_score, country, category)) AS top_gap, max(gap_score) AS top_score FROM v_gap""")
def gap_summary(t: Tables) -> DataFrame:
    return scores.gap_summary(Inputs(t, "market", "supply", "distributors").gap)


@query("composite_scores", "SELECT * FROM v_scores")
def composite_scores(t: Tables) -> DataFrame:
    return Inputs(t, "market", "supply", "distributors").corridor_scores


@query("score_summary", f"""
SELECT count(*) AS corridors, count(*) FILTER (WHERE composite_score >= 80) AS above_80, count(*) FILTER (WHERE composite_score >= 70) AS above_70,
 {R("avg(CAST(round(composite_score * 100) AS BIGINT)) / 100.0")} AS mean_score FROM v_scores""")
def score_summary(t: Tables) -> DataFrame:
    s = F.col("composite_score")
    return Inputs(t, "market", "supply", "distributors").corridor_scores.agg(
        F.count("*").alias("corridors"),
        F.count_if(s >= 80).alias("above_80"),
        F.count_if(s >= 70).alias("above_70"),
        half_up(F.avg(F.round(s * 100).cast("bigint")) / 100.0).alias("mean_score"),
    )


@query("brand_fit", "SELECT * FROM v_brand_scores")
def brand_fit(t: Tables) -> DataFrame:
    return Inputs(t, "market", "supply", "distributors").brand_fit
