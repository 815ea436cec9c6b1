"""Queries: distributors, leads, rules, insights, shows and reports."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from tradewind.functions import text
from tradewind.functions.numeric import half_up
from tradewind.operators import distributors as dist
from tradewind.operators import leads, reports, retail, scores
from tradewind.plans.oracle_views import register
from tradewind.plans.registry import query
from tradewind.plans.scores import Inputs, R
from tradewind.sources import dims, views
from tradewind.sources.stages import stage
from tradewind.sources.tables import Tables, grows, list_scan, optional


def _rules_sql(column: str, rules: list[tuple[str, list[str]]]) -> str:
    return "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains({column}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in rules
    ) + " END"


register("v_intent", f"""
SELECT suppkey, category, max(strength) AS strength, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM (
 SELECT suppkey, category, 0.3::DOUBLE AS strength, 'directory' AS source FROM v_dist_cat
 UNION ALL SELECT suppkey, {_rules_sql("lower(description)", dims.DESCRIPTION_RULES)}, 0.4, 'directory' FROM v_distributors
 UNION ALL SELECT d.suppkey, c.category, 0.7, 'trade_show' FROM v_distributors d JOIN v_exhibitors e ON lower(e.exhibitor) = lower(d.name) JOIN v_show_cat c USING (show_id)
 UNION ALL SELECT suppkey, category, 0.9, 'linkedin_job' FROM v_dist_cat JOIN v_distributors USING (suppkey) WHERE has_profile AND suppkey % 7 IN (0, 1))
WHERE category IS NOT NULL GROUP BY 1, 2""", True)
register("v_all_scores", """
SELECT CAST(NULL AS VARCHAR) AS brand, country, category, category_score, brand_score, ni_score, composite_score FROM v_scores
UNION ALL SELECT brand, country, category, category_score, brand_score, ni_score, composite_score FROM v_brand_scores""", True)
register("v_dist_score", f"""
SELECT suppkey, country, {R("al", 6)} AS alignment, {R("act", 6)} AS activity, CAST(floor(round(100 * (al * 0.35 + cov * 0.30 + act * 0.25 + contact * 0.10), 6) + 0.5) AS INTEGER) AS score
FROM (SELECT d.suppkey, d.country, coalesce(al, 0) AS al, coalesce(act, 0) AS act,
  (CASE WHEN country IN ('NATION_3', 'NATION_8', 'NATION_13', 'NATION_18', 'NATION_23') THEN 1.0 WHEN region = 'EUROPE' THEN 0.6 ELSE 0.2 END)::DOUBLE AS cov,
  (CASE WHEN has_email THEN 0.4 ELSE 0 END + CASE WHEN has_site THEN 0.3 ELSE 0 END + CASE WHEN has_profile THEN 0.3 ELSE 0 END)::DOUBLE AS contact
 FROM v_distributors d LEFT JOIN (SELECT suppkey, CAST(count(*) FILTER (WHERE category IN (SELECT category FROM v_all_scores WHERE composite_score >= 60)) AS DOUBLE) / count(*) AS al
   FROM v_dist_cat GROUP BY 1) USING (suppkey) LEFT JOIN (SELECT suppkey, avg(strength) AS act FROM v_intent GROUP BY 1) USING (suppkey))""", True)
register("v_profiles", "SELECT brand, string_agg(category, ',' ORDER BY category) AS profile FROM v_brand_cat GROUP BY 1")
register("v_lead_corridor", """
SELECT l.* EXCLUDE (country), l.country AS home,
 CASE WHEN linked AND own_score IS NOT NULL THEN own_score ELSE coalesce(fb_score * 0.7::DOUBLE, 0) END AS comp,
 CASE WHEN linked AND own_score IS NOT NULL THEN own_country ELSE fb_country END AS country, CASE WHEN linked AND own_score IS NOT NULL THEN own_category ELSE fb_category END AS category
FROM v_leads l LEFT JOIN v_brand_targets USING (brand)""")
register("v_lead_prof", "SELECT l.*, coalesce(profile, category, '') AS profile FROM v_lead_corridor l LEFT JOIN v_profiles USING (brand)", True)
register("v_prof_cat", """
SELECT country, profile, len(string_split(profile, ',')) AS n_categories, unnest(string_split(profile, ',')) AS category FROM (SELECT DISTINCT country, profile FROM v_lead_prof WHERE country IS NOT NULL)""", True)
register("v_match", f"""
SELECT country, profile, suppkey, name, {R("ov", 6)} AS category_overlap, {R("mi", 6)} AS max_intent, {R("ms", 6)} AS match_score,
 'category_alignment' || CASE WHEN mi > 0.5 THEN ',intent_signal' ELSE '' END || ',country_match' AS reasons
FROM (SELECT *, round(0.5 * ov + 0.35 * mi + 0.15 * score / 100.0, 9) AS ms FROM (
 SELECT p.country, p.profile, d.suppkey, d.name, count(*)::DOUBLE / any_value(n_categories) AS ov, coalesce(max(strength), 0)::DOUBLE AS mi, any_value(score) AS score
 FROM v_prof_cat p JOIN v_dist_cat c USING (category) JOIN v_distributors d ON d.suppkey = c.suppkey AND d.country = p.country
 LEFT JOIN v_intent i ON i.suppkey = c.suppkey AND i.category = c.category JOIN v_dist_score s ON s.suppkey = c.suppkey GROUP BY 1, 2, 3, 4)) WHERE ms >= 0.30""", True)
register("v_match_counts", "SELECT country, profile, count(*) AS matches, max(match_score) AS best_match FROM v_match GROUP BY 1, 2")
register("v_match_top", """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY country, profile ORDER BY match_score DESC, suppkey) AS INTEGER) AS rank FROM v_match) WHERE rank <= 5""")
register("v_risk", """
SELECT country, category, count(level) AS flags, ['low', 'medium', 'high'][coalesce(max(level), 1)] AS risk FROM (
 SELECT p.country, p.category, CASE WHEN market IN ('EU', p.country) THEN CASE risk WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END END AS level
 FROM (SELECT DISTINCT country, category FROM v_lead_prof WHERE country IS NOT NULL) p LEFT JOIN v_flags f USING (category)) GROUP BY 1, 2""", True)
register("v_brand_targets", """
SELECT brand, o.composite_score AS own_score, o.country AS own_country, o.category AS own_category, f.composite_score AS fb_score, f.country AS fb_country, f.category AS fb_category
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY composite_score DESC, country, category) AS rn FROM v_brand_scores) WHERE rn = 1) o
FULL JOIN (SELECT * FROM (SELECT brand, s.*, row_number() OVER (PARTITION BY brand ORDER BY composite_score DESC, country, category) AS rn FROM v_brand_cat JOIN v_scores s USING (category)) WHERE rn = 1) f USING (brand)""")
register("v_quality", f"""
SELECT lead, company, home, brand, profile, status, exported_on, has_email, CASE WHEN comp > 0 THEN {R("comp")} END AS opportunity_score, country AS best_country, category AS best_category,
 gap_score, tier, coalesce(matches, 0) AS matches, coalesce(risk, 'low') AS risk,
 {R("least(greatest(round(comp * 0.35 + coalesce(gap_score, 0) * 0.22 + coalesce(bonus, 0) * 0.18 + contact * 0.12 + least(coalesce(matches, 0) * 3.0, 15.0) - CASE risk WHEN 'high' THEN 20 WHEN 'medium' THEN 8 ELSE 0 END, 9), 0), 100)")} AS quality
FROM (SELECT x.*, g.gap_score, t.tier, bonus::DOUBLE AS bonus, m.matches, r.risk,
  (CASE WHEN has_email THEN 50 ELSE 0 END + CASE WHEN has_profile THEN 30 ELSE 0 END + CASE WHEN has_site THEN 20 ELSE 0 END)::DOUBLE AS contact
 FROM v_lead_prof x
 LEFT JOIN v_gap g ON g.country = x.country AND g.category = x.category LEFT JOIN v_active t ON t.country = x.country AND t.category = x.category LEFT JOIN v_tier_bonus b ON b.tier = t.tier
 LEFT JOIN v_match_counts m ON m.country = x.country AND m.profile = x.profile LEFT JOIN v_risk r ON r.country = x.country AND r.category = x.category)""", True)
register("v_pitch", f"""
SELECT *, CASE angle WHEN 'distributor_pull' THEN matches || ' distributors in ' || best_country || ' are sourcing this category now.' WHEN 'first_mover' THEN 'The ' || best_category || ' market in ' || best_country || ' is growing rapidly.'
 WHEN 'unmet_demand' THEN 'Retailers in ' || best_country || ' look for ' || best_category || ' (gap score: ' || CAST(floor(coalesce(gap_score, 0) + 0.5) AS BIGINT) || '/100).'
 WHEN 'cost_optimisation' THEN 'Gateway routing cuts the landed cost.' ELSE 'The ' || best_category || ' category in ' || best_country || ' commands higher unit values.' END AS hook
FROM (SELECT q.*, CASE WHEN matches >= 2 THEN 'distributor_pull' WHEN coalesce(gap_score, 0) > 70 AND tier IN ('breakthrough', 'accelerating') THEN 'first_mover'
  WHEN coalesce(gap_score, 0) > 60 THEN 'unmet_demand' WHEN coalesce(s.ms, 0) > 0.7 THEN 'cost_optimisation' ELSE 'margin_expansion' END AS angle
 FROM v_quality q LEFT JOIN (SELECT country, category, avg(strength) AS ms FROM v_routing GROUP BY 1, 2) s ON s.country = q.best_country AND s.category = q.best_category)""", True)
register("v_last_campaign", "SELECT lead, arg_max(c, (c.created_on, c.campaign)) AS last FROM (SELECT lead, v_campaigns AS c FROM v_campaigns) GROUP BY 1")
register("v_export", """
SELECT q.lead, company, q.status, quality, best_country, best_category, l.last.campaign AS last_campaign, l.last.status AS campaign_status,
 strftime(l.last.created_on, '%Y-%m-%d') AS campaign_on, p.stage, p.estimated_value, p.probability_percent, b.briefing
FROM v_quality q LEFT JOIN v_last_campaign l USING (lead) LEFT JOIN v_pipeline p USING (lead) LEFT JOIN v_briefings b USING (lead)
WHERE q.status IN ('replied', 'qualified', 'won') OR (quality >= 75 AND (exported_on IS NULL OR exported_on < DATE '2001-07-25'))""")
register("v_fired", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY metric_value DESC, country, category, brand NULLS FIRST) AS rank FROM (
 SELECT s.*, r.*, CASE metric WHEN 'composite_score' THEN composite_score WHEN 'category_score' THEN category_score ELSE brand_score END AS metric_value FROM v_all_scores s, v_rules r)
 WHERE metric_value > threshold) WHERE rank <= 50""", True)
register("v_day_pairs", "SELECT DISTINCT partner AS country, category FROM v_lines WHERE o_orderdate = TIMESTAMP '2001-08-01'")
register("v_cover", """
SELECT s.country, s.category, coalesce(n, 0) AS distributors, names, coalesce(n, 0) <= 1 AS coverage_gap FROM v_scores s LEFT JOIN (
 SELECT country, category, count(*) AS n, string_agg(name, ', ' ORDER BY name) FILTER (WHERE rn <= 10) AS names FROM (
  SELECT country, category, name, row_number() OVER (PARTITION BY country, category ORDER BY name) AS rn FROM v_dist_cat JOIN v_distributors USING (suppkey)) GROUP BY 1, 2) x
ON x.country = s.country AND x.category = s.category""")
register("v_exhibitor_match", """
SELECT e.show_id, e.suppkey, e.exhibitor, b.brand, s.composite_score AS best_score, s.country AS best_country, s.category AS best_category,
 CASE WHEN b.brand IS NULL THEN 'introduce' WHEN s.composite_score >= 70 THEN 'priority' WHEN NOT eu_presence THEN 'first_entry' WHEN has_store THEN 'store_led' ELSE 'nurture' END AS pitch
FROM v_exhibitors e LEFT JOIN v_brands b ON lower(b.brand) = lower(e.exhibitor) LEFT JOIN (SELECT * FROM (
  SELECT c.show_id, s.*, row_number() OVER (PARTITION BY c.show_id, brand ORDER BY composite_score DESC, country, s.category) AS rn FROM v_show_cat c JOIN v_brand_scores s ON s.category = c.category) WHERE rn = 1) s
ON s.show_id = e.show_id AND s.brand = b.brand""", True)
register("v_top_brands", """
SELECT brand, category, composite_score, country, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY composite_score DESC, brand) AS INTEGER) AS rank FROM (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand, category ORDER BY composite_score DESC, country) AS rn FROM v_brand_scores) WHERE rn = 1)) WHERE rank <= 3""")


class LeadInputs(Inputs):
    """Corridor inputs plus the distributor and profile tables the lead stages share. Lead rows are never staged."""

    @cached_property
    def all_scores(self) -> DataFrame:
        return leads.unify_scores(self.corridor_scores, self.brand_fit)

    @cached_property
    def show_categories(self) -> DataFrame:
        return retail.show_categories(views.shows(self.t), dims.show_keywords(self.t.spark))

    @cached_property
    def intent(self) -> DataFrame:
        audits = dist.audit_rows(self.distributors)
        rows = dist.buying_intent(self.distributors, self.dist_categories, views.exhibitors(self.t), self.show_categories, audits)
        return stage(rows, "buying_intent")

    @cached_property
    def distributor_scores(self) -> DataFrame:
        active = self.all_scores.filter("composite_score >= 60").select("category").distinct()
        return dist.distributor_score(self.distributors, self.dist_categories, active, self.intent)

    @cached_property
    def leads(self) -> DataFrame:
        """Leads with their best corridor and profile."""
        targets = leads.brand_targets(self.brand_fit, self.corridor_scores, self.brand_categories)
        return dist.lead_profiles(leads.resolve_corridor(views.leads(self.t), stage(targets, "brand_targets")), self.brand_categories)

    @cached_property
    def profiles(self) -> DataFrame:
        return dist.profile_categories(self.leads)

    @cached_property
    def matches(self) -> DataFrame:
        rows = dist.match(self.profiles, self.distributors, self.dist_categories, self.intent, self.distributor_scores)
        return stage(rows, "lead_matches")

    @cached_property
    def risks(self) -> DataFrame:
        return dist.regulatory_risk(self.leads, F.broadcast(dims.regulatory_flags(self.t.spark)))

    @cached_property
    def quality(self) -> DataFrame:
        return leads.lead_quality(self.leads, self.gap, self.active, dist.match_counts(self.matches), self.risks)

    @cached_property
    def pitched(self) -> DataFrame:
        strength = self.routing_signals.groupBy("country", "category").agg(F.avg("strength").alias("mean_strength"))
        return leads.pitch_angle(self.quality, strength)

    def day_pairs(self) -> DataFrame:
        day = views.lines(self.t).filter(F.col("o_orderdate") == F.lit(dims.AS_OF))
        return day.select(F.col("partner").alias("country"), "category").distinct()

    def fired(self) -> DataFrame:
        return leads.fire_rules(self.all_scores, dims.trigger_rules(self.t.spark))


# Independent inputs of the score chain, staged side by side.
SCORING = ("market", "supply", "distributors")


@query("distributor_score", "SELECT * FROM v_dist_score")
def distributor_score(t: Tables) -> DataFrame:
    return LeadInputs(t, *SCORING).distributor_scores


@query("buyer_intent", "SELECT * FROM v_intent")
def buyer_intent(t: Tables) -> DataFrame:
    return LeadInputs(t).intent


@query("lead_match", "SELECT * FROM v_match")
def lead_match(t: Tables) -> DataFrame:
    return LeadInputs(t, *SCORING).matches


@query("lead_match_count", """
SELECT l.lead, l.home, l.country, profile, coalesce(matches, 0) AS matches, best_match FROM v_lead_prof l LEFT JOIN v_match_counts USING (country, profile)
WHERE status IN ('new', 'reviewed', 'approved')""")
def lead_match_count(t: Tables) -> DataFrame:
    x = LeadInputs(t, *SCORING)
    rows = x.leads.filter(F.col("status").isin("new", "reviewed", "approved"))
    counts = dist.match_counts(x.matches)
    return rows.join(counts, dist.PROFILE, "left").select(
        "lead", "home", "country", "profile", F.coalesce("matches", F.lit(0)).alias("matches"), "best_match"
    )


@query("match_list", """
SELECT m.country, m.profile, m.suppkey, m.match_score, d.region, coalesce(n, 0) AS leads FROM v_match m JOIN v_distributors d USING (suppkey)
LEFT JOIN (SELECT country, profile, count(*) AS n FROM v_lead_prof WHERE status = 'qualified' GROUP BY 1, 2) l ON l.country = m.country AND l.profile = m.profile""")
def match_list(t: Tables) -> DataFrame:
    x = LeadInputs(t, *SCORING)
    waiting = x.leads.filter("status = 'qualified'").groupBy(*dist.PROFILE).agg(F.count("*").alias("n"))
    return (
        x.matches.join(grows(x.distributors.select("suppkey", "region")), "suppkey")
        .join(waiting, dist.PROFILE, "left")
        .select(*dist.PROFILE, "suppkey", "match_score", "region", F.coalesce("n", F.lit(0)).alias("leads"))
    )


@query("match_top5", """
SELECT l.lead, m.rank, m.suppkey, m.name, m.match_score, i.strength AS best_strength FROM v_lead_prof l JOIN v_match_top m USING (country, profile)
LEFT JOIN (SELECT suppkey, max(strength) AS strength FROM v_intent GROUP BY 1) i ON i.suppkey = m.suppkey WHERE l.status = 'approved'""")
def match_top5(t: Tables) -> DataFrame:
    x = LeadInputs(t, *SCORING)
    best = x.intent.groupBy("suppkey").agg(F.max("strength").alias("best_strength"))
    top = dist.match_top(x.matches).join(best, "suppkey", "left")
    return x.leads.filter("status = 'approved'").join(top, dist.PROFILE).select("lead", "rank", "suppkey", "name", "match_score", "best_strength")


@query("risk_level", """
SELECT lead, country AS best_country, category AS best_category, coalesce(flags, 0) AS flags, coalesce(r.risk, 'low') AS risk
FROM v_lead_prof l LEFT JOIN v_risk r USING (country, category)""")
def risk_level(t: Tables) -> DataFrame:
    x = LeadInputs(t, *SCORING)
    return x.leads.join(x.risks, leads.CORRIDOR, "left").select(
        "lead", F.col("country").alias("best_country"), F.col("category").alias("best_category"),
        F.coalesce("flags", F.lit(0)).alias("flags"), F.coalesce("risk", F.lit("low")).alias("risk")
    )


def _subcategory_sql(column: str) -> str:
    tokens = f"len(string_split(lower({column}), ' '))"
    cases = []
    for label, words in dims.SUBCATEGORY_KEYWORDS.items():
        hits = " + ".join(f"CAST(contains(lower({column}), '{w}') AS INTEGER)" for w in words)
        cases.append((label, f"CAST({hits} AS DOUBLE) / {tokens}"))
    best = "greatest(" + ", ".join(d for _, d in cases) + ")"
    return f"CASE WHEN {best} < 0.08 THEN NULL " + " ".join(f"WHEN {d} = {best} THEN '{label}'" for label, d in cases) + " END"


register("v_part_label", f"SELECT p_name, label, (SELECT any_value(parent) FROM v_subcategory s WHERE s.label = x.label) AS parent FROM (SELECT DISTINCT p_name, {_subcategory_sql('p_name')} AS label FROM part) x WHERE label IS NOT NULL")
register("v_portfolio", "SELECT suppkey, label, parent, count(*) AS n FROM (SELECT DISTINCT l_suppkey AS suppkey, p_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey) JOIN v_part_label USING (p_name) GROUP BY 1, 2, 3")
register("v_brand_label", """
SELECT brand, label, parent FROM (SELECT p_brand AS brand, label, parent, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, label) AS rn FROM part JOIN v_part_label USING (p_name) GROUP BY 1, 2, 3) WHERE rn = 1""")
register("v_proximity", f"""
SELECT country, profile, brand, suppkey, CASE WHEN exact > 0 THEN 'exact' WHEN adjacent > 0 THEN 'adjacent' END AS proximity, CAST(exact + adjacent AS BIGINT) AS competitors,
 {R("least(match_score * CASE WHEN exact > 0 THEN 0.85::DOUBLE WHEN adjacent > 0 THEN 1.05::DOUBLE ELSE 1 END, 1)", 6)} AS adjusted_score
FROM (SELECT m.country, m.profile, b.brand, m.suppkey, match_score, sum(CASE WHEN p.label = b.label THEN n ELSE 0 END) AS exact,
  sum(CASE WHEN p.label <> b.label AND p.parent = b.parent THEN n ELSE 0 END) AS adjacent
 FROM v_match m JOIN (SELECT DISTINCT brand, profile, label, parent FROM v_brand_label JOIN v_lead_prof USING (brand)) b USING (profile) JOIN v_portfolio p ON p.suppkey = m.suppkey GROUP BY 1, 2, 3, 4, 5)""")


def part_labels(t: Tables) -> DataFrame:
    """(p_partkey, p_brand, label, parent) of the parts with a label; each different name is labelled once.

    The labels are staged unfiltered: a filter on them would be moved below ``distinct`` and label every part.
    """
    names = t.read("part").select("p_name").distinct().withColumn("s", text.subcategory(F.col("p_name")))
    labels = stage(names.select("p_name", "s.label", "s.parent"), "name_labels").filter("label IS NOT NULL")
    return t.read("part").select("p_name", "p_partkey", "p_brand").join(grows(labels), "p_name").drop("p_name")


@query("proximity", "SELECT * FROM v_proximity")
def proximity(t: Tables) -> DataFrame:
    x = LeadInputs(t, *SCORING)
    labelled = part_labels(t)
    pairs = t.read("lineitem").select(F.col("l_suppkey").alias("suppkey"), F.col("l_partkey").alias("p_partkey")).distinct()
    portfolio = pairs.join(grows(labelled), "p_partkey").groupBy("suppkey", "label", "parent").agg(F.count("*").alias("n"))
    counted = labelled.groupBy(F.col("p_brand").alias("brand"), "label", "parent").agg(F.count("*").alias("n"))
    sought = leads.best_by(counted, ["brand"], "n", ["label"], ["label", "parent"])
    profiles = x.leads.select("brand", "profile").distinct()
    return dist.proximity(x.matches, portfolio, sought.join(profiles, "brand"))


@query("lead_quality", "SELECT * EXCLUDE (exported_on) FROM v_quality")
def lead_quality(t: Tables) -> DataFrame:
    return LeadInputs(t, *SCORING).quality.drop("exported_on")


@query("pitch_angle", "SELECT lead, quality, best_country, best_category, angle, hook FROM v_pitch")
def pitch_angle(t: Tables) -> DataFrame:
    return LeadInputs(t, *SCORING).pitched.select("lead", "quality", "best_country", "best_category", "angle", "hook")


@query("outreach_pick", """
SELECT lead, company, quality, angle, rank, CAST(ceil(quality / 34.0) AS INTEGER) AS priority FROM (SELECT *, CAST(row_number() OVER (ORDER BY quality DESC, lead) AS INTEGER) AS rank FROM v_pitch
 WHERE status = 'approved' AND quality >= 60 AND has_email) LEFT JOIN v_last_campaign USING (lead)
WHERE rank <= 50 - (SELECT count(*) FROM v_campaigns WHERE status = 'sent' AND created_on >= DATE '2001-08-01') AND (last IS NULL OR last.created_on <= DATE '2001-07-29')""")
def outreach_pick(t: Tables) -> DataFrame:
    return leads.outreach_pick(LeadInputs(t, *SCORING).pitched, views.campaigns(t), min_quality=60.0)


@query("crm_export", "SELECT * FROM v_export")
def crm_export(t: Tables) -> DataFrame:
    return leads.crm_selection(LeadInputs(t, *SCORING).quality, views.campaigns(t), views.pipeline(t), views.briefings(t))


@query("stage_rollup", """
SELECT coalesce(stage, 'all') AS stage, count(*) AS leads, CAST(sum(cents) AS DOUBLE) / 100 AS value,
 floor(CAST(count(*) FILTER (WHERE stage = 'won') AS DOUBLE) / nullif(count(*) FILTER (WHERE stage IN ('won', 'lost')), 0) * 100 * 100 + 0.5) / 100 AS win_rate_pct
FROM (SELECT last.stage AS stage, last.cents AS cents FROM v_last_campaign) GROUP BY ROLLUP (stage)""")
def stage_rollup(t: Tables) -> DataFrame:
    return leads.stage_rollup(views.campaigns(t))


@query("rules_fire", "SELECT rule, action, brand, country, category, metric_value, CAST(rank AS INTEGER) AS rank FROM v_fired")
def rules_fire(t: Tables) -> DataFrame:
    return LeadInputs(t, *SCORING).fired().select("rule", "action", "brand", "country", "category", "metric_value", "rank")


@query("rule_alerts", """
SELECT title, rule, metric_value, composite_score FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY rule, rank) AS rn FROM (
 SELECT *, 'High-score alert: ' || category || ' x ' || country AS title FROM v_fired WHERE action = 'alert_insight'))
WHERE rn = 1 AND title NOT IN (SELECT 'High-score alert: ' || category || ' x ' || country FROM v_day_pairs)""")
def rule_alerts(t: Tables) -> DataFrame:
    x = LeadInputs(t, *SCORING)
    recent = x.day_pairs().select(leads.alert_title("High-score alert").alias("title"))
    return leads.alerts(x.fired(), recent)


@query("rule_approvals", """
SELECT lead, brand, CASE WHEN linked AND status IN ('new', 'reviewed') AND brand IN (SELECT brand FROM v_fired WHERE action = 'approve_lead' AND brand IS NOT NULL) THEN 'approved' ELSE status END AS status FROM v_leads""")
def rule_approvals(t: Tables) -> DataFrame:
    return leads.approvals(LeadInputs(t, *SCORING).fired(), views.leads(t)).select("lead", "brand", "status")


@query("top_brands", "SELECT * FROM v_top_brands")
def top_brands(t: Tables) -> DataFrame:
    return leads.top_brands(LeadInputs(t, *SCORING).brand_fit)


@query("scored_brands", """
SELECT brand, b.revenue AS revenue, s.country, s.category, s.composite_score FROM (SELECT brand, round(revenue, 2) AS revenue FROM v_brands) b JOIN v_brand_scores s USING (brand) WHERE s.composite_score >= 60""")
def scored_brands(t: Tables) -> DataFrame:
    x = LeadInputs(t, *SCORING)
    b, s = views.brands(x.cells).select("brand", F.round("revenue", 2).alias("revenue")), x.brand_fit
    return b.join(s, (b.brand == s.brand) & (s.composite_score >= 60)).select(b.brand, "revenue", "country", "category", "composite_score")


@query("brand_scores_list", "SELECT brand, country, category, composite_score FROM v_all_scores WHERE brand IS NOT NULL AND composite_score >= 45 AND country = 'NATION_3' ORDER BY composite_score DESC, brand, category LIMIT 50")
def brand_scores_list(t: Tables) -> DataFrame:
    filters = {
        "grain": F.col("brand").isNotNull(),
        "min_composite": optional("composite_score", ">=", 45.0),
        "country": optional("country", "=", "NATION_3"),
        "category": optional("category", "=", None),
    }
    order = [F.desc_nulls_first("composite_score"), F.asc("brand"), F.asc("category")]
    return list_scan(LeadInputs(t, *SCORING).all_scores, filters, order, 50).select("brand", "country", "category", "composite_score")


@query("exhibitor_match", "SELECT * FROM v_exhibitor_match")
def exhibitor_match(t: Tables) -> DataFrame:
    x = LeadInputs(t, *SCORING)
    return leads.exhibitor_match(views.exhibitors(t), views.brands(x.cells), x.brand_fit, x.show_categories)


@query("show_summary", f"""
SELECT s.show_id, s.show_name, count(e.suppkey) AS exhibitors, count(b.brand) AS matched, {R("CASE WHEN count(e.suppkey) > 0 THEN 100.0 * count(b.brand) / count(e.suppkey) ELSE 0 END::DOUBLE")} AS match_rate_pct
FROM v_shows s LEFT JOIN v_exhibitors e USING (show_id) LEFT JOIN (SELECT DISTINCT p_brand AS brand FROM part) b ON lower(b.brand) = lower(e.exhibitor) GROUP BY 1, 2""")
def show_summary(t: Tables) -> DataFrame:
    names = t.read("part").select(F.lower("p_brand").alias("lower_name")).distinct()
    booths = views.exhibitors(t).withColumn("lower_name", F.lower("exhibitor"))
    flagged = booths.join(names.withColumn("known", F.lit(1)), "lower_name", "left").groupBy("show_id").agg(
        F.count("*").alias("e"), F.count("known").alias("m")
    )
    e, m = F.coalesce("e", F.lit(0)), F.coalesce("m", F.lit(0))
    return views.shows(t).join(flagged, "show_id", "left").select(
        "show_id", "show_name", e.alias("exhibitors"), m.alias("matched"), half_up(F.when(e > 0, m * 100.0 / e).otherwise(0.0)).alias("match_rate_pct")
    )


@query("match_rate", f"""
SELECT *, {R("CASE WHEN exhibitors > 0 THEN matched / exhibitors ELSE 0 END::DOUBLE", 6)} AS match_rate FROM (
 SELECT count(DISTINCT s.show_id) AS shows, count(e.suppkey) AS exhibitors, count(b.brand) AS matched FROM v_shows s
 LEFT JOIN v_exhibitors e USING (show_id) LEFT JOIN (SELECT DISTINCT p_brand AS brand FROM part) b ON lower(b.brand) = lower(e.exhibitor)
 WHERE s.start_on >= DATE '2001-08-01' AND s.show_id IN (SELECT show_id FROM v_show_cat))""")
def match_rate(t: Tables) -> DataFrame:
    names = t.read("part").select(F.lower("p_brand").alias("lower_name"), F.col("p_brand").alias("brand")).distinct()
    booths = views.exhibitors(t).withColumn("lower_name", F.lower("exhibitor")).join(names, "lower_name", "left")
    categories = retail.show_categories(views.shows(t), dims.show_keywords(t.spark))
    return leads.match_rate(views.shows(t), categories, booths)


@query("coverage_names", "SELECT * FROM v_cover")
def coverage_names(t: Tables) -> DataFrame:
    x = LeadInputs(t)
    return dist.coverage(x.dist_categories, x.distributors, x.active.select("country", "category"))


@query("playbook", """
SELECT s.show_id, s.show_name, n.categories, c.corridors, c.gaps, coalesce(x.exhibitors, 0) AS exhibitors, coalesce(x.matched, 0) AS matched, p.pipeline_brands
FROM v_shows s JOIN (SELECT show_id, string_agg(category, ',' ORDER BY category) AS categories FROM v_show_cat GROUP BY 1) n USING (show_id)
LEFT JOIN (SELECT show_id, string_agg(category || '/' || country, '; ' ORDER BY rank) AS corridors, count(*) FILTER (WHERE coverage_gap) AS gaps FROM (
  SELECT k.show_id, v.*, o.coverage_gap, row_number() OVER (PARTITION BY k.show_id ORDER BY composite_score DESC, v.country, v.category) AS rank
  FROM v_show_cat k JOIN v_scores v ON v.category = k.category LEFT JOIN v_cover o ON o.country = v.country AND o.category = v.category) GROUP BY 1) c USING (show_id)
LEFT JOIN (SELECT show_id, count(*) AS exhibitors, count(brand) AS matched FROM v_exhibitor_match GROUP BY 1) x USING (show_id)
LEFT JOIN (SELECT show_id, string_agg(DISTINCT brand, ',' ORDER BY brand) AS pipeline_brands FROM v_show_cat k JOIN v_top_brands b ON b.category = k.category GROUP BY 1) p USING (show_id)
WHERE s.start_on >= DATE '2001-08-01'""")
def playbook(t: Tables) -> DataFrame:
    x = LeadInputs(t, *SCORING)
    matched = leads.exhibitor_match(views.exhibitors(t), views.brands(x.cells), x.brand_fit, x.show_categories)
    cover = dist.coverage(x.dist_categories, x.distributors, x.active.select("country", "category"))
    return leads.playbook(views.shows(t), x.show_categories, matched, x.corridor_scores, cover, leads.top_brands(x.brand_fit))


@query("weekly_report", f"""
SELECT * FROM (SELECT 'top_corridor' AS section, CAST(row_number() OVER (ORDER BY composite_score DESC, country, category) AS INTEGER) AS position,
  category || ' x ' || country || ': composite ' || printf('%.1f', {R("composite_score", 1)}) AS line FROM v_scores) WHERE position <= 5
UNION ALL SELECT * FROM (SELECT 'breakthrough', CAST(row_number() OVER (ORDER BY growth DESC, country, category) AS INTEGER) AS position, category || ' x ' || country || ' (+' || printf('%.1f', {R("growth * 100", 1)}) || '%)' FROM v_active WHERE tier = 'breakthrough') WHERE position <= 5
UNION ALL SELECT 'leads', 1, 'Total leads: ' || count(*) FROM v_leads UNION ALL SELECT 'qualified', 1, 'Qualified leads: ' || count(*) FROM v_leads WHERE status = 'qualified'
UNION ALL SELECT 'title', 1, 'Weekly digest: week ' || weekofyear(DATE '2001-08-01') || ', 2001'""")
def weekly_report(t: Tables) -> DataFrame:
    x = LeadInputs(t, *SCORING)


    return reports.weekly(x.corridor_scores, x.active, views.leads(t))


@query("monthly_report", f"""
SELECT * FROM (SELECT 'top_corridor' AS section, CAST(row_number() OVER (ORDER BY composite_score DESC, country, category) AS INTEGER) AS position,
  category || ' x ' || country || ': composite ' || printf('%.1f', {R("composite_score", 1)}) || ' (category ' || printf('%.1f', {R("category_score", 1)}) || ', routing ' || printf('%.1f', {R("ni_score", 1)}) || ')' AS line FROM v_scores) WHERE position <= 10
UNION ALL SELECT 'leads', 1, 'Total leads: ' || count(*) FROM v_leads UNION ALL SELECT 'qualified', 1, 'Qualified leads: ' || count(*) FROM v_leads WHERE status = 'qualified'
UNION ALL SELECT 'trends', 1, 'Trends detected: ' || count(*) FROM v_active UNION ALL SELECT 'title', 1, 'Monthly market brief: August 2001'""")
def monthly_report(t: Tables) -> DataFrame:
    x = LeadInputs(t, *SCORING)
    return reports.monthly(x.corridor_scores, x.active, views.leads(t))


@query("report_union", """
SELECT kind, title, stamp FROM (SELECT 'alert' AS kind, 'Opportunity alert: ' || category || ' x ' || country AS title, CAST(last_ym AS BIGINT) AS stamp FROM v_trends WHERE tier = 'breakthrough'
 UNION ALL SELECT 'watch', 'Watch: ' || category || ' x ' || country, last_ym FROM v_trends WHERE tier = 'watch') ORDER BY stamp DESC, title""")
def report_union(t: Tables) -> DataFrame:
    trends = views.trends(views.corridor_cube(t))
    row = lambda tier, kind, prefix: trends.filter(F.col("tier") == tier).select(
        F.lit(kind).alias("kind"), leads.alert_title(prefix).alias("title"), F.col("last_ym").cast("bigint").alias("stamp")
    )
    both = row("breakthrough", "alert", "Opportunity alert").unionByName(row("watch", "watch", "Watch"))
    return both.orderBy(F.desc("stamp"), "title")


@query("lead_discovery", """
WITH src AS (SELECT lower(company) AS key, company, 'brand_discovery' AS source, 0 AS rank FROM v_leads WHERE NOT linked
 UNION ALL SELECT lower(brand), brand, 'brand_scored', 1 FROM v_brand_scores WHERE composite_score >= 60
 UNION ALL SELECT lower(exhibitor), exhibitor, 'exhibitor', 2 FROM v_exhibitors)
SELECT key, company, source FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, company) AS rn FROM src) WHERE rn = 1
 AND key NOT IN (SELECT lower(company) FROM v_leads WHERE linked)""")
def lead_discovery(t: Tables) -> DataFrame:
    x = LeadInputs(t, *SCORING)
    known = views.leads(t)
    row = lambda df, name, source: df.select(F.lower(name).alias("key"), F.col(name).alias("company"), F.lit(source).alias("source"))
    sources = [
        row(known.filter(~F.col("linked")), "company", "brand_discovery"),
        row(x.brand_fit.filter("composite_score >= 60"), "brand", "brand_scored"),
        row(views.exhibitors(t), "exhibitor", "exhibitor"),
    ]
    return leads.discovered_leads(sources, known.filter("linked").select(F.lower("company").alias("key")))
