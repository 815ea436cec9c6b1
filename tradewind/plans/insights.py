"""Queries: insights with their texts. The oracle fills the same templates with SQL and computes every value anew."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, functions as F

from tradewind.operators import insights, leads
from tradewind.plans.leads import SCORING, LeadInputs
from tradewind.plans.oracle_views import register
from tradewind.plans.registry import query
from tradewind.plans.scores import R
from tradewind.sources import dims, views
from tradewind.sources.tables import Tables, trailing

THRESHOLD = 50.0  # of the scores in the given tables, which stay below 60


def _fill(template: str, slots: dict[str, str]) -> str:
    parts = []
    for text, slot, _, _ in Formatter().parse(template):
        if text:
            parts.append("'" + text.replace("'", "''") + "'")
        if slot:
            parts.append(f"CAST({slots[slot]} AS VARCHAR)")
    return " || ".join(parts)


def _body(kind: str, evidence: str, slots: dict[str, str]) -> str:
    lines = [insights.NARRATIVES[kind], "Evidence:", *insights.EVIDENCE[evidence]]
    return "concat_ws(chr(10), " + ", ".join(_fill(line, slots) for line in lines) + ")"


ONE = lambda x: f"printf('%.1f', {R(x, 1)})"
PCT = lambda x: f"CAST(floor({x} * 100 + 0.5) AS BIGINT)"

_CORRIDOR = {
    "category": "category", "country": "country", "score": ONE("composite_score"), "category_score": ONE("category_score"),
    "brand_score": ONE("brand_score"), "ni_score": ONE("ni_score"), "tier_name": "tier", "gap": ONE("gap_score"), "tier": "coalesce(', tier ' || tier, '')",
    "demand": PCT("demand_pct"), "entry": f"CASE WHEN entry_confidence > 0 THEN {PCT('entry_confidence')} END",
}
_BRAND = _CORRIDOR | {
    "brand": "brand", "match": PCT("category_match"), "store": "CASE WHEN has_store THEN 'yes' ELSE 'no' END", "present": "CASE WHEN eu_presence THEN 'yes' ELSE 'no' END",
}
_SHOW = {
    "show": "show_name", "place": "country", "start": "strftime(start_on, '%Y-%m-%d')", "n": "n", "corridors": "corridors",
    "categories": "coalesce(categories, 'general goods')", "exhibitors": "names", "brands": "brands",
}
_DIGEST = {k: k for k in ("alerts", "briefs", "playbooks", "corridors", "shows", "trends")} | {
    "top": "coalesce(top, 'none')", "brands": "above", "week": "weekofyear(DATE '2001-08-01')", "year": "2001",
}


def _select(kind: str, evidence: str, slots: dict[str, str], score: str, source: str) -> str:
    return f"SELECT '{kind}' AS kind, {_fill(insights.TITLES[kind], slots)} AS title, {score} AS score, {_body(kind, evidence, slots)} AS body FROM {source}"


register("v_written_titles", """
SELECT title, created_on FROM (SELECT partner AS country, category, CAST(min(o_orderdate) AS DATE) AS created_on FROM v_lines
 WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 14 DAYS AND o_orderdate <= TIMESTAMP '2001-08-01' GROUP BY 1, 2),
 unnest(['Opportunity alert: ' || category || ' x ' || country, 'Market brief: ' || category || ' in ' || country]) AS u(title)""", True)
register("v_corridor_facts", "SELECT s.*, gap_score, demand_pct, tier FROM v_scores s LEFT JOIN v_gap USING (country, category) LEFT JOIN v_active USING (country, category)")
_scored = f"|| ' (' || {ONE('composite_score')} || ')'"
_down = "ORDER BY composite_score DESC, country, category"
register("v_show_text", f"""
SELECT s.*, categories, corridors, score, n, names, brands FROM v_shows s
LEFT JOIN (SELECT show_id, string_agg(DISTINCT category, '; ' ORDER BY category) AS categories FROM v_show_cat GROUP BY 1) USING (show_id)
LEFT JOIN (SELECT show_id, string_agg(line, '; ' ORDER BY rn) FILTER (WHERE rn <= 5) AS corridors, max(composite_score) AS score FROM (
 SELECT k.show_id, composite_score, v.category || ' x ' || country {_scored} AS line, row_number() OVER (PARTITION BY k.show_id ORDER BY composite_score DESC, country, v.category) AS rn
 FROM v_show_cat k JOIN v_scores v ON v.category = k.category) GROUP BY 1) USING (show_id)
LEFT JOIN (SELECT show_id, count(*) AS n, string_agg(exhibitor, '; ' ORDER BY rn) FILTER (WHERE rn <= 12) AS names FROM (
 SELECT *, row_number() OVER (PARTITION BY show_id ORDER BY exhibitor, suppkey) AS rn FROM v_exhibitors) GROUP BY 1) USING (show_id)
LEFT JOIN (SELECT show_id, string_agg(brand {_scored}, '; ' ORDER BY rn) AS brands FROM (SELECT *, row_number() OVER (PARTITION BY show_id ORDER BY composite_score DESC, brand) AS rn FROM (
 SELECT show_id, brand, max(composite_score) AS composite_score FROM v_show_cat k JOIN v_top_brands b ON b.category = k.category GROUP BY 1, 2)) WHERE rn <= 10 GROUP BY 1) USING (show_id)
WHERE start_on >= DATE '2001-08-01'""")
register("v_fresh_insights", f"""
SELECT * FROM ({_select("alert", "corridor", _CORRIDOR, "composite_score", f"v_corridor_facts WHERE composite_score >= {THRESHOLD}")}
 UNION ALL {_select("brief", "corridor", _CORRIDOR, "composite_score", f"(SELECT * FROM v_corridor_facts {_down} LIMIT 10)")}
 UNION ALL {_select("brand_alert", "brand", _BRAND, "composite_score", f"(SELECT * FROM v_brand_scores WHERE composite_score >= {THRESHOLD} ORDER BY composite_score DESC, brand, country, category LIMIT 20) JOIN v_brands USING (brand)")}
 UNION ALL {_select("playbook", "playbook", _SHOW, "score", "v_show_text")})
WHERE title NOT IN (SELECT title FROM v_written_titles WHERE created_on >= DATE '2001-07-25')""", True)
_agg = lambda line, order, source, n: f"(SELECT string_agg(line, '; ' ORDER BY rn) FROM (SELECT {line} AS line, row_number() OVER ({order}) AS rn FROM {source}) WHERE rn <= {n})"
_line = f"category || ' x ' || country {_scored}"
register("v_week_facts", f"""
SELECT count(*) FILTER (WHERE kind IN ('alert', 'brand_alert')) AS alerts, count(*) FILTER (WHERE kind = 'brief') AS briefs, count(*) FILTER (WHERE kind = 'playbook') AS playbooks,
 (SELECT count(*) FROM v_brand_scores WHERE composite_score >= {THRESHOLD}) AS above, {_agg(_line, _down, "v_scores", 5)} AS corridors, {_agg(_line, _down, "v_scores", 3)} AS top,
 {_agg("show_name || ' on ' || strftime(start_on, '%Y-%m-%d')", "ORDER BY start_on, show_id", "v_shows WHERE start_on >= DATE '2001-08-01'", 3)} AS shows,
 {_agg(f"category || ' x ' || country || ' ' || {ONE('growth * 100')} || '% (' || tier || ')'", "ORDER BY growth DESC, country, category", "v_active", 5)} AS trends FROM v_fresh_insights""")
register("v_insights", f"SELECT * FROM v_fresh_insights UNION ALL {_select('digest', 'digest', _DIGEST, 'CAST(NULL AS DOUBLE)', 'v_week_facts')}")


def recorded(t: Tables) -> DataFrame:
    """Titles of earlier runs (title, created_on): each corridor's were written on the day of its first line in the last two weeks."""
    first = trailing(views.lines(t), "o_orderdate", dims.AS_OF, 14).groupBy(F.col("partner").alias("country"), "category").agg(F.to_date(F.min("o_orderdate")).alias("created_on"))
    slots = {"country": F.col("country"), "category": F.col("category")}
    titles = F.array(*[insights.render(insights.TITLES[kind], slots) for kind in ("alert", "brief")])
    return first.select(F.explode(titles).alias("title"), "created_on")


def written(t: Tables) -> DataFrame:
    x = LeadInputs(t, *SCORING)
    shows = views.shows(t)
    parts = [
        insights.corridor_insights(x.corridor_scores, x.gap, x.active, THRESHOLD),
        insights.brand_insights(x.brand_fit, views.brands(x.cells), THRESHOLD),
        insights.show_insights(shows, x.show_categories, views.exhibitors(t), x.corridor_scores, leads.top_brands(x.brand_fit)),
    ]
    week = lambda fresh: insights.digest(fresh, x.corridor_scores, x.brand_fit, shows, x.active, THRESHOLD)
    return insights.all_insights(parts, recorded(t), week)


@query("insights_pick", "SELECT kind, title, score FROM v_insights")
def insights_pick(t: Tables) -> DataFrame:
    return written(t).select("kind", "title", "score")


@query("insight_texts", "SELECT kind, title, body FROM v_insights")
def insight_texts(t: Tables) -> DataFrame:
    return written(t).select("kind", "title", "body")
