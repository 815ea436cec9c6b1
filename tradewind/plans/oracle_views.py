"""The views of ``sources.views`` written once more as plain SQL, for the oracle queries.

``with_views`` puts the view definitions a query names (and those they name) in front of it.
"""

from __future__ import annotations

import re

from tradewind.sources import dims


def _values(rows: list[tuple], columns: str) -> str:
    def lit(v: object) -> str:
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS d({columns})"


def _case(column: str, table: dict[str, float], default: float) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


_FLOW = "CASE" + "".join(
    f" WHEN reporter = '{a}' AND partner_region = '{b}' THEN '{f}'" for (a, b), f in dims.FLOW_ROUTES.items()
) + " ELSE 'other' END"

TIER_SQL = """CASE WHEN volatility > 0.45 OR confidence < 0.85 THEN 'watch'
  WHEN growth >= 0.5 THEN 'breakthrough' WHEN growth >= 0.25 THEN 'accelerating'
  WHEN growth >= 0.1 THEN 'sustained' WHEN growth >= 0.05 THEN 'mature'
  WHEN growth < 0 THEN 'disrupted' ELSE 'watch' END"""

VIEWS: dict[str, str] = {
    "v_lines": """
SELECT rs.r_name AS reporter, nc.n_name AS partner, rc.r_name AS partner_region, p_type AS category,
  p_brand AS brand, l_suppkey AS suppkey, o_custkey AS custkey, c_name, o_orderkey, o_orderdate, o_orderpriority,
  l_linenumber, l_shipdate AS ship, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_quantity AS qty
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ns ON s_nationkey = ns.n_nationkey JOIN region rs ON ns.n_regionkey = rs.r_regionkey
JOIN nation nc ON c_nationkey = nc.n_nationkey JOIN region rc ON nc.n_regionkey = rc.r_regionkey""",
    "v_cube": """
SELECT reporter, partner, partner_region, category, year(ship) * 100 + month(ship) AS ym,
  CAST(sum(cents) AS BIGINT) AS cents, sum(qty) AS qty, count(*) AS n
FROM v_lines GROUP BY ALL""",
    "v_annual": f"""
SELECT *, floor(CASE WHEN weight > 0 THEN value / weight END * 100 + 0.5) / 100.0 AS unit_value FROM (
SELECT {_FLOW} AS flow, reporter, partner, category, CAST(ym // 100 AS INTEGER) AS year,
  CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(cents) AS DOUBLE) / 100 AS value, sum(qty) * 40.0 AS weight
FROM v_cube WHERE ym // 100 BETWEEN 1996 AND 2000 GROUP BY ALL)""",
    "v_growth": """
SELECT a.*, CASE WHEN p.value > 0 THEN floor((a.value - p.value) / p.value * 100 * 100 + 0.5) / 100 END AS growth_yoy
FROM v_annual a LEFT JOIN v_annual p ON a.flow = p.flow AND a.reporter = p.reporter AND a.partner = p.partner
 AND a.category = p.category AND a.year = p.year + 1""",
    "v_monthly": f"""
SELECT {_FLOW} AS flow, reporter, partner, category, ym, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(cents) AS DOUBLE) / 100 AS value
FROM v_cube WHERE ym BETWEEN 199901 AND 200012 GROUP BY ALL""",
    "v_share": """
SELECT partner AS country, category, CAST(ym // 100 AS INTEGER) AS year,
  CAST(sum(cents) AS DOUBLE) / 100 AS world,
  CAST(sum(cents) FILTER (WHERE reporter = 'AMERICA') AS DOUBLE) / 100 AS us,
  CAST(sum(cents) FILTER (WHERE reporter = 'ASIA') AS DOUBLE) / 100 AS cn,
  CAST(sum(cents) FILTER (WHERE reporter = 'EUROPE') AS DOUBLE) / 100 AS gb
FROM v_cube WHERE ym // 100 BETWEEN 1996 AND 2000 GROUP BY ALL""",
    "v_consumption": """
SELECT partner AS country, category, CAST(ym // 100 AS INTEGER) AS year,
  CAST(sum(cents) AS DOUBLE) / 100 / 1.08 / 1000000 AS eur_m
FROM v_cube WHERE ym // 100 IN (1999, 2000) AND reporter NOT IN ('AMERICA', 'ASIA') GROUP BY ALL""",
    "v_trends": f"""
SELECT country, category, growth, volatility, floor((1 - volatility * 0.3) * 1000000 + 0.5) / 1000000.0 AS confidence, last_ym,
  {TIER_SQL.replace('confidence', '(floor((1 - volatility * 0.3) * 1000000 + 0.5) / 1000000.0)')} AS tier
FROM (SELECT country, category, floor((cur / prev - 1) * 1000000 + 0.5) / 1000000.0 AS growth,
    floor(0.5 * sd / mean * 1000000 + 0.5) / 1000000.0 AS volatility, last_ym
  FROM (SELECT country, category, sum(c) FILTER (WHERE ym >= 200008) AS cur, sum(c) FILTER (WHERE ym < 200008) AS prev,
      stddev_samp(c) FILTER (WHERE ym >= 200008) AS sd, avg(c) FILTER (WHERE ym >= 200008) AS mean, max(ym) AS last_ym
    FROM (SELECT partner AS country, category, ym, CAST(sum(cents) AS DOUBLE) AS c FROM v_cube
      WHERE ym BETWEEN 199908 AND 200107 GROUP BY ALL) GROUP BY ALL)
  WHERE cur > 0 AND prev > 0 AND sd IS NOT NULL)""",
    "v_strength": """
SELECT partner AS country, category, sum(qty) / sum(n) / 50.0 AS strength
FROM v_cube WHERE ym BETWEEN 200105 AND 200107 GROUP BY ALL""",
    "v_signals": """
SELECT r_name AS country, c_mktsegment AS category, CAST(date_trunc('week', o_orderdate) AS DATE) AS day,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS value
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 365 DAYS AND o_orderdate <= TIMESTAMP '2001-08-01' GROUP BY ALL""",
    "v_activity": """
SELECT CAST(o_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id, c_name AS retailer, partner AS country,
  category, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'new_listing' WHEN o_orderpriority[1] = '3' THEN 'category_expansion'
  ELSE 'seasonal_rotation' END AS kind, brand, reporter, o_orderdate AS detected_at
FROM v_lines WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAYS AND o_orderdate <= TIMESTAMP '2001-08-01'""",
    "v_dist_cat": """
SELECT suppkey, category FROM (SELECT suppkey, category, c, sum(c) OVER (PARTITION BY suppkey) AS all_c, count(*) OVER (PARTITION BY suppkey) AS k FROM (
  SELECT l_suppkey AS suppkey, p_type AS category, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS c
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)) WHERE c * k >= all_c""",
    "v_dist_brand": """
SELECT suppkey, brand FROM (SELECT suppkey, brand, n, sum(n) OVER (PARTITION BY suppkey) AS all_n, count(*) OVER (PARTITION BY suppkey) AS k FROM (
  SELECT l_suppkey AS suppkey, p_brand AS brand, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)) WHERE n * k >= all_n""",
    "v_distributors": """
SELECT s_suppkey AS suppkey, s_name AS name, n_name AS country, r_name AS region, s_acctbal > 0 AS imports,
  s_suppkey % 3 <> 0 AS has_email, s_suppkey % 4 <> 0 AS has_site, s_suppkey % 5 <> 0 AS has_profile,
  'supplier of ' || p_name AS description
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN part ON p_partkey = s_suppkey""",
    "v_brand_cells": "SELECT brand, category, partner_region, CAST(sum(cents) AS BIGINT) AS c FROM v_lines GROUP BY ALL",
    "v_brand_cat": """
SELECT brand, category FROM (SELECT brand, category, sum(c) AS c, sum(sum(c)) OVER (PARTITION BY brand) AS all_c, count(*) OVER (PARTITION BY brand) AS k
  FROM v_brand_cells GROUP BY brand, category) WHERE c * k >= all_c""",
    "v_brands": """
SELECT brand, CAST(c AS DOUBLE) / 100 * CASE num % 4 WHEN 0 THEN 0.002 WHEN 1 THEN 0.02 WHEN 2 THEN 0.2 ELSE 1.0 END AS revenue,
  eu * 100 >= c * 20 AS eu_presence, num % 2 = 0 AS has_store, CASE WHEN num % 5 = 0 THEN 'US' ELSE 'XX' END AS origin
FROM (SELECT brand, CAST(split_part(brand, '#', 2) AS INTEGER) AS num, sum(c) AS c,
  coalesce(sum(c) FILTER (WHERE partner_region = 'EUROPE'), 0) AS eu FROM v_brand_cells GROUP BY brand)""",
    "v_leads": """
SELECT c_custkey AS lead, c_name AS company, n_name AS country, 'Brand#' || CAST(c_custkey % 25 + 1 AS VARCHAR) AS brand,
  c_custkey % 10 <> 0 AS linked, c_custkey % 3 <> 0 AS has_email, c_custkey % 4 <> 0 AS has_profile, c_custkey % 5 <> 0 AS has_site,
  ['new', 'reviewed', 'approved', 'replied', 'qualified', 'lost'][c_custkey % 6 + 1] AS status,
  CASE WHEN c_custkey % 2 = 1 THEN DATE '2001-08-01' - CAST(c_custkey % 15 AS INTEGER) END AS exported_on
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_campaigns": """
SELECT o_orderkey AS campaign, o_custkey AS lead,
  CASE o_orderstatus WHEN 'F' THEN 'sent' WHEN 'O' THEN 'draft' ELSE 'opened' END AS status,
  CAST(o_orderdate AS DATE) AS created_on,
  ['won', 'qualified', 'engaged', 'contacted', 'lost'][CAST(o_orderpriority[1] AS INTEGER)] AS stage,
  CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders""",
    "v_pipeline": """
SELECT o_custkey AS lead, ['negotiation', 'proposal', 'meeting', 'contact', 'prospect'][min(CAST(o_orderpriority[1] AS INTEGER))] AS stage,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS estimated_value, [80, 60, 40, 20, 10][min(CAST(o_orderpriority[1] AS INTEGER))] AS probability_percent
FROM orders WHERE o_orderstatus = 'O' GROUP BY 1""",
    "v_briefings": "SELECT o_custkey AS lead, 'Briefing of ' || strftime(max(o_orderdate), '%Y-%m-%d') AS briefing FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    "v_shows": """
SELECT n_nationkey AS show_id, 'Expo ' || n_name AS show_name, n_name AS country,
  DATE '2001-08-01' + CAST(n_nationkey * 15 - 30 AS INTEGER) AS start_on,
  ['Economy goods', 'Large goods', 'Medium goods', 'Promo goods', 'Small goods', 'Standard goods'][n_nationkey % 6 + 1] AS label1,
  ['Economy goods', 'Large goods', 'Medium goods', 'Promo goods', 'Small goods', 'Standard goods'][(n_nationkey * 3 + 1) % 6 + 1] AS label2
FROM nation""",
    "v_show_labels": "SELECT show_id, label1 AS label FROM v_shows UNION SELECT show_id, label2 FROM v_shows",
    "v_exhibitors": """
SELECT s_nationkey AS show_id, s_suppkey AS suppkey,
  CASE WHEN s_suppkey % 3 = 0 THEN 'BRAND#' || CAST(s_suppkey % 40 + 1 AS VARCHAR) ELSE s_name END AS exhibitor FROM supplier""",
    "v_engagement": """
SELECT event_id, ts, user_id AS lead, CASE event_type WHEN 'view' THEN 'opened' WHEN 'click' THEN 'clicked' WHEN 'error' THEN 'bounced'
  WHEN 'signup' THEN 'complained' WHEN 'purchase' THEN 'replied' END AS kind,
  CAST(props->>'$.k' AS INTEGER) % 2 = 0 AS hard, value FROM events""",
    "v_flags": _values(dims.REGULATORY_FLAGS, "category, market, risk, kind, description"),
    "v_rules": _values(dims.TRIGGER_RULES, "rule, metric, threshold, action"),
    "v_show_keywords": _values([(c, k) for c, ws in dims.SHOW_KEYWORDS.items() for k in ws], "category, keyword"),
    "v_synonyms": _values([(c, a) for c, ws in dims.CATEGORY_SYNONYMS.items() for a in ws], "category, alias"),
    "v_complexity": _values(list(dims.REGULATORY_COMPLEXITY.items()), "category, complexity"),
    "v_tier_bonus": _values(list(dims.TIER_BONUS.items()), "tier, bonus"),
    "v_tier_base": _values(list(dims.TIER_BASE.items()), "tier, base"),
    "v_subcategory": _values(
        [(c, dims.SUBCATEGORY_GROUP[c], k) for c, ws in dims.SUBCATEGORY_KEYWORDS.items() for k in ws], "label, parent, keyword"
    ),
    "v_segment": _values([(s, k, w) for s, ws in dims.SEGMENT_KEYWORDS.items() for k, w in ws], "segment, keyword, weight"),
    "v_taxonomy": _values(
        [(n, p, level, k, len(k.split())) for n, p, level, ws in dims.TAXONOMY for k in ws], "node, parent, level, keyword, weight"
    ),
    "v_aliases": _values([(c, a) for c, ws in dims.CATEGORY_ALIASES.items() for a in ws], "category, alias"),
}

# Views read several times by one query are computed once.
_MATERIALIZED = {"v_cube", "v_annual", "v_growth", "v_trends", "v_dist_cat", "v_brand_cells"}


def register(name: str, sql: str, materialized: bool = False) -> None:
    """Let a query module add its result as a view that later oracles can name; a name is given once."""
    if name in VIEWS:
        raise ValueError(f"view {name} is registered twice")
    VIEWS[name] = sql
    if materialized:
        _MATERIALIZED.add(name)


def slope_sql(y: str, x: str, where: str | None = None) -> str:
    """OLS slope from exact integer sums."""
    f = f" FILTER (WHERE {where})" if where else ""
    n, sx, sy = f"count(*){f}", f"sum({x}){f}", f"sum({y}){f}"
    sxy, sxx = f"sum({x} * {y}){f}", f"sum({x} * {x}){f}"
    return (
        f"CAST({n} * {sxy} - {sx} * {sy} AS DOUBLE) / nullif(CAST({n} * {sxx} - {sx} * {sx} AS DOUBLE), 0)"
    )


def with_views(body: str) -> str:
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", text):
            if name in VIEWS and name not in ordered:
                need(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    need(body)
    if not ordered:
        return body
    head = ",\n".join(
        f"{n} AS {'MATERIALIZED ' if n in _MATERIALIZED else ''}({VIEWS[n].strip()})" for n in ordered
    )
    body = body.strip()
    if re.match(r"WITH\s+RECURSIVE\s", body, re.I):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):].strip()}"
    if re.match(r"WITH\s", body, re.I):
        return f"WITH {head},\n{body[4:].strip()}"
    return f"WITH {head}\n{body}"
