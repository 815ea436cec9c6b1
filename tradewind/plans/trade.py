"""Queries: trade-series analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradewind.functions.numeric import half_up
from tradewind.operators import trade
from tradewind.plans.oracle_views import register, slope_sql
from tradewind.plans.registry import query
from tradewind.sources import views
from tradewind.sources.tables import Tables, year_scan

S = "flow, reporter, partner, category"
R = lambda x: f"floor(({x}) * 100 + 0.5) / 100.0"

register("v_series_growth", f"""
SELECT {S}, m AS as_of_year, {R("CASE WHEN prev > 0 THEN (cur - prev) / prev * 100 END")} AS yoy_growth_pct,
  {R("CASE WHEN v1 > 0 AND v4 > 0 THEN (power(v4 / v1, 1.0 / 3) - 1) * 100 END")} AS cagr_3yr,
  {R("CASE WHEN v0 > 0 AND v4 > 0 THEN (power(v4 / v0, 1.0 / 4) - 1) * 100 END")} AS cagr_5yr,
  floor(slope + 0.5) / 100.0 AS linear_trend_slope, {R("CASE WHEN syy = 0 THEN 1 ELSE greatest(0, r2) END")} AS r_squared, cur
FROM (SELECT {S}, any_value(m) AS m, max(value) FILTER (WHERE year = m) AS cur, max(value) FILTER (WHERE year = m - 1) AS prev,
  max(value) FILTER (WHERE year = 1996) AS v0, max(value) FILTER (WHERE year = 1997) AS v1, max(value) FILTER (WHERE year = 2000) AS v4,
  {slope_sql("cents", "(year - 1996)")} AS slope, regr_r2(value, year - 1996) AS r2, regr_syy(value, year - 1996) AS syy, count(*) AS n
 FROM (SELECT *, max(year) OVER (PARTITION BY {S}) AS m FROM v_annual) GROUP BY {S}) WHERE n >= 2""", True)

register("v_rolling", f"""
SELECT {S}, floor(CASE WHEN count(*) >= 6 THEN CAST(sum(cents) FILTER (WHERE back <= 12) AS DOUBLE) / count(*) FILTER (WHERE back <= 12) END + 0.5) / 100.0 AS avg_12m,
  floor(CASE WHEN count(*) >= 3 THEN CAST(sum(cents) FILTER (WHERE back <= 6) AS DOUBLE) / count(*) FILTER (WHERE back <= 6) END + 0.5) / 100.0 AS avg_6m,
  floor(CASE WHEN count(*) >= 6 THEN {slope_sql("cents", "i")} END + 0.5) / 100.0 AS monthly_slope,
  {R("CASE WHEN count(*) >= 6 THEN CASE WHEN regr_syy(value, i) = 0 THEN 1 ELSE greatest(0, regr_r2(value, i)) END END")} AS monthly_r2
FROM (SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY ym) AS i, row_number() OVER (PARTITION BY {S} ORDER BY ym DESC) AS back
  FROM v_monthly) GROUP BY {S}""", True)

register("v_acceleration", f"""
SELECT {S}, CASE WHEN bm THEN avg_6m WHEN byr THEN yoy_growth_pct END AS short_term_momentum, score AS acceleration_score,
  coalesce(score > 15, false) AS is_accelerating
FROM (SELECT *, CASE WHEN bm THEN {R("(avg_6m / avg_12m - 1) * 100")} WHEN byr THEN {R("(yoy_growth_pct - cagr_5yr) / abs(cagr_5yr) * 100")} END AS score
 FROM (SELECT *, coalesce(avg_6m IS NOT NULL AND avg_12m > 0, false) AS bm, coalesce(yoy_growth_pct IS NOT NULL AND abs(cagr_5yr) > 0.01, false) AS byr
  FROM v_series_growth LEFT JOIN v_rolling USING ({S})))""")

register("v_annual_break", f"""
SELECT {S}, shift > 0.5 AS detected, CASE WHEN shift > 0.5 THEN year END AS breakpoint_year,
  CASE WHEN shift <= 0.5 THEN NULL WHEN (s1 >= 0) <> (s2 >= 0) THEN 'reversal' WHEN s2 > s1 THEN 'acceleration' ELSE 'deceleration' END AS breakpoint_type,
  floor(c1 + 0.5) / 100.0 AS first_half_slope, floor(c2 + 0.5) / 100.0 AS second_half_slope
FROM (SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY shift DESC, year) AS rk
 FROM (SELECT *, c1 / 100 AS s1, c2 / 100 AS s2, abs(c2 / 100 - c1 / 100) / (abs(c1 / 100) + 1) AS shift
  FROM (SELECT {S}, c.year, {slope_sql("a.cents", "(a.year - 1996)", "a.year <= c.year")} AS c1,
     {slope_sql("a.cents", "(a.year - 1996)", "a.year >= c.year")} AS c2, min(a.year) AS lo, max(a.year) AS hi, count(*) AS n,
     count(*) FILTER (WHERE a.year <= c.year) AS n1, count(*) FILTER (WHERE a.year >= c.year) AS n2
    FROM v_annual a, (SELECT unnest(range(1996, 2001)) AS year) c WHERE a.value > 0 GROUP BY ALL)
  WHERE n >= 4 AND n1 >= 2 AND n2 >= 2 AND year > lo AND year < hi) WHERE shift > 0) WHERE rk = 1""")

register("v_monthly_break", f"""
SELECT {S}, ym AS breakpoint_month FROM (SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY shift DESC, split) AS rk
 FROM (SELECT *, abs(s2 - s1) / (abs(s1) + 1) AS shift
  FROM (SELECT {S}, c.split, max(ym) FILTER (WHERE i = c.split) AS ym, {slope_sql("cents", "i", "i < c.split")} / 100 AS s1,
    {slope_sql("cents", "i", "i >= c.split")} / 100 AS s2, count(*) AS n
   FROM (SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY ym) - 1 AS i FROM v_monthly WHERE value > 0),
     (SELECT unnest(range(3, 22)) AS split) c GROUP BY ALL)
  WHERE n >= 8 AND split <= n - 3)) WHERE rk = 1 AND shift > 0.5""")

register("v_market", f"""
SELECT country, category, us_share_pct, us_share_prior_pct, cn_share_pct, gb_share_pct, row_share_pct,
  {R("us_share_pct - cn_share_pct")} AS us_vs_cn_diff, share_change_pct,
  CASE WHEN abs(share_change_pct) < 1 THEN 'stable' WHEN share_change_pct > 0 THEN 'gaining' WHEN share_change_pct < 0 THEN 'losing' END AS share_trend,
  growth_vs_market, {R("coalesce(least(50.0, us_share_pct), 0) + CASE WHEN growth_vs_market IS NULL THEN 0 ELSE least(50, greatest(0, (growth_vs_market - 1) * 25)) END")} AS saturation_risk
FROM (SELECT *, {R("us_share_pct - us_share_prior_pct")} AS share_change_pct FROM (
 SELECT country, category, {R("c.us / c.world * 100")} AS us_share_pct, {R("p.us / p.world * 100")} AS us_share_prior_pct,
  {R("c.cn / c.world * 100")} AS cn_share_pct, {R("c.gb / c.world * 100")} AS gb_share_pct,
  {R("CASE WHEN c.world > 0 THEN greatest(0, (c.world - coalesce(c.us, 0) - coalesce(c.cn, 0) - coalesce(c.gb, 0)) / c.world) * 100 END")} AS row_share_pct,
  {R("CASE WHEN abs((c.world - p.world) / p.world) > 0.001 THEN CASE WHEN p.us > 0 THEN (c.us - p.us) / p.us END / abs((c.world - p.world) / p.world) END")} AS growth_vs_market
 FROM (SELECT DISTINCT country, category FROM v_share) k LEFT JOIN (SELECT * FROM v_share WHERE year = 2000) c USING (country, category)
 LEFT JOIN (SELECT * FROM v_share WHERE year = 1999) p USING (country, category)))""")

register("v_oversupply", f"""
SELECT {S}, consumption_eur_m, CASE WHEN consumption_eur_m > 0 THEN {R("cur / 1.08 / 1000000 / consumption_eur_m * 100")} END AS import_intensity_pct,
  consumption_growth_pct, {R("yoy_growth_pct - consumption_growth_pct")} AS growth_gap,
  coalesce({R("yoy_growth_pct - consumption_growth_pct")} > 10, false) AS oversupply_flag
FROM v_series_growth LEFT JOIN (SELECT country AS partner, category, {R("coalesce(now, before)")} AS consumption_eur_m,
   {R("CASE WHEN before > 0 THEN (coalesce(now, before) - before) / before * 100 END")} AS consumption_growth_pct
  FROM (SELECT country, category, max(eur_m) FILTER (WHERE year = 2000) AS now, max(eur_m) FILTER (WHERE year = 1999) AS before
   FROM v_consumption GROUP BY ALL)) USING (partner, category)""")

register("v_analytics", f"""
SELECT g.* EXCLUDE (cur), r.avg_12m, r.avg_6m, r.monthly_slope, r.monthly_r2, a.short_term_momentum, a.acceleration_score, a.is_accelerating,
  coalesce(b.detected, false) AS detected, b.breakpoint_year, b.breakpoint_type, b.first_half_slope, b.second_half_slope, m.breakpoint_month,
  o.consumption_eur_m, o.import_intensity_pct, o.consumption_growth_pct, o.growth_gap, o.oversupply_flag,
  CASE WHEN g.flow = 'us_to_eu' THEN k.us_share_pct END AS us_share_pct, CASE WHEN g.flow = 'us_to_eu' THEN k.share_trend END AS share_trend,
  CASE WHEN g.flow = 'us_to_eu' THEN k.saturation_risk END AS saturation_risk
FROM v_series_growth g LEFT JOIN v_rolling r USING ({S}) LEFT JOIN v_acceleration a USING ({S}) LEFT JOIN v_annual_break b USING ({S})
LEFT JOIN v_monthly_break m USING ({S}) LEFT JOIN v_oversupply o USING ({S}) LEFT JOIN v_market k ON g.partner = k.country AND g.category = k.category""", True)


def _annual(t: Tables, reuse: bool = False) -> DataFrame:
    return views.annual(views.annual_cube(t, reuse))


def trade_analytics_rows(t: Tables) -> DataFrame:
    cube = views.annual_cube(t, reuse=True)
    return trade.analytics(views.annual(cube), views.monthly(cube), views.share(cube), views.consumption(cube))


@query("trade_growth", "SELECT * EXCLUDE (cur) FROM v_series_growth")
def trade_growth(t: Tables) -> DataFrame:
    return trade.growth(trade.annual_series(_annual(t)))


@query("trade_yoy", f"SELECT {S}, year, {R('value')} AS value, unit_value, growth_yoy FROM v_growth WHERE year IN (1999, 2000)")
def trade_yoy(t: Tables) -> DataFrame:
    rows = year_scan(trade.yoy(_annual(t)), [1999, 2000])
    return rows.select(*trade.SERIES, "year", half_up(F.col("value")).alias("value"), "unit_value", "growth_yoy")


@query("trade_rolling", "SELECT * FROM v_rolling")
def trade_rolling(t: Tables) -> DataFrame:
    return trade.rolling(views.monthly(views.monthly_cube(t)))


@query("trade_acceleration", "SELECT * FROM v_acceleration")
def trade_acceleration(t: Tables) -> DataFrame:
    cube = views.annual_cube(t, reuse=True)
    base = trade.growth(trade.annual_series(views.annual(cube)))
    return trade.acceleration(base, trade.rolling(views.monthly(cube)))


@query("break_annual", "SELECT * FROM v_annual_break")
def break_annual(t: Tables) -> DataFrame:
    return trade.annual_break(trade.annual_series(_annual(t)))


@query("break_monthly", "SELECT * FROM v_monthly_break")
def break_monthly(t: Tables) -> DataFrame:
    return trade.monthly_break(views.monthly(views.monthly_cube(t)))


@query("market_share", "SELECT * EXCLUDE (growth_vs_market, saturation_risk) FROM v_market")
def market_share(t: Tables) -> DataFrame:
    return trade.market_share(views.share(views.annual_cube(t))).drop("growth_vs_market", "saturation_risk")


@query("saturation", "SELECT country, category, us_share_pct, growth_vs_market, saturation_risk FROM v_market")
def saturation(t: Tables) -> DataFrame:
    rows = trade.market_share(views.share(views.annual_cube(t)))
    return rows.select("country", "category", "us_share_pct", "growth_vs_market", "saturation_risk")


@query("oversupply", "SELECT * FROM v_oversupply")
def oversupply(t: Tables) -> DataFrame:
    cube = views.annual_cube(t, reuse=True)
    series = trade.annual_series(views.annual(cube))
    return trade.oversupply(series, trade.growth(series), views.consumption(cube))


@query("trade_analytics", "SELECT * FROM v_analytics")
def trade_analytics(t: Tables) -> DataFrame:
    return trade_analytics_rows(t)


@query("trade_top_accelerations", f"""
SELECT {S}, acceleration_score, yoy_growth_pct FROM v_analytics WHERE acceleration_score IS NOT NULL
ORDER BY acceleration_score DESC, {S} LIMIT 10""")
def trade_top_accelerations(t: Tables) -> DataFrame:
    cube = views.annual_cube(t, reuse=True)
    base = trade.growth(trade.annual_series(views.annual(cube)))
    rows = trade.acceleration(base, trade.rolling(views.monthly(cube))).filter("acceleration_score IS NOT NULL")
    top = rows.join(base.select(*trade.SERIES, "yoy_growth_pct"), trade.SERIES)
    return trade.top_rows(top, "acceleration_score", trade.SERIES, 10).select(*trade.SERIES, "acceleration_score", "yoy_growth_pct")


@query("trade_run_summary", """
SELECT count(*) AS series, count(*) FILTER (WHERE is_accelerating) AS accelerating, count(*) FILTER (WHERE detected) AS breakpoints,
 count(*) FILTER (WHERE oversupply_flag) AS oversupplied, count(*) FILTER (WHERE saturation_risk >= 50) AS saturated FROM v_analytics""")
def trade_run_summary(t: Tables) -> DataFrame:
    return trade.run_summary(trade_analytics_rows(t))


@query("source_share", f"""
SELECT country, {R("direct / (direct + via) * 100")} AS direct_share_pct FROM (
 SELECT partner AS country, coalesce(sum(value) FILTER (WHERE flow = 'us_to_eu'), 0) AS direct,
  coalesce(sum(value) FILTER (WHERE flow = 'uk_to_eu'), 0) AS via FROM v_annual WHERE flow IN ('us_to_eu', 'uk_to_eu') GROUP BY 1)
WHERE direct + via > 0""")
def source_share(t: Tables) -> DataFrame:
    return trade.source_share(_annual(t))


@query("before_after", f"""
SELECT flow, category, {R("b")} AS total_before, {R("a")} AS total_after, {R("CASE WHEN b > 0 THEN (a - b) / b * 100 END")} AS change_pct FROM (
 SELECT flow, category, coalesce(sum(value) FILTER (WHERE year = 1996), 0) AS b, coalesce(sum(value) FILTER (WHERE year = 2000), 0) AS a
 FROM v_annual GROUP BY ALL)""")
def before_after(t: Tables) -> DataFrame:
    return trade.before_after(_annual(t))


@query("flow_totals", f"""
SELECT flow, partner, category, year, {R("sum(value)")} AS value_usd, {R("sum(value) / 1.08 / 1000000")} AS value_eur_m
FROM v_annual GROUP BY ALL""")
def flow_totals(t: Tables) -> DataFrame:
    totals = _annual(t).groupBy("flow", "partner", "category", "year").agg(F.sum("value").alias("v"))
    return totals.select(
        "flow", "partner", "category", "year",
        half_up(F.col("v")).alias("value_usd"), half_up(F.col("v") / 1.08 / 1e6).alias("value_eur_m"),
    )


@query("max_per_key", """
SELECT category, max(unit_value) AS max_unit_value, arg_max(partner, (unit_value, partner)) AS top_partner, count(*) AS n
FROM v_annual WHERE flow = 'us_to_eu' AND unit_value IS NOT NULL GROUP BY 1""")
def max_per_key(t: Tables) -> DataFrame:
    rows = _annual(t).filter("flow = 'us_to_eu' AND unit_value IS NOT NULL")
    return rows.groupBy("category").agg(
        F.max("unit_value").alias("max_unit_value"),
        F.max_by("partner", F.struct("unit_value", "partner")).alias("top_partner"),
        F.count("*").alias("n"),
    )
