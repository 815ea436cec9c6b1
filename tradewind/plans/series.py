"""Queries: time-series detectors, ensemble, validation and the detection run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradewind.functions.numeric import fisher_p, half_up, student_t_two_sided
from tradewind.operators import series
from tradewind.plans.oracle_views import TIER_SQL, register
from tradewind.plans.registry import query
from tradewind.sources import dims, views
from tradewind.sources.stages import stage
from tradewind.sources.tables import Tables

K = "country, category"
W = "PARTITION BY country, category"
DIR = lambda x, d: f"CASE WHEN {x} > {d} THEN 'up' WHEN {x} < -{d} THEN 'down' ELSE 'flat' END"
ST = lambda f, l, n: f"CASE WHEN {n} < 2 OR {f} = 0 THEN 0 ELSE ({l} - {f}) / abs({f}) / {n} END"


def t_sql(t: str, df: str) -> str:
    """Two-sided t: the same finite series, with each coefficient from the log-gamma function."""
    th = f"atan(abs({t}) / sqrt({df}))"
    odd = (f"1 - 2 / pi() * ({th} + sin({th}) * coalesce(list_sum(list_transform(range(1, ({df} - 1) // 2 + 1), "
           f"lambda j: exp((j - 1) * ln(4) + 2 * lgamma(j) - lgamma(2 * j)) * pow(cos({th}), 2 * j - 1))), 0))")
    even = (f"1 - sin({th}) * coalesce(list_sum(list_transform(range(0, {df} // 2), "
            f"lambda j: exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - 2 * j * ln(2)) * pow(cos({th}), 2 * j))), 0)")
    return f"CASE WHEN {df} < 1 THEN 1 WHEN {df} % 2 = 1 THEN least(greatest({odd}, 0), 1) ELSE least(greatest({even}, 0), 1) END"


def fisher_sql(half: str, k: str) -> str:
    return (f"CASE WHEN {half} <= 0 OR {k} < 1 THEN 1 ELSE least(1, exp(-({half})) * list_sum(list_transform(range(0, {k}), "
            f"lambda i: pow({half}, i) / gamma(i + 1)))) END")


register("v_fenced", f"""
SELECT country, category, day, value, q1, q3 FROM (SELECT *, count(*) FILTER (WHERE value > 0) OVER ({W}) AS nz, count(*) OVER ({W}) AS n FROM (
 SELECT s.*, q1, q3 FROM v_signals s JOIN (SELECT {K}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v_signals GROUP BY 1, 2) USING ({K})
 WHERE value >= q1 - 3 * (q3 - q1) AND value <= q3 + 3 * (q3 - q1))) WHERE nz >= 0.5 * n""")
register("v_filled", f"""
SELECT country, category, CAST(day + CAST(d AS INTEGER) AS DATE) AS day, value + CASE WHEN gap > 2 THEN (nv - value) / gap ELSE 0 END * d AS value, d > 0 AS interpolated
FROM (SELECT *, unnest(CASE WHEN gap > 2 THEN range(0, gap) ELSE [0] END) AS d FROM (
 SELECT *, lead(value) OVER ({W} ORDER BY day) AS nv, date_diff('day', day, lead(day) OVER ({W} ORDER BY day)) AS gap FROM v_fenced))""")
register("v_clean", f"""
SELECT country, category, day, value, i, n FROM (SELECT *, row_number() OVER ({W} ORDER BY day) - 1 AS i, count(*) OVER ({W}) AS n,
 date_diff('day', min(day) OVER ({W}), max(day) OVER ({W})) AS span FROM v_filled) WHERE n >= 8 AND span >= 60""", True)
register("v_reg", f"""
SELECT {K}, 'linear_regression_log' AS method, g AS growth, pow(dg * se, 2) AS variance, least(greatest(r2 * (1 - p), 0), 1) AS confidence,
 {DIR('g', 0.02)} AS direction, p AS p_value, r2, n AS sample_size
FROM (SELECT *, {t_sql("CASE WHEN se > 0 THEN m / se ELSE 0 END", "(n - 2)")} AS p,
  CASE WHEN use_log THEN exp(m * 365) - 1 WHEN mean > 0 THEN m * 365 / mean ELSE 0 END AS g, CASE WHEN use_log THEN 365 * exp(m * 365) WHEN mean > 0 THEN 365 / mean ELSE 0 END AS dg
 FROM (SELECT *, sqrt(sse / greatest(n - 2, 1) / sxx) AS se, CASE WHEN syy = 0 THEN 1 ELSE greatest(1 - sse / syy, 0) END AS r2
  FROM (SELECT {K}, bool_and(use_log) AS use_log, count(*) AS n, avg(value) AS mean, regr_slope(y, i) AS m, regr_sxx(y, i) AS sxx, regr_syy(y, i) AS syy,
    greatest(regr_syy(y, i) - regr_sxy(y, i) * regr_sxy(y, i) / regr_sxx(y, i), 0) AS sse
   FROM (SELECT *, CASE WHEN use_log THEN ln(value - lo + 1) ELSE value END AS y FROM (
    SELECT *, avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END) OVER ({W}) <= 0.3 AS use_log, min(value) OVER ({W}) AS lo FROM v_clean)) GROUP BY 1, 2)))""", True)

_E = lambda p, at: (f"pow(1 - 2.0::DOUBLE / {p + 1}, {at}) * max(value) FILTER (WHERE i = 0) + sum(2.0::DOUBLE / {p + 1} * pow(1 - 2.0::DOUBLE / {p + 1}, {at} - i) * value) "
                    f"FILTER (WHERE i BETWEEN 1 AND {at})")
register("v_ema", f"""
SELECT {K}, 'ema_convergence' AS method, pow(1 + g14, 365.0 / 14) - 1 AS growth, var AS variance, conf AS confidence, {DIR('gm', 0.01)} AS direction,
 least(1 - conf, 1) AS p_value, greatest(1 - var, 0) AS r2, n AS sample_size
FROM (SELECT *, CASE WHEN (g7 > 0 AND g14 > 0 AND g30 > 0) OR (g7 < 0 AND g14 < 0 AND g30 < 0) THEN 0.9::DOUBLE - least(var * 10, 0.4) ELSE 0.5 END AS conf
 FROM (SELECT *, (pow(g7 - gm, 2) + pow(g14 - gm, 2) + pow(g30 - gm, 2)) / 2 AS var FROM (SELECT *, (g7 + g14 + g30) / 3 AS gm FROM (
  SELECT {K}, n, (b7 - a7) / abs(a7) AS g7, (b14 - a14) / abs(a14) AS g14, (b30 - a30) / abs(a30) AS g30 FROM (
   SELECT {K}, n, {", ".join(f"{_E(p, '(n - 5)')} AS a{p}, {_E(p, '(n - 1)')} AS b{p}" for p in (7, 14, 30))} FROM v_clean GROUP BY 1, 2, 3)))))""", True)
register("v_seasonal", f"""
SELECT {K}, 'seasonal_decomposition' AS method, g AS growth, (s + 0.01::DOUBLE) * (1.0::DOUBLE / k) AS variance, least(greatest(1 - s, 0.6::DOUBLE), 1) AS confidence,
 {DIR('g', 0.02)} AS direction, least(s, 1) AS p_value, greatest(1 - s, 0) AS r2, n AS sample_size
FROM (SELECT *, pow(1 + (last - first) / abs(first), 52.0::DOUBLE / k) - 1 AS g FROM (
 SELECT {K}, count(*) AS n, CASE WHEN var_pop(v) > 0 THEN var_pop(coalesce(v - trend, 0)) / var_pop(v) ELSE 0 END AS s, count(*) FILTER (WHERE trend <> 0) AS k,
  arg_min(trend, week) FILTER (WHERE trend <> 0) AS first, arg_max(trend, week) FILTER (WHERE trend <> 0) AS last
 FROM (SELECT *, CASE WHEN count(*) OVER w = 5 THEN avg(v) OVER w END AS trend FROM (SELECT {K}, (dayofyear(day) - 1) // 7 AS week, avg(value) AS v FROM v_clean GROUP BY 1, 2, 3)
  WINDOW w AS ({W} ORDER BY week ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) GROUP BY 1, 2) WHERE n >= 4 AND k >= 2)""", True)
register("v_change", f"""
SELECT {K}, n, mean, arg_min(i, i) AS hit, arg_min(greatest(pos, neg), i) AS dev FROM (
 SELECT *, sp - least(0, min(sp) OVER o) AS pos, sn - least(0, min(sn) OVER o) AS neg FROM (
  SELECT *, sum(z - 0.5) OVER o AS sp, sum(-z - 0.5) OVER o AS sn FROM (
   SELECT *, (value - mean) / sd AS z FROM (SELECT *, avg(value) OVER ({W}) AS mean, stddev_pop(value) OVER ({W}) AS sd FROM v_clean) WHERE sd > 0)
  WINDOW o AS ({W} ORDER BY i)) WINDOW o AS ({W} ORDER BY i)) WHERE pos > 4 OR neg > 4 GROUP BY 1, 2, 3, 4 HAVING arg_min(i, i) >= 5""", True)
register("v_cusum", f"""
SELECT {K}, 'change_point_cusum' AS method, g AS growth, var / len AS variance,
 least(0.95, greatest(dev / 4 * (1 - var / CASE WHEN mean <> 0 THEN mean * mean ELSE 1 END), 0)) AS confidence, {DIR('g', 0.02)} AS direction, least(1 / dev, 1) AS p_value, 0.7::DOUBLE AS r2, n AS sample_size
FROM (SELECT *, {ST('first', 'last', 'len')} * (365.0::DOUBLE / len) AS g FROM (
 SELECT {K}, any_value(c.n) AS n, any_value(mean) AS mean, any_value(dev) AS dev, count(*) AS len, var_pop(value) AS var, arg_min(value, i) AS first, arg_max(value, i) AS last
 FROM v_clean JOIN v_change c USING ({K}) WHERE i >= hit GROUP BY 1, 2))""", True)
register("v_vol", f"""
SELECT {K}, 'volatility_adjusted' AS method, mu * 365 AS growth, 365.0 * 365.0 * (var / k) AS variance, least(abs(t) / 3, 0.95) AS confidence, {DIR('(mu / sqrt(var))', 0.1)} AS direction,
 least(1 / (abs(t) + 1), 1) AS p_value, greatest(1 - sqrt(var) / abs(mu + sqrt(var) + 1e-10), 0) AS r2, n AS sample_size
FROM (SELECT *, mu / (sqrt(var) / sqrt(k)) AS t FROM (SELECT {K}, count(*) AS n, count(r) AS k, avg(r) AS mu, var_samp(r) AS var FROM (
  SELECT *, CASE WHEN b <> 0 THEN (value - b) / b END AS r FROM (SELECT *, lag(value) OVER ({W} ORDER BY i) AS b FROM v_clean)) GROUP BY 1, 2) WHERE k >= 10 AND var > 0)""", True)
register("v_spc", f"""
SELECT {K}, 'statistical_process_control' AS method, g AS growth, bv / nb AS variance, least(2 * rate, 0.9) AS confidence, {DIR('g', 0.02)} AS direction, 1 - rate AS p_value, 0.6::DOUBLE AS r2, n AS sample_size
FROM (SELECT *, CAST(breaches AS DOUBLE) / no AS rate, {ST('first', 'last', 'no')} * (365.0::DOUBLE / no) AS g FROM (
 SELECT {K}, count(*) AS n, count(*) FILTER (WHERE base) AS nb, count(*) FILTER (WHERE NOT base) AS no, var_samp(value) FILTER (WHERE base) AS bv,
  count(*) FILTER (WHERE NOT base AND (value > bm + 3 * bs OR value < greatest(0, bm - 3 * bs))) AS breaches,
  arg_min(value, i) FILTER (WHERE NOT base) AS first, arg_max(value, i) FILTER (WHERE NOT base) AS last
 FROM (SELECT *, avg(value) FILTER (WHERE base) OVER ({W}) AS bm, stddev_samp(value) FILTER (WHERE base) OVER ({W}) AS bs FROM (
  SELECT *, i < floor(n * 0.3::DOUBLE) AS base FROM v_clean)) GROUP BY 1, 2) WHERE nb >= 5 AND no >= 5)""", True)
register("v_methods", " UNION ALL ".join(f"SELECT * FROM {v}" for v in ("v_reg", "v_ema", "v_seasonal", "v_cusum", "v_vol", "v_spc")), True)
register("v_ensemble", f"""
SELECT {K}, n_methods, growth, confidence, direction, CASE WHEN w = 0 THEN 1 ELSE {fisher_sql("(-ln_p)", "n_methods")} END AS p_value,
 CASE direction WHEN 'up' THEN up WHEN 'down' THEN down ELSE flat END AS agreeing, n_methods - greatest(up, down, flat) AS divergent, mean_sample
FROM (SELECT *, CASE WHEN w > 0 THEN wg / w ELSE mg END AS growth, least(CASE WHEN w > 0 THEN wc / w ELSE mc END, 1) AS confidence,
  CASE WHEN w = 0 THEN 'flat' WHEN up > down THEN 'up' WHEN down > up THEN 'down' ELSE 'flat' END AS direction FROM (
 SELECT {K}, count(*) AS n_methods, sum(w) AS w, sum(growth * w) AS wg, sum(confidence * w) AS wc, avg(growth) AS mg, avg(confidence) AS mc, sum(ln(greatest(p_value, 1e-10))) AS ln_p,
  avg(sample_size) AS mean_sample, count(*) FILTER (WHERE direction = 'up') AS up, count(*) FILTER (WHERE direction = 'down') AS down, count(*) FILTER (WHERE direction = 'flat') AS flat
 FROM (SELECT *, CASE WHEN variance > 0 THEN 1 / variance ELSE 0 END AS w FROM v_methods) GROUP BY 1, 2))""", True)
register("v_series_flags", f"""
SELECT {K}, n, volatility, sparse_baseline, CASE WHEN days >= 2 AND all_var > 0 THEN day_var / all_var ELSE 0 END AS seasonality,
 {ST('f2', 'l2', 'n2')} > 1.5 * {ST('f1', 'l1', 'n1')} AS is_accelerating
FROM (SELECT {K}, any_value(n) AS n, CASE WHEN count(lr) >= 2 THEN stddev_samp(lr) * sqrt(252) ELSE 0 END AS volatility, count(*) FILTER (WHERE i < n // 3 AND value > 0) < 5 AS sparse_baseline,
  var_pop(value) AS all_var, count(*) FILTER (WHERE i < n // 2) AS n1, count(*) FILTER (WHERE i >= n // 2) AS n2, arg_min(value, i) FILTER (WHERE i < n // 2) AS f1,
  arg_max(value, i) FILTER (WHERE i < n // 2) AS l1, arg_min(value, i) FILTER (WHERE i >= n // 2) AS f2, arg_max(value, i) FILTER (WHERE i >= n // 2) AS l2
 FROM (SELECT *, CASE WHEN value > 0 AND lag(value) OVER ({W} ORDER BY i) > 0 THEN ln(value / lag(value) OVER ({W} ORDER BY i)) END AS lr FROM v_clean) GROUP BY 1, 2)
JOIN (SELECT {K}, count(*) AS days, var_pop(m) AS day_var FROM (SELECT {K}, dayofweek(day) AS dow, avg(value) AS m FROM v_clean GROUP BY 1, 2, 3) GROUP BY 1, 2) USING ({K})""", True)
register("v_detected", f"""
SELECT *, coalesce(CASE WHEN tier = 'watch' THEN n_methods >= 3 WHEN tier = 'disrupted' THEN strict ELSE strict AND growth >= 0.05 END, false) AS accepted FROM (
SELECT e.*, f.* EXCLUDE (country, category), coalesce(hit > f.n * 0.7::DOUBLE, false) AS recency_bias, {TIER_SQL} AS tier, p_value < 0.05 AS significant,
 p_value < 0.05 AND confidence >= 0.85 AND agreeing >= 3 AS strict
FROM v_ensemble e JOIN v_series_flags f USING ({K}) LEFT JOIN (SELECT {K}, hit FROM v_change) USING ({K}) WHERE abs(growth) <= 5)""", True)
register("v_validated", f"""
SELECT *, CASE WHEN n_risks = 0 AND confidence > 0.9 AND significant THEN 'auto_approved' WHEN n_risks > 2 OR confidence < 0.7 THEN 'rejected' ELSE 'manual_review' END AS status
FROM (SELECT *, CAST(CASE WHEN risks = '' THEN 0 ELSE len(string_split(risks, ',')) END AS INTEGER) AS n_risks FROM (
SELECT *, concat_ws(',', CASE WHEN volatility > 0.5 THEN 'volatile' END, CASE WHEN mean_sample < 20 THEN 'few_points' END, CASE WHEN divergent > 3 THEN 'methods_disagree' END,
 CASE WHEN seasonality > 0.3 THEN 'seasonal' END, CASE WHEN is_accelerating AND confidence < 0.9 THEN 'acceleration_unfounded' END, CASE WHEN abs(growth) > 2 THEN 'extreme_growth' END,
 CASE WHEN sparse_baseline THEN 'sparse_baseline' END, CASE WHEN recency_bias THEN 'recency_bias' END) AS risks FROM v_detected))""")
register("v_recorded", f"""
SELECT DISTINCT r_name AS country, c_mktsegment AS category FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate = TIMESTAMP '2001-08-01'""")

_ROUND = {"growth": 5, "variance": 4, "confidence": 6, "p_value": 6, "r2": 6, "volatility": 6, "seasonality": 6, "mean_sample": 3}


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: half_up(F.col(c), p) for c, p in _ROUND.items() if c in df.columns})


def rounded_sql(view: str, columns: list[str]) -> str:
    return "SELECT " + ", ".join(
        f"floor({c} * {10 ** _ROUND[c]} + 0.5) / {10 ** _ROUND[c]}.0 AS {c}" if c in _ROUND else c for c in columns
    ) + f" FROM {view}"


def clean(t: Tables, keep: bool = False) -> DataFrame:
    """Cleaned daily series; staged when several detectors read it (bounded: a year of days per series)."""
    out = series.clean_series(views.signals(t))
    return stage(out, "clean_series") if keep else out


def recorded(t: Tables) -> DataFrame:
    day = t.read("orders").filter(F.col("o_orderdate") == F.lit(dims.AS_OF))
    return (
        day.join(views.customers(t), F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("cust_region").alias("country"), F.col("c_mktsegment").alias("category"))
        .distinct()
    )


@query("outlier_fence", f"SELECT {K}, strftime(day, '%Y-%m-%d') AS day, round(value, 4) AS value, round(q1, 4) AS q1, round(q3, 4) AS q3 FROM v_fenced")
def outlier_fence(t: Tables) -> DataFrame:
    r = lambda c: F.round(c, 4).alias(c)
    return series.outlier_fence(views.signals(t)).select(*series.KEY, F.date_format("day", "yyyy-MM-dd").alias("day"), r("value"), r("q1"), r("q3"))


@query("gap_fill", f"SELECT {K}, strftime(day, '%Y-%m-%d') AS day, round(value, 4) AS value, interpolated FROM v_filled")
def gap_fill(t: Tables) -> DataFrame:
    rows = series.fill_gaps(series.outlier_fence(views.signals(t)))
    return rows.select(*series.KEY, F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("value", 4).alias("value"), "interpolated")


@query("reg_method", rounded_sql("v_reg", series.COLUMNS))
def reg_method(t: Tables) -> DataFrame:
    return rounded(series.regression(clean(t)))


@query("ema_method", rounded_sql("v_ema", series.COLUMNS))
def ema_method(t: Tables) -> DataFrame:
    return rounded(series.ema_convergence(series.arrays(clean(t))))


@query("seasonal_method", rounded_sql("v_seasonal", series.COLUMNS))
def seasonal_method(t: Tables) -> DataFrame:
    return rounded(series.seasonal(clean(t)))


@query("cusum_method", rounded_sql("v_cusum", series.COLUMNS))
def cusum_method(t: Tables) -> DataFrame:
    return rounded(series.cusum(series.arrays(clean(t))))


@query("vol_method", rounded_sql("v_vol", series.COLUMNS))
def vol_method(t: Tables) -> DataFrame:
    return rounded(series.volatility_adjusted(clean(t)))


@query("spc_method", rounded_sql("v_spc", series.COLUMNS))
def spc_method(t: Tables) -> DataFrame:
    return rounded(series.process_control(clean(t)))


_ENSEMBLE = ["country", "category", "n_methods", "growth", "confidence", "direction", "p_value", "agreeing", "divergent", "mean_sample"]
_TREND = [*_ENSEMBLE, "n", "volatility", "sparse_baseline", "seasonality", "is_accelerating", "recency_bias", "tier", "significant", "accepted"]


@query("ensemble", rounded_sql("v_ensemble", _ENSEMBLE))
def ensemble(t: Tables) -> DataFrame:
    return rounded(series.ensemble(series.all_methods(clean(t, keep=True))))


@query("trend_flags", rounded_sql("v_series_flags", ["country", "category", "n", "volatility", "sparse_baseline", "seasonality", "is_accelerating"]))
def trend_flags(t: Tables) -> DataFrame:
    return rounded(series.flags(clean(t)))


@query("trend_tiers", rounded_sql("v_detected", _TREND))
def trend_tiers(t: Tables) -> DataFrame:
    return rounded(series.trends(clean(t, keep=True))).select(*_TREND)


@query("trend_validate", rounded_sql("v_validated", ["country", "category", "growth", "confidence", "tier", "accepted", "risks", "n_risks", "status"]))
def trend_validate(t: Tables) -> DataFrame:
    rows = series.validate(series.trends(clean(t, keep=True))).withColumn("risks", F.array_join("risks", ","))
    return rounded(rows).select("country", "category", "growth", "confidence", "tier", "accepted", "risks", "n_risks", "status")


@query("trend_detect", rounded_sql(f"""(SELECT *, CASE status WHEN 'rejected' THEN 'rejection' WHEN 'manual_review' THEN 'review' ELSE 'trend' END AS outcome,
 CASE WHEN status = 'auto_approved' AND tier = 'breakthrough' THEN 10 WHEN status = 'manual_review' AND confidence > 0.8 THEN 7 WHEN status = 'manual_review' THEN 5 END AS priority
 FROM v_validated v WHERE accepted AND NOT EXISTS (SELECT 1 FROM v_recorded r WHERE r.country = v.country AND r.category = v.category))""",
                                   ["country", "category", "growth", "confidence", "tier", "status", "outcome", "priority"]))
def trend_detect(t: Tables) -> DataFrame:
    run = series.detection_run(series.validate(series.trends(clean(t, keep=True))), recorded(t))
    return rounded(run).select("country", "category", "growth", "confidence", "tier", "status", "outcome", "priority")


@query("t_pvalue", f"""
SELECT flow, reporter, partner, category, n - 2 AS df, round(t, 4) AS t, round({t_sql("t", "(n - 2)")}, 6) AS p_value FROM (
 SELECT *, sqrt(r2 / (1 - r2) * (n - 2)) AS t FROM (SELECT flow, reporter, partner, category, count(*) AS n, regr_r2(value, ym) AS r2 FROM v_monthly GROUP BY 1, 2, 3, 4) WHERE n >= 3 AND r2 < 1)""")
def t_pvalue(t: Tables) -> DataFrame:
    """Significance of the monthly trend of every trade series."""
    keys = ["flow", "reporter", "partner", "category"]
    months = views.monthly(views.monthly_cube(t))
    fits = months.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_r2("value", "ym").alias("r2")).filter("n >= 3 AND r2 < 1")
    stat = F.sqrt(F.col("r2") / (1 - F.col("r2")) * (F.col("n") - 2))
    tested = fits.withColumn("t", stat).withColumn("p_value", student_t_two_sided(F.col("t"), F.col("n") - 2))
    return tested.select(
        *keys, (F.col("n") - 2).alias("df"), F.round("t", 4).alias("t"), F.round("p_value", 6).alias("p_value")
    )


@query("fisher_pvalue", f"""
SELECT partner, k, round(2 * half, 4) AS chi_square, round({fisher_sql("half", "k")}, 6) AS p_value FROM (
 SELECT partner, count(*) AS k, -sum(ln(greatest(1 - r2, 1e-10))) AS half FROM (
  SELECT partner, category, reporter, regr_r2(value, ym) AS r2 FROM v_monthly GROUP BY 1, 2, 3 HAVING count(*) >= 3) GROUP BY 1)""")
def fisher_pvalue(t: Tables) -> DataFrame:
    """Unexplained shares of a market's series combined as if they were p-values."""
    months = views.monthly(views.monthly_cube(t))
    fits = months.groupBy("partner", "category", "reporter").agg(F.count("*").alias("n"), F.regr_r2("value", "ym").alias("r2")).filter("n >= 3")
    sums = fits.groupBy("partner").agg(F.count("*").alias("k"), F.sum(F.log(F.greatest(1 - F.col("r2"), F.lit(1e-10)))).alias("s"))
    return sums.select("partner", "k", F.round(-2 * F.col("s"), 4).alias("chi_square"), F.round(fisher_p(F.col("s"), F.col("k")), 6).alias("p_value"))
