"""Trade-series analytics: growth, trend lines, breakpoints, shares and their assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradewind.functions.numeric import cagr, cents_half_up, clamp, exact_slope, half_up, pct_change, ratio
from tradewind.sources import dims

SERIES = ["flow", "reporter", "partner", "category"]
FIRST, LAST = dims.TRADE_YEARS[0], dims.TRADE_YEARS[-1]


def yoy(annual: DataFrame) -> DataFrame:
    """Year-on-year percent against the calendar year before, not merely the row before."""
    w = Window.partitionBy(*SERIES).orderBy("year")
    previous = F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag("value").over(w))
    return annual.withColumn("growth_yoy", pct_change(F.col("value"), previous))


def annual_series(annual: DataFrame) -> DataFrame:
    """One row per series: values by year position, OLS line over the positive years, year span."""
    value = F.when(F.col("value") > 0, F.col("value"))
    x = F.col("year") - FIRST
    at = lambda column: F.array(*[F.max(F.when(F.col("year") == y, F.col(column))) for y in dims.TRADE_YEARS])
    return annual.groupBy(*SERIES).agg(
        at("value").alias("vals"),
        at("cents").alias("cent_vals"),
        F.count(value).alias("n_valid"),
        F.min(F.when(F.col("value") > 0, F.col("year"))).alias("min_year"),
        F.max("year").alias("as_of_year"),
        exact_slope(F.when(F.col("value") > 0, F.col("cents")), x).alias("slope_cents"),
        F.regr_r2(value, x).alias("r2_raw"),
        F.regr_syy(value, x).alias("syy"),
    )


def _at(year: Column) -> Column:
    return F.get("vals", (year - FIRST).cast("int"))


def r_squared(syy: Column, r2: Column) -> Column:
    return F.when(syy == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), r2))


def growth(series: DataFrame) -> DataFrame:
    """YoY, 3- and 5-year CAGR, OLS slope and fit of every series with at least two positive years."""
    current = _at(F.col("as_of_year"))
    return series.filter("n_valid >= 2").select(
        *SERIES,
        "as_of_year",
        pct_change(current, _at(F.col("as_of_year") - 1)).alias("yoy_growth_pct"),
        cagr(_at(F.lit(LAST - 3)), _at(F.lit(LAST)), 3).alias("cagr_3yr"),
        cagr(_at(F.lit(FIRST)), _at(F.lit(LAST)), 4).alias("cagr_5yr"),
        cents_half_up(F.col("slope_cents")).alias("linear_trend_slope"),
        half_up(r_squared(F.col("syy"), F.col("r2_raw"))).alias("r_squared"),
    )


def annual_break(series: DataFrame) -> DataFrame:
    """Best interior year at which the slope before and after (both including it) differ most."""
    points = (
        series.filter("n_valid >= 4")
        .select(*SERIES, "min_year", "as_of_year", "cent_vals", F.explode(F.sequence("min_year", "as_of_year")).alias("year"))
        .withColumn("v", F.get("cent_vals", F.col("year") - FIRST))
        .withColumn("v", F.when(F.col("v") > 0, F.col("v")))
    )
    w = Window.partitionBy(*SERIES).orderBy("year")
    up_to, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    x, v = F.col("year") - FIRST, F.col("v")
    candidates = points.select(
        *SERIES,
        "year",
        exact_slope(v, x, up_to).alias("c1"),
        exact_slope(v, x, after).alias("c2"),
        F.count("v").over(up_to).alias("n1"),
        F.count("v").over(after).alias("n2"),
        ((F.col("year") > F.col("min_year")) & (F.col("year") < F.col("as_of_year"))).alias("interior"),
    ).filter("interior AND n1 >= 2 AND n2 >= 2")
    shift = F.abs(F.col("s2") - F.col("s1")) / (F.abs(F.col("s1")) + 1)
    best = (
        candidates.withColumn("s1", F.col("c1") / 100.0)
        .withColumn("s2", F.col("c2") / 100.0)
        .withColumn("shift", shift)
        .groupBy(*SERIES)
        .agg(F.max_by(F.struct("year", "s1", "s2", "c1", "c2", "shift"), F.struct("shift", -F.col("year"))).alias("b"))
    )
    found = F.col("b.shift") > 0.5
    flips = (F.col("b.s1") >= 0) != (F.col("b.s2") >= 0)
    return best.filter("b.shift > 0").select(
        *SERIES,
        found.alias("detected"),
        F.when(found, F.col("b.year")).alias("breakpoint_year"),
        F.when(found & flips, "reversal")
        .when(found & (F.col("b.s2") > F.col("b.s1")), "acceleration")
        .when(found, "deceleration")
        .alias("breakpoint_type"),
        cents_half_up(F.col("b.c1")).alias("first_half_slope"),
        cents_half_up(F.col("b.c2")).alias("second_half_slope"),
    )


def _positions(monthly: DataFrame) -> DataFrame:
    """Monthly points with their position from both ends; at most 24 per series."""
    w = Window.partitionBy(*SERIES)
    return (
        monthly.withColumn("i", F.row_number().over(w.orderBy("ym")) - 1)
        .withColumn("n", F.count("*").over(w))
        .withColumn("back", F.col("n") - F.col("i"))
    )


def rolling(monthly: DataFrame) -> DataFrame:
    """Means of the last 12 (at least 6) and last 6 (at least 3) months, and the monthly trend line."""
    v, i, back = F.col("value"), F.col("i"), F.col("back")
    n = F.max("n")
    mean = lambda k: F.sum(F.when(back <= k, F.col("cents"))).cast("double") / F.count_if(back <= k)
    return (
        _positions(monthly)
        .groupBy(*SERIES)
        .agg(
            cents_half_up(F.when(n >= 6, mean(12))).alias("avg_12m"),
            cents_half_up(F.when(n >= 3, mean(6))).alias("avg_6m"),
            cents_half_up(F.when(n >= 6, exact_slope(F.col("cents"), i))).alias("monthly_slope"),
            half_up(F.when(n >= 6, r_squared(F.regr_syy(v, i), F.regr_r2(v, i)))).alias("monthly_r2"),
        )
    )


def monthly_break(monthly: DataFrame) -> DataFrame:
    """First month after the best split of a series of 8+ points (3+ on each side, disjoint)."""
    w = Window.partitionBy(*SERIES).orderBy("ym")
    before, rest = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    x, c = F.col("i"), F.col("cents")
    splits = (
        _positions(monthly.filter("value > 0"))
        .filter("n >= 8")
        .select(*SERIES, "ym", "i", "n", (exact_slope(c, x, before) / 100.0).alias("s1"), (exact_slope(c, x, rest) / 100.0).alias("s2"))
        .filter("i >= 3 AND i <= n - 3")
        .withColumn("shift", F.abs(F.col("s2") - F.col("s1")) / (F.abs(F.col("s1")) + 1))
    )
    return (
        splits.groupBy(*SERIES)
        .agg(F.max_by("ym", F.struct("shift", -F.col("i"))).alias("ym"), F.max("shift").alias("shift"))
        .filter("shift > 0.5")
        .select(*SERIES, F.col("ym").alias("breakpoint_month"))
    )


def acceleration(growth_df: DataFrame, rolling_df: DataFrame) -> DataFrame:
    """Short-term momentum: 6- over 12-month mean, or growth against the 5-year rate without months."""
    a6, a12, y, c5 = F.col("avg_6m"), F.col("avg_12m"), F.col("yoy_growth_pct"), F.col("cagr_5yr")
    by_month = a6.isNotNull() & (a12 > 0)
    by_year = y.isNotNull() & (F.abs(c5) > 0.01)
    score = F.when(by_month, half_up((a6 / a12 - 1) * 100)).when(by_year, half_up((y - c5) / F.abs(c5) * 100))
    return (
        growth_df.select(*SERIES, "yoy_growth_pct", "cagr_5yr")
        .join(rolling_df.select(*SERIES, "avg_6m", "avg_12m"), SERIES, "left")
        .withColumn("short_term_momentum", F.when(by_month, a6).when(by_year, y))
        .withColumn("acceleration_score", score)
        .withColumn("is_accelerating", F.coalesce(score > 15, F.lit(False)))
        .select(*SERIES, "short_term_momentum", "acceleration_score", "is_accelerating")
    )


def market_share(share: DataFrame) -> DataFrame:
    """Share of each origin in a market's imports, its change, and the saturation risk."""
    value = lambda name, year: F.max(F.when(F.col("year") == year, F.col(name)))
    pct = lambda part, whole: half_up(F.when(whole > 0, part / whole * 100))
    wide = share.groupBy("country", "category").agg(
        *[value(n, y).alias(f"{n}{s}") for n in ("world", "us", "cn", "gb") for y, s in ((LAST, ""), (LAST - 1, "_p"))]
    )
    c = F.col
    known = F.coalesce(c("us"), F.lit(0.0)) + F.coalesce(c("cn"), F.lit(0.0)) + F.coalesce(c("gb"), F.lit(0.0))
    world_growth = F.when((c("world") > 0) & (c("world_p") > 0), (c("world") - c("world_p")) / c("world_p"))
    us_growth = F.when(c("us_p") > 0, (c("us") - c("us_p")) / c("us_p"))
    return (
        wide.withColumn("us_share_pct", pct(c("us"), c("world")))
        .withColumn("us_share_prior_pct", pct(c("us_p"), c("world_p")))
        .withColumn("cn_share_pct", pct(c("cn"), c("world")))
        .withColumn("gb_share_pct", pct(c("gb"), c("world")))
        .withColumn("row_share_pct", half_up(F.when(c("world") > 0, F.greatest(F.lit(0.0), (c("world") - known) / c("world")) * 100)))
        .withColumn("us_vs_cn_diff", half_up(c("us_share_pct") - c("cn_share_pct")))
        .withColumn("share_change_pct", half_up(c("us_share_pct") - c("us_share_prior_pct")))
        .withColumn(
            "share_trend",
            F.when(F.abs("share_change_pct") < 1, "stable")
            .when(c("share_change_pct") > 0, "gaining")
            .when(c("share_change_pct") < 0, "losing"),
        )
        .withColumn("growth_vs_market", half_up(F.when(F.abs(world_growth) > 0.001, us_growth / F.abs(world_growth))))
        .withColumn(
            "saturation_risk",
            half_up(
                F.coalesce(F.least(F.lit(50.0), c("us_share_pct")), F.lit(0.0))
                + F.coalesce(clamp((c("growth_vs_market") - 1) * 25, 0, 50), F.lit(0.0))
            ),
        )
        .drop("world", "world_p", "us", "us_p", "cn", "cn_p", "gb", "gb_p")
    )


def consumption_growth(consumption: DataFrame) -> DataFrame:
    """Latest consumption of a market and its growth on the year before."""
    at = lambda y: F.max(F.when(F.col("year") == y, F.col("eur_m")))
    return (
        consumption.groupBy("country", "category")
        .agg(at(LAST).alias("now"), at(LAST - 1).alias("before"))
        .select(
            "country",
            "category",
            half_up(F.coalesce("now", "before")).alias("consumption_eur_m"),
            pct_change(F.coalesce("now", "before"), F.col("before")).alias("consumption_growth_pct"),
        )
    )


def oversupply(series: DataFrame, growth_df: DataFrame, consumption: DataFrame) -> DataFrame:
    """Import intensity, and imports outgrowing consumption by more than 10 points."""
    markets = consumption_growth(consumption).withColumnRenamed("country", "partner")
    usd = F.get("vals", (F.col("as_of_year") - FIRST).cast("int"))
    gap = half_up(F.col("yoy_growth_pct") - F.col("consumption_growth_pct"))
    return (
        series.select(*SERIES, usd.alias("usd"))
        .join(growth_df.select(*SERIES, "yoy_growth_pct"), SERIES)
        .join(markets, ["partner", "category"], "left")
        .select(
            *SERIES,
            "consumption_eur_m",
            half_up(ratio(F.col("usd") / dims.USD_PER_EUR / 1e6, F.col("consumption_eur_m")) * 100).alias("import_intensity_pct"),
            "consumption_growth_pct",
            gap.alias("growth_gap"),
            F.coalesce(gap > 10, F.lit(False)).alias("oversupply_flag"),
        )
    )


def analytics(annual: DataFrame, monthly: DataFrame, share: DataFrame, consumption: DataFrame) -> DataFrame:
    """Every metric of a series on one row; shares only where the flow has a competitor table."""
    series = annual_series(annual)
    base = growth(series)
    rolls = rolling(monthly)
    markets = market_share(share).withColumnsRenamed({"country": "partner"}).withColumn("flow", F.lit("us_to_eu"))
    shares = markets.select("flow", "partner", "category", "us_share_pct", "share_trend", "saturation_risk")
    return (
        base.join(rolls, SERIES, "left")
        .join(acceleration(base, rolls), SERIES, "left")
        .join(annual_break(series), SERIES, "left")
        .join(monthly_break(monthly), SERIES, "left")
        .join(oversupply(series, base, consumption), SERIES, "left")
        .join(shares, ["flow", "partner", "category"], "left")
        .withColumn("detected", F.coalesce("detected", F.lit(False)))
    )


def source_share(annual: DataFrame) -> DataFrame:
    """Per market, the part of two rival flows that comes from the first; markets with neither dropped."""
    of = lambda flow: F.coalesce(F.sum(F.when(F.col("flow") == flow, F.col("value"))), F.lit(0.0))
    return (
        annual.filter(F.col("flow").isin("us_to_eu", "uk_to_eu"))
        .groupBy(F.col("partner").alias("country"))
        .agg(of("us_to_eu").alias("direct"), of("uk_to_eu").alias("via"))
        .filter(F.col("direct") + F.col("via") > 0)
        .select("country", half_up(F.col("direct") / (F.col("direct") + F.col("via")) * 100).alias("direct_share_pct"))
    )


def before_after(annual: DataFrame) -> DataFrame:
    """Totals of the first and last reference year per flow and category, and the change."""
    at = lambda y: F.coalesce(F.sum(F.when(F.col("year") == y, F.col("value"))), F.lit(0.0))
    return (
        annual.groupBy("flow", "category")
        .agg(at(FIRST).alias("before"), at(LAST).alias("after"))
        .select("flow", "category", half_up(F.col("before")).alias("total_before"), half_up(F.col("after")).alias("total_after"),
                pct_change(F.col("after"), F.col("before")).alias("change_pct"))
    )


def top_rows(df: DataFrame, score: str, keys: list[str], k: int) -> DataFrame:
    """Top-k report: k rows per task reach the driver, not the table."""
    return df.orderBy(F.desc_nulls_last(score), *[F.asc(k) for k in keys]).limit(k)


def run_summary(rows: DataFrame) -> DataFrame:
    """Counts a run reports: series, accelerating, breakpoints, oversupplied, saturated."""
    return rows.agg(
        F.count("*").alias("series"),
        F.count_if("is_accelerating").alias("accelerating"),
        F.count_if("detected").alias("breakpoints"),
        F.count_if("oversupply_flag").alias("oversupplied"),
        F.count_if(F.col("saturation_risk") >= 50).alias("saturated"),
    )
