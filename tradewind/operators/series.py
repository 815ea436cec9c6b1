"""Time-series detectors over one ordered series per (country, category).

Input points are one per (series, day), already averaged, so a series is bounded by the look-back
window. Every step is keyed by the series: one shuffle places a series, and all windows and
aggregates after it reuse that placement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tradewind.functions.numeric import clamp, direction, fisher_p, student_t_two_sided
from tradewind.sources.views import tier

KEY = ["country", "category"]


def by_key() -> WindowSpec:
    return Window.partitionBy(*KEY)


COLUMNS = [*KEY, "method", "growth", "variance", "confidence", "direction", "p_value", "r2", "sample_size"]


def outlier_fence(points: DataFrame) -> DataFrame:
    """Drop points beyond three interquartile ranges; a series under half non-zero disappears."""
    q1, q3 = F.percentile("value", F.lit(0.25)).over(by_key()), F.percentile("value", F.lit(0.75)).over(by_key())
    kept = (
        points.withColumn("q1", q1)
        .withColumn("q3", q3)
        .withColumn("iqr", F.col("q3") - F.col("q1"))
        .filter((F.col("value") >= F.col("q1") - 3 * F.col("iqr")) & (F.col("value") <= F.col("q3") + 3 * F.col("iqr")))
    )
    nonzero = F.sum((F.col("value") > 0).cast("int")).over(by_key())
    return kept.withColumn("dense", nonzero >= 0.5 * F.count("*").over(by_key())).filter("dense").select(*KEY, "day", "value", "q1", "q3")


def fill_gaps(points: DataFrame) -> DataFrame:
    """Daily linear interpolation wherever neighbours are more than two days apart."""
    w = by_key().orderBy("day")
    gap = F.date_diff(F.col("next_day"), F.col("day"))
    steps = F.when(gap > 2, F.sequence(F.lit(0), gap - 1)).otherwise(F.array(F.lit(0)))
    return (
        points.withColumn("next_day", F.lead("day").over(w))
        .withColumn("next_value", F.lead("value").over(w))
        .withColumn("step", F.when(gap > 2, (F.col("next_value") - F.col("value")) / gap).otherwise(0.0))
        .withColumn("d", F.explode(steps))
        .select(
            *KEY,
            F.date_add("day", F.col("d")).alias("day"),
            (F.col("value") + F.col("step") * F.col("d")).alias("value"),
            (F.col("d") > 0).alias("interpolated"),
        )
    )


def clean_series(points: DataFrame, min_points: int = 8, min_span_days: int = 60) -> DataFrame:
    """Fenced, gap-filled points with 0-based position ``i`` and series length ``n``."""
    filled = fill_gaps(outlier_fence(points))
    span = F.date_diff(F.max("day").over(by_key()), F.min("day").over(by_key()))
    return (
        filled.withColumn("i", F.row_number().over(by_key().orderBy("day")) - 1)
        .withColumn("n", F.count("*").over(by_key()).cast("int"))
        .withColumn("span", span)
        .filter((F.col("n") >= min_points) & (F.col("span") >= min_span_days))
        .select(*KEY, "day", "value", "i", "n")
    )


def simple_trend(first: Column, last: Column, n: Column) -> Column:
    return F.when((n < 2) | (first == 0), F.lit(0.0)).otherwise((last - first) / F.abs(first) / n)


def _method(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("method", F.lit(name)).withColumn("sample_size", F.col("sample_size").cast("bigint")).select(*COLUMNS)


def regression(clean: DataFrame) -> DataFrame:
    """Log-linear fit against position (raw when over 30 % zeros), delta-method variance, t-test."""
    v = F.col("value")
    zeros = F.avg(F.when(v == 0, 1.0).otherwise(0.0)).over(by_key())
    fit = (
        clean.withColumn("use_log", zeros <= 0.3)
        .withColumn("lo", F.min("value").over(by_key()))
        .withColumn("y", F.when(F.col("use_log"), F.log(v - F.col("lo") + 1.0)).otherwise(v))
        .groupBy(*KEY)
        .agg(
            F.first("use_log").alias("use_log"),
            F.count("*").alias("sample_size"),
            F.avg("value").alias("mean"),
            F.regr_slope("y", "i").alias("m"),
            F.regr_sxx("y", "i").alias("sxx"),
            F.regr_syy("y", "i").alias("syy"),
            F.regr_sxy("y", "i").alias("sxy"),
        )
    )
    m, n, mean = F.col("m"), F.col("sample_size"), F.col("mean")
    growth = F.when(F.col("use_log"), F.exp(m * 365.0) - 1.0).when(mean > 0, m * 365.0 / mean).otherwise(0.0)
    slope_effect = F.when(F.col("use_log"), 365.0 * F.exp(m * 365.0)).when(mean > 0, 365.0 / mean).otherwise(0.0)
    return _method(
        fit.withColumn("sse", F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0)))
        .withColumn("se", F.sqrt(F.col("sse") / F.greatest(n - 2, F.lit(1)) / F.col("sxx")))
        .withColumn("r2", F.when(F.col("syy") == 0, 1.0).otherwise(F.greatest(1.0 - F.col("sse") / F.col("syy"), F.lit(0.0))))
        .withColumn("t", F.when(F.col("se") > 0, m / F.col("se")).otherwise(0.0))
        .withColumn("p_value", student_t_two_sided(F.col("t"), n - 2))
        .withColumn("growth", growth)
        .withColumn("variance", F.pow(slope_effect * F.col("se"), F.lit(2.0)))
        .withColumn("confidence", clamp(F.col("r2") * (1.0 - F.col("p_value")), 0, 1))
        .withColumn("direction", direction(F.col("growth"), 0.02)),
        "linear_regression_log",
    )


def arrays(clean: DataFrame) -> DataFrame:
    """The ordered values of a series as one array, with its moments."""
    return clean.groupBy(*KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda s: s["value"]).alias("vals"),
        F.count("*").cast("int").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("sd"),
    )


def _ema(vals: Column, n: Column, period: int) -> Column:
    """Exponential mean after the first n values, seeded with the first one."""
    k = 2.0 / (period + 1)
    return F.aggregate(F.slice(vals, F.lit(2), n - 1), F.get(vals, F.lit(0)), lambda e, x: x * k + e * (1.0 - k))


def ema_convergence(series: DataFrame) -> DataFrame:
    """Growth of the 7, 14 and 30 point means over their last five values and how far they agree."""
    vals, n = F.col("vals"), F.col("n")

    def growth(period: int) -> Column:
        first, last = _ema(vals, n - 4, period), _ema(vals, n, period)
        return F.when(first != 0, (last - first) / F.abs(first)).otherwise(0.0)

    g = [F.col(f"g{p}") for p in (7, 14, 30)]
    mean = (g[0] + g[1] + g[2]) / 3.0
    variance = sum((x - F.col("gm")) * (x - F.col("gm")) for x in g) / 2.0
    agree = ((g[0] > 0) & (g[1] > 0) & (g[2] > 0)) | ((g[0] < 0) & (g[1] < 0) & (g[2] < 0))
    var = F.col("variance")
    return _method(
        series.filter(n >= 5)
        .select(*KEY, n.alias("sample_size"), *[growth(p).alias(f"g{p}") for p in (7, 14, 30)])
        .withColumn("gm", mean)
        .withColumn("variance", variance)
        .withColumn("confidence", clamp(F.when(agree, 0.9 - F.least(var * 10.0, F.lit(0.4))).otherwise(0.5), 0, 1))
        .withColumn("growth", F.pow(1.0 + g[1], F.lit(365.0 / 14.0)) - 1.0)
        .withColumn("direction", direction(F.col("gm"), 0.01))
        .withColumn("p_value", F.least(1.0 - F.col("confidence"), F.lit(1.0)))
        .withColumn("r2", F.greatest(1.0 - var, F.lit(0.0))),
        "ema_convergence",
    )


def seasonal(clean: DataFrame) -> DataFrame:
    """Weekly means against their 5-point centred mean; weeks of different years share an index."""
    week = F.floor((F.dayofyear("day") - 1) / 7)
    weekly = clean.groupBy(*KEY, week.alias("week")).agg(F.avg("value").alias("v"))
    ordered = by_key().orderBy("week")
    around = ordered.rowsBetween(-2, 2)
    trend = F.when(F.count("v").over(around) == 5, F.avg("v").over(around))
    valid = F.when(F.col("trend") != 0, F.col("trend"))
    per_series = (
        weekly.withColumn("trend", trend)
        .groupBy(*KEY)
        .agg(
            F.count("*").alias("sample_size"),
            F.var_pop("v").alias("total"),
            F.var_pop(F.coalesce(F.col("v") - F.col("trend"), F.lit(0.0))).alias("rest"),
            F.count(valid).alias("k"),
            F.min_by(valid, F.when(valid.isNotNull(), F.col("week"))).alias("first"),
            F.max_by(valid, F.when(valid.isNotNull(), F.col("week"))).alias("last"),
        )
        .filter("sample_size >= 4 AND k >= 2")
    )
    s, k = F.col("s"), F.col("k")
    step = (F.col("last") - F.col("first")) / F.abs("first")
    return _method(
        per_series.withColumn("s", F.when(F.col("total") > 0, F.col("rest") / F.col("total")).otherwise(0.0))
        .withColumn("growth", F.pow(1.0 + step, 52.0 / k) - 1.0)
        .withColumn("variance", (s + 0.01) * (1.0 / k))
        .withColumn("confidence", clamp(1.0 - s, 0.6, 1))
        .withColumn("direction", direction(F.col("growth"), 0.02))
        .withColumn("p_value", F.least(s, F.lit(1.0)))
        .withColumn("r2", F.greatest(1.0 - s, F.lit(0.0))),
        "seasonal_decomposition",
    )


def cusum_index(series: DataFrame) -> DataFrame:
    """First position at which a one-sided cumulative sum of standardised values passes 4."""
    start = F.struct(F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"), F.lit(0).alias("i"), F.lit(-1).alias("hit"), F.lit(0.0).alias("dev"))

    def step(acc: Column, x: Column) -> Column:
        z = (x - F.col("mean")) / F.col("sd")
        pos = F.greatest(F.lit(0.0), acc["pos"] + z - 0.5)
        neg = F.greatest(F.lit(0.0), acc["neg"] - z - 0.5)
        now = (acc["hit"] < 0) & ((pos > 4) | (neg > 4))
        return F.struct(
            pos.alias("pos"),
            neg.alias("neg"),
            (acc["i"] + 1).alias("i"),
            F.when(now, acc["i"]).otherwise(acc["hit"]).alias("hit"),
            F.when(now, F.greatest(pos, neg)).otherwise(acc["dev"]).alias("dev"),
        )

    fold = F.aggregate("vals", start, step, lambda acc: F.struct(acc["hit"].alias("hit"), acc["dev"].alias("dev")))
    return (
        series.filter("sd > 0")
        .withColumn("c", fold)
        .filter("c.hit >= 5")
        .select(*KEY, "n", "mean", F.col("c.hit").alias("change_index"), F.col("c.dev").alias("dev"),
                F.slice("vals", F.col("c.hit") + 1, F.col("n") - F.col("c.hit")).alias("after"))
    )


def cusum(series: DataFrame) -> DataFrame:
    """Change-point method: trend of the values after the change."""
    after, size, dev = F.col("after"), F.col("len"), F.col("dev")
    total = F.aggregate(after, F.lit(0.0), lambda a, x: a + x)
    spread = F.aggregate(after, F.lit(0.0), lambda a, x: a + (x - F.col("after_mean")) * (x - F.col("after_mean")))
    mean_sq = F.when(F.col("mean") != 0, F.pow("mean", F.lit(2.0))).otherwise(1.0)
    return _method(
        cusum_index(series)
        .withColumn("len", F.size(after))
        .withColumn("after_mean", total / size)
        .withColumn("after_var", spread / size)
        .withColumn("growth", simple_trend(F.get(after, F.lit(0)), F.element_at(after, -1), size) * (365.0 / size))
        .withColumn("variance", F.col("after_var") / size)
        .withColumn("confidence", F.least(F.lit(0.95), F.greatest(dev / 4.0 * (1.0 - F.col("after_var") / mean_sq), F.lit(0.0))))
        .withColumn("direction", direction(F.col("growth"), 0.02))
        .withColumn("p_value", F.least(1.0 / dev, F.lit(1.0)))
        .withColumn("r2", F.lit(0.7))
        .withColumn("sample_size", F.col("n")),
        "change_point_cusum",
    )


def volatility_adjusted(clean: DataFrame) -> DataFrame:
    """Mean daily return against its spread; a series without spread gives no result."""
    before = F.lag("value").over(by_key().orderBy("i"))
    stats = (
        clean.withColumn("before", before)
        .withColumn("ret", F.when(F.col("before") != 0, (F.col("value") - F.col("before")) / F.col("before")))
        .groupBy(*KEY)
        .agg(F.count("*").alias("sample_size"), F.count("ret").alias("k"), F.avg("ret").alias("mu"), F.var_samp("ret").alias("var"))
        .filter("k >= 10 AND var > 0")
    )
    mu, sigma, t = F.col("mu"), F.col("sigma"), F.col("t")
    return _method(
        stats.withColumn("sigma", F.sqrt("var"))
        .withColumn("t", mu / (sigma / F.sqrt(F.col("k").cast("double"))))
        .withColumn("growth", mu * 365.0)
        .withColumn("variance", 365.0 * 365.0 * (F.col("var") / F.col("k")))
        .withColumn("confidence", clamp(F.abs(t) / 3.0, 0, 0.95))
        .withColumn("direction", direction(mu / sigma, 0.1))
        .withColumn("p_value", F.least(1.0 / (F.abs(t) + 1.0), F.lit(1.0)))
        .withColumn("r2", F.greatest(1.0 - sigma / F.abs(mu + sigma + 1e-10), F.lit(0.0))),
        "volatility_adjusted",
    )


def process_control(clean: DataFrame) -> DataFrame:
    """Share of later values outside three sigma of the first 30 %."""
    split = F.floor(F.col("n") * 0.3)
    v, base = F.col("value"), F.col("i") < split
    limits = (
        clean.withColumn("base", base)
        .withColumn("bm", F.avg(F.when(base, v)).over(by_key()))
        .withColumn("bs", F.stddev_samp(F.when(base, v)).over(by_key()))
    )
    out = (v > F.col("bm") + 3 * F.col("bs")) | (v < F.greatest(F.lit(0.0), F.col("bm") - 3 * F.col("bs")))
    seen = ~F.col("base")
    stats = (
        limits.groupBy(*KEY)
        .agg(
            F.count("*").alias("sample_size"),
            F.count_if("base").alias("nb"),
            F.count_if(seen).alias("no"),
            F.var_samp(F.when(F.col("base"), v)).alias("bv"),
            F.count_if(seen & out).alias("breaches"),
            F.min_by("value", F.when(seen, F.col("i"))).alias("first"),
            F.max_by("value", F.when(seen, F.col("i"))).alias("last"),
        )
        .filter("nb >= 5 AND no >= 5")
    )
    rate = F.col("rate")
    return _method(
        stats.withColumn("rate", F.col("breaches") / F.col("no"))
        .withColumn("growth", simple_trend(F.col("first"), F.col("last"), F.col("no")) * (365.0 / F.col("no")))
        .withColumn("variance", F.col("bv") / F.col("nb"))
        .withColumn("confidence", clamp(rate * 2.0, 0, 0.9))
        .withColumn("direction", direction(F.col("growth"), 0.02))
        .withColumn("p_value", F.greatest(1.0 - rate, F.lit(0.0)))
        .withColumn("r2", F.lit(0.6)),
        "statistical_process_control",
    )


def all_methods(clean: DataFrame) -> DataFrame:
    series = arrays(clean)
    out = regression(clean)
    for part in (ema_convergence(series), seasonal(clean), cusum(series), volatility_adjusted(clean), process_control(clean)):
        out = out.unionByName(part)
    return out


def ensemble(methods: DataFrame) -> DataFrame:
    """Inverse-variance weighted growth and confidence, plurality direction, Fisher's combined p."""
    w = F.when(F.col("variance") > 0, 1.0 / F.col("variance")).otherwise(0.0)
    votes = lambda d: F.count_if(F.col("direction") == d)
    up, down, flat = F.col("up"), F.col("down"), F.col("flat")
    weighted = lambda c: F.when(F.col("w") > 0, F.col(f"w_{c}") / F.col("w")).otherwise(F.col(f"m_{c}"))
    voted = F.when(F.col("w") == 0, "flat").when(up > down, "up").when(down > up, "down").otherwise("flat")
    return (
        methods.groupBy(*KEY)
        .agg(
            F.count("*").alias("n_methods"),
            F.sum(w).alias("w"),
            F.sum(F.col("growth") * w).alias("w_growth"),
            F.sum(F.col("confidence") * w).alias("w_confidence"),
            F.avg("growth").alias("m_growth"),
            F.avg("confidence").alias("m_confidence"),
            F.sum(F.log(F.greatest("p_value", F.lit(1e-10)))).alias("ln_p"),
            F.avg("sample_size").alias("mean_sample"),
            votes("up").alias("up"),
            votes("down").alias("down"),
            votes("flat").alias("flat"),
        )
        .withColumn("direction", voted)
        .select(
            *KEY,
            "n_methods",
            weighted("growth").alias("growth"),
            F.least(weighted("confidence"), F.lit(1.0)).alias("confidence"),
            "direction",
            F.when(F.col("w") == 0, 1.0).otherwise(fisher_p(F.col("ln_p"), F.col("n_methods"))).alias("p_value"),
            F.when(F.col("direction") == "up", up).when(F.col("direction") == "down", down).otherwise(flat).alias("agreeing"),
            (F.col("n_methods") - F.greatest(up, down, flat)).alias("divergent"),
            "mean_sample",
        )
    )


def flags(clean: DataFrame) -> DataFrame:
    """Volatility, weekday seasonality, acceleration and sparse-baseline flags of a series."""
    v, i, n = F.col("value"), F.col("i"), F.col("n")
    mid = F.floor(n / 2)
    before = F.lag("value").over(by_key().orderBy("i"))
    first_half = i < mid
    pick = lambda f, cond: f("value", F.when(cond, F.col("i")))
    per_series = (
        clean.withColumn("before", before)
        .withColumn("log_ret", F.when((v > 0) & (F.col("before") > 0), F.log(v / F.col("before"))))
        .groupBy(*KEY)
        .agg(
            F.first("n").alias("n"),
            F.when(F.count("log_ret") >= 2, F.stddev_samp("log_ret") * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("volatility"),
            (F.count_if((i < F.floor(n / 3)) & (v > 0)) < 5).alias("sparse_baseline"),
            F.var_pop("value").alias("all_var"),
            F.count_if(first_half).alias("n1"),
            F.count_if(~first_half).alias("n2"),
            pick(F.min_by, first_half).alias("f1"),
            pick(F.max_by, first_half).alias("l1"),
            pick(F.min_by, ~first_half).alias("f2"),
            pick(F.max_by, ~first_half).alias("l2"),
        )
    )
    weekday = (
        clean.groupBy(*KEY, F.dayofweek("day").alias("dow"))
        .agg(F.avg("value").alias("m"))
        .groupBy(*KEY)
        .agg(F.count("*").alias("days"), F.var_pop("m").alias("day_var"))
    )
    c = F.col
    return per_series.join(weekday, KEY).select(
        *KEY,
        "n",
        "volatility",
        "sparse_baseline",
        F.when((c("days") >= 2) & (c("all_var") > 0), c("day_var") / c("all_var")).otherwise(0.0).alias("seasonality"),
        (simple_trend(c("f2"), c("l2"), c("n2")) > 1.5 * simple_trend(c("f1"), c("l1"), c("n1"))).alias("is_accelerating"),
    )


def trends(clean: DataFrame, max_growth: float = 5.0) -> DataFrame:
    """One composite trend per series, with tier and whether it passes the acceptance rules."""
    series = arrays(clean)
    change = cusum_index(series).select(*KEY, "change_index")
    t, g, conf = F.col("tier"), F.col("growth"), F.col("confidence")
    significant = F.col("p_value") < 0.05
    strict = significant & (conf >= 0.85) & (F.col("agreeing") >= 3)
    return (
        ensemble(all_methods(clean))
        .join(flags(clean), KEY)
        .join(change, KEY, "left")
        .filter(F.abs(g) <= max_growth)
        .withColumn("recency_bias", F.coalesce(F.col("change_index") > F.col("n") * 0.7, F.lit(False)))
        .withColumn("tier", tier(g, F.col("volatility"), conf))
        .withColumn("significant", significant)
        .withColumn(
            "accepted",
            F.when(t == "watch", F.col("n_methods") >= 3).when(t == "disrupted", strict).otherwise(strict & (g >= 0.05)),
        )
        .drop("change_index")
    )


def validate(trends_df: DataFrame) -> DataFrame:
    """Eight risk checks and the status they lead to."""
    c = F.col
    checks = [
        (c("volatility") > 0.5, "volatile"),
        (c("mean_sample") < 20, "few_points"),
        (c("divergent") > 3, "methods_disagree"),
        (c("seasonality") > 0.3, "seasonal"),
        (c("is_accelerating") & (c("confidence") < 0.9), "acceleration_unfounded"),
        (F.abs("growth") > 2.0, "extreme_growth"),
        (c("sparse_baseline"), "sparse_baseline"),
        (c("recency_bias"), "recency_bias"),
    ]
    risks = F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in checks]), lambda r: r.isNotNull())
    n = F.size(c("risks"))
    return (
        trends_df.withColumn("risks", risks)
        .withColumn(
            "status",
            F.when((n == 0) & (c("confidence") > 0.9) & c("significant"), "auto_approved")
            .when((n > 2) | (c("confidence") < 0.7), "rejected")
            .otherwise("manual_review"),
        )
        .withColumn("n_risks", n)
    )


def detection_run(validated: DataFrame, recorded: DataFrame) -> DataFrame:
    """Accepted trends not recorded lately, routed to the trend table, the review queue or rejection."""
    c = F.col
    return (
        validated.filter("accepted")
        .join(recorded, KEY, "left_anti")
        .withColumn("outcome", F.when(c("status") == "rejected", "rejection").when(c("status") == "manual_review", "review").otherwise("trend"))
        .withColumn(
            "priority",
            F.when((c("status") == "auto_approved") & (c("tier") == "breakthrough"), 10)
            .when((c("status") == "manual_review") & (c("confidence") > 0.8), 7)
            .when(c("status") == "manual_review", 5),
        )
    )
