from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.operators import series

START = date(2024, 1, 1)


def points(spark, rows):
    return spark.createDataFrame(rows, "country string, category string, day date, value double")


def weekly(country="DE", category="toys", n=14, start=50.0, step=3.0):
    return [(country, category, START + timedelta(days=7 * i), start + step * i) for i in range(n)]


def test_weekly_points_are_interpolated_daily(spark):
    rows = series.clean_series(points(spark, weekly())).orderBy("i").collect()
    assert len(rows) == 92 and rows[0]["n"] == 92
    assert [r["value"] for r in rows[:8]] == pytest.approx([50 + 3 * d / 7 for d in range(8)])


def test_short_series_and_short_spans_are_dropped(spark):
    few = weekly(n=4)
    narrow = [("FR", "toys", START + timedelta(days=2 * i), 50.0 + i) for i in range(14)]
    assert series.clean_series(points(spark, few)).count() == 0  # four points over 21 days
    assert series.clean_series(points(spark, narrow)).count() == 0


def test_one_group_per_country_and_category(spark):
    rows = [p for c in "ABCDEF" for k in "xyz" for p in weekly(c, k)]
    assert series.clean_series(points(spark, rows)).select("country", "category").distinct().count() == 18


def test_fence_drops_far_points_and_sparse_series(spark):
    spiky = weekly()[:-1] + [("DE", "toys", START + timedelta(days=91), 1e6)]
    assert series.outlier_fence(points(spark, spiky)).count() == 13
    zeros = [("DE", "z", START + timedelta(days=i), 0.0 if i % 3 else 1.0) for i in range(12)]
    assert series.outlier_fence(points(spark, zeros)).count() == 0


def simple(v):
    return 0.0 if len(v) < 2 or v[0] == 0 else (v[-1] - v[0]) / abs(v[0]) / len(v)


def test_methods_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    values = list(np.concatenate([100 + rng.normal(0, 0.5, 100), 110 + 0.3 * np.arange(20)]))  # a late shift
    rows = [("DE", "toys", START + timedelta(days=i), float(v)) for i, v in enumerate(values)]
    unfenced = points(spark, rows).withColumn("i", F.datediff("day", F.lit(START))).withColumn("n", F.lit(len(rows)))
    clean = unfenced.select("country", "category", "day", "value", "i", "n").cache()
    v = np.array([r["value"] for r in clean.orderBy("i").collect()])
    got = {r["method"]: r for r in series.all_methods(clean).collect()}

    def ema(p):
        k, e = 2 / (p + 1), [v[0]]
        for x in v[1:]:
            e.append(x * k + e[-1] * (1 - k))
        return e

    g = [(e[-1] - e[-5]) / abs(e[-5]) for e in (ema(7), ema(14), ema(30))]
    assert got["ema_convergence"]["variance"] == pytest.approx(np.var(g, ddof=1))
    assert got["ema_convergence"]["growth"] == pytest.approx((1 + g[1]) ** (365 / 14) - 1)

    y = np.log(v - v.min() + 1)
    slope = np.polyfit(np.arange(len(v)), y, 1)[0]
    assert got["linear_regression_log"]["growth"] == pytest.approx(np.exp(slope * 365) - 1)

    pos = neg = 0.0
    hit = None
    for i, z in enumerate((v - v.mean()) / v.std()):
        pos, neg = max(0, pos + z - 0.5), max(0, neg - z - 0.5)
        if pos > 4 or neg > 4:
            hit = (i, max(pos, neg))
            break
    assert hit and hit[0] >= 5
    after = v[hit[0]:]
    assert got["change_point_cusum"]["growth"] == pytest.approx(simple(after) * 365 / len(after))
    assert got["change_point_cusum"]["p_value"] == pytest.approx(min(1 / hit[1], 1))

    returns = v[1:] / v[:-1] - 1
    assert got["volatility_adjusted"]["growth"] == pytest.approx(returns.mean() * 365)

    cut = int(len(v) * 0.3)
    base, seen = v[:cut], v[cut:]
    out = (seen > base.mean() + 3 * base.std(ddof=1)) | (seen < max(0, base.mean() - 3 * base.std(ddof=1)))
    assert got["statistical_process_control"]["p_value"] == pytest.approx(1 - out.mean())

    weights = [1 / r["variance"] if r["variance"] > 0 else 0 for r in got.values()]
    growth = sum(r["growth"] * w for r, w in zip(got.values(), weights)) / sum(weights)
    assert series.ensemble(series.all_methods(clean)).first()["growth"] == pytest.approx(growth)


def test_weeks_of_different_years_share_an_index(spark):
    rows = [("DE", "toys", date(2023, 1, 2) + timedelta(days=i), 10.0 + i % 7) for i in range(700)]
    clean = series.clean_series(points(spark, rows))
    assert series.seasonal(clean).first()["sample_size"] == 53


def test_constant_series_has_no_volatility_method(spark):
    rows = [("DE", "toys", START + timedelta(days=i), 5.0) for i in range(70)]
    methods = {r["method"] for r in series.all_methods(series.clean_series(points(spark, rows))).collect()}
    assert "volatility_adjusted" not in methods and "change_point_cusum" not in methods


def test_validation_statuses(spark):
    base = dict(volatility=0.1, mean_sample=50.0, divergent=0, seasonality=0.0, is_accelerating=False, confidence=0.95, growth=0.3,
                sparse_baseline=False, recency_bias=False, significant=True)
    cases = [base, {**base, "volatility": 0.6}, {**base, "volatility": 0.6, "mean_sample": 5.0, "growth": 3.0}, {**base, "confidence": 0.6}]
    df = spark.createDataFrame([{**c, "k": i} for i, c in enumerate(cases)])
    got = [r["status"] for r in series.validate(df).orderBy("k").collect()]
    assert got == ["auto_approved", "manual_review", "rejected", "rejected"]
