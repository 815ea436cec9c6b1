import pytest
from pyspark.sql import functions as F

from tradewind.functions import numeric as n
from tradewind.sources import dims
from tradewind.sources.views import tier


def value(spark, column, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(column.alias("out")).first()[0]


@pytest.mark.parametrize("x, want", [(-2.5, -2.0), (2.5, 3.0), (-0.5, 0.0), (1.25, 1.0)])
def test_halves_round_toward_plus_infinity(spark, x, want):
    assert value(spark, n.half_up(F.col("x"), 0), x=x) == want


def test_guarded_division_and_change(spark):
    assert value(spark, n.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert value(spark, n.pct_change(F.lit(120.0), F.lit(100.0))) == 20.0
    assert value(spark, n.pct_change(F.lit(120.0), F.lit(0.0))) is None
    assert value(spark, n.cagr(F.lit(100.0), F.lit(200.0), 4)) == pytest.approx(18.92)


@pytest.mark.parametrize("t, df", [(12.706, 1), (4.303, 2), (3.182, 3), (2.571, 5), (2.228, 10), (1.967, 340)])
def test_t_distribution_at_table_values(spark, t, df):
    got = value(spark, n.student_t_two_sided(F.col("t"), F.col("df")), t=t, df=df)
    assert got == pytest.approx(0.05, abs=2e-4)


def test_fisher_matches_chi_square(spark):
    assert value(spark, n.fisher_p(F.lit(-5.0), F.lit(3))) == pytest.approx(0.124652, abs=1e-6)
    assert value(spark, n.fisher_p(F.lit(0.0), F.lit(3))) == 1.0


@pytest.mark.parametrize(
    "growth, volatility, confidence, want",
    [
        (0.55, 0.1, 0.9, "breakthrough"),
        (0.35, 0.1, 0.9, "accelerating"),
        (0.15, 0.1, 0.9, "sustained"),
        (0.07, 0.1, 0.9, "mature"),
        (-0.1, 0.1, 0.9, "disrupted"),
        (0.55, 0.99, 0.9, "watch"),
        (0.55, 0.1, 0.5, "watch"),
        (0.02, 0.1, 0.9, "watch"),
    ],
)
def test_tiers(spark, growth, volatility, confidence, want):
    assert value(spark, tier(F.col("g"), F.col("v"), F.col("c")), g=growth, v=volatility, c=confidence) == want


@pytest.mark.parametrize("c, b, r, want", [(80, 70, 60, 71.5), (100, 100, 100, 100), (0, 0, 0, 0), (50, 50, 50, 50), (90, 60, 40, 67)])
def test_composite_weights(c, b, r, want):
    w = dims.COMPOSITE_WEIGHTS
    assert sum(w.values()) == pytest.approx(1)
    assert w["category"] * c + w["brand"] * b + w["ni"] * r == pytest.approx(want)


def test_exact_slope_ignores_nulls(spark):
    df = spark.createDataFrame([(0, 10), (1, 20), (2, None), (3, 40)], "x int, y bigint")
    assert df.agg(n.exact_slope(F.col("y"), F.col("x"))).first()[0] == pytest.approx(10.0)
    assert df.filter("x = 0").agg(n.exact_slope(F.col("y"), F.col("x"))).first()[0] is None


def test_ladder_and_min_max(spark):
    steps = [(1e6, 0.3), (1e7, 0.7), (1e8, 1.0)]
    assert value(spark, n.ladder(F.lit(None).cast("double"), steps, 0.5, 0.5)) == 0.5
    assert value(spark, n.ladder(F.lit(5e6), steps, 0.5, 0.5)) == 0.7
    assert value(spark, n.min_max(F.lit(3.0), F.lit(3.0), F.lit(3.0), 0.5)) == 0.5
