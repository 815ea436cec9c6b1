import pytest

from tradewind.operators import trade

KEY = ("us_to_eu", "A", "B", "c")


def annual(spark, values):
    rows = [(*KEY, y, int(v * 100), float(v)) for y, v in values.items()]
    return spark.createDataFrame(rows, "flow string, reporter string, partner string, category string, year int, cents bigint, value double")


def test_growth_of_a_doubling_series(spark):
    row = trade.growth(trade.annual_series(annual(spark, {1996: 100, 1997: 110, 1998: 130, 1999: 160, 2000: 200}))).first()
    assert row["yoy_growth_pct"] == 25.0 and row["cagr_5yr"] == 18.92 and row["cagr_3yr"] == pytest.approx(22.05)
    assert row["linear_trend_slope"] == 25.0


def test_yoy_needs_the_calendar_year_before(spark):
    rows = {r["year"]: r["growth_yoy"] for r in trade.yoy(annual(spark, {1996: 100, 1998: 150, 1999: 300})).collect()}
    assert rows == {1996: None, 1998: None, 1999: 100.0}


def test_annual_break_includes_the_year_on_both_sides(spark):
    # Up to 1999 the slope is -2, from 1999 on -30: a relative shift of 28 / 3, more than 40 / 11 at 1998.
    row = trade.annual_break(trade.annual_series(annual(spark, {1996: 100, 1997: 110, 1998: 120, 1999: 90, 2000: 60}))).first()
    assert (row["breakpoint_year"], row["breakpoint_type"], row["first_half_slope"], row["second_half_slope"]) == (
        1999, "deceleration", -2.0, -30.0
    )


def test_too_short_series_have_no_break_or_growth(spark):
    short = trade.annual_series(annual(spark, {1999: 100}))
    assert trade.growth(short).count() == 0 and trade.annual_break(short).count() == 0


def test_monthly_rules(spark):
    rows = [(*KEY, 199901 + i, 100 * (i + 1 if i < 6 else 50 - i), float(i + 1 if i < 6 else 50 - i)) for i in range(12)]
    months = spark.createDataFrame(rows, "flow string, reporter string, partner string, category string, ym int, cents bigint, value double")
    assert trade.monthly_break(months).first()["breakpoint_month"] is not None
    roll = trade.rolling(months).first()
    assert roll["avg_6m"] == 41.5 and roll["avg_12m"] == 22.5
    five = trade.rolling(months.filter("ym <= 199905")).first()
    assert five["avg_12m"] is None and five["avg_6m"] == 3.0


def test_market_share_and_saturation(spark):
    rows = [("B", "c", 1999, 100.0, 20.0, 30.0, None), ("B", "c", 2000, 200.0, 80.0, 60.0, None)]
    row = trade.market_share(spark.createDataFrame(rows, "country string, category string, year int, world double, us double, cn double, gb double")).first()
    assert (row["us_share_pct"], row["share_change_pct"], row["share_trend"], row["row_share_pct"]) == (40.0, 20.0, "gaining", 30.0)
    assert row["growth_vs_market"] == 3.0 and row["saturation_risk"] == 90.0


def test_every_corridor_has_a_gap_score(spark):
    from tradewind.operators import scores

    n = 300
    trends = spark.range(n).selectExpr("concat('C', id) AS country", "'X' AS category", "id / 10.0D AS growth")
    blank = "country string, category string, {} double"
    none = lambda c: spark.createDataFrame([], blank.format(c))
    rows = scores.gap_scores(trends, none("strength"), none("density"), none("reliance")).collect()
    assert len(rows) == n and all(r["gap_score"] is not None for r in rows)
    share = {r["country"]: r["demand_pct"] for r in rows}
    assert share["C0"] == 0 and share["C299"] == 1 and share["C150"] == pytest.approx(150 / 299)
    assert scores.gap_scores(trends, none("strength"), none("density"), none("reliance"), limit=20).count() == 20
