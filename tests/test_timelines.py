import datetime as dt

from tradewind.plans import feeds
from tradewind.sources.tables import Tables


def test_another_event_kind_and_a_later_day_are_taken_from_the_table(spark, tmp_path):
    days = [dt.datetime(2025, 3, d, 12) for d in (1, 2, 2)]
    rows = [(i, ts, 3, kind, 1.0, "{}") for i, (ts, kind) in enumerate(zip(days, ["click", "click", "refund"]))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((str(r["day"]), r["keyword"], r["value"], r["is_partial"]) for r in feeds.timeline_points(Tables(spark, str(tmp_path))).collect())
    assert got == [("2025-03-01", "click", 1.0, False), ("2025-03-01", "refund", 0.0, False), ("2025-03-02", "click", 1.0, True), ("2025-03-02", "refund", 1.0, True)]


def test_windows_count_back_from_the_date(spark):
    from tradewind.sources import views

    assert [views.month_before("2001-08-01", n) for n in (1, 3, 7, 8, 12, 24)] == [200107, 200105, 200101, 200012, 200008, 199908]
    assert views.closed_years("2002-08-01", 2) == [2001, 2000]
    rows = [("EUROPE", "x", "c", ym, 100 * ym) for ym in (200008, 200107, 200108, 200207)] + [("AMERICA", "x", "c", 200101, 10**9)]
    cube = spark.createDataFrame(rows, "reporter string, partner string, category string, ym int, cents long")
    assert {r["year"] for r in views.consumption(cube, "2002-08-01").collect()} == {2000, 2001}
    assert {r["year"] for r in views.consumption(cube).collect()} == {2000}
    late = views.trends(cube, "2002-08-01").collect()
    assert [r["last_ym"] for r in late] == [200207]
