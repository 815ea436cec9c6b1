from datetime import date

from pyspark.sql import functions as F

from tradewind.operators import insights
from tradewind.plans import oracle_views


def scores(spark):
    return spark.createDataFrame(
        [("N1", "LARGE", 82.04, 80.0, 70.0, 60.0, 0.4), ("N2", "SMALL", 40.0, 50.0, 30.0, 20.0, 0.0), ("N3", "LARGE", 82.04, 1.0, 2.0, 3.0, 0.0)],
        "country string, category string, composite_score double, category_score double, brand_score double, ni_score double, entry_confidence double",
    )


def facts(spark):
    gaps = spark.createDataFrame([("N1", "LARGE", 55.55, 0.256)], "country string, category string, gap_score double, demand_pct double")
    trends = spark.createDataFrame([("N1", "LARGE", "mature", 0.07)], "country string, category string, tier string, growth double")
    return gaps, trends


def test_lines_without_a_value_drop_out_and_order_holds(spark):
    rows = {(r.kind, r.title): r.body.split("\n") for r in insights.corridor_insights(scores(spark), *facts(spark), threshold=80.0).collect()}
    full = rows["alert", "Opportunity alert: LARGE x N1"]
    assert full[0].startswith("LARGE in N1 stands at 82.0 of 100, tier mature.")
    assert full[1:] == [
        "Evidence:", "Corridor: LARGE x N1", "Composite 82.0 (category 80.0, brand 70.0, routing 60.0)", "Growth tier: mature",
        "Gap score: 55.6", "Demand above 26% of all corridors", "Foreign brands entering: 40% confidence",
    ]
    bare = rows["alert", "Opportunity alert: LARGE x N3"]
    assert bare[1:] == ["Evidence:", "Corridor: LARGE x N3", "Composite 82.0 (category 1.0, brand 2.0, routing 3.0)"]
    assert ("brief", "Market brief: SMALL in N2") in rows and ("alert", "Opportunity alert: SMALL x N2") not in rows


def test_briefs_take_the_best_with_ties_by_name(spark):
    rows = insights.corridor_insights(scores(spark), *facts(spark), threshold=101.0, briefs=1).collect()
    assert [r.title for r in rows] == ["Market brief: LARGE in N1"]


def test_a_title_is_not_written_again_within_seven_days(spark):
    rows = spark.createDataFrame([("alert", t, 1.0, "") for t in ("today", "edge", "old", "new")], "kind string, title string, score double, body string")
    log = spark.createDataFrame(
        [("today", date(2001, 8, 1)), ("edge", date(2001, 7, 25)), ("old", date(2001, 7, 24)), ("today", date(2001, 1, 1))], "title string, created_on date"
    )
    left = [r.title for r in insights.unrecorded(rows, log, as_of="2001-08-01").collect()]
    assert sorted(left) == ["new", "old"]


def test_shows_without_categories_or_exhibitors_have_a_playbook(spark):
    shows = spark.createDataFrame(
        [(1, "Expo A", "N1", date(2001, 8, 1)), (2, "Expo B", "N2", date(2001, 9, 1)), (3, "Past", "N3", date(2001, 7, 31))],
        "show_id int, show_name string, country string, start_on date",
    )
    categories = spark.createDataFrame([(1, "LARGE"), (1, "SMALL")], "show_id int, category string")
    booths = spark.createDataFrame([(1, 5, "B"), (1, 4, "A"), (1, 3, "C")], "show_id int, suppkey long, exhibitor string")
    top = spark.createDataFrame([("X", "LARGE", 61.0), ("X", "SMALL", 70.0), ("Y", "SMALL", 65.0)], "brand string, category string, composite_score double")
    got = {r.title: r for r in insights.show_insights(shows, categories, booths, scores(spark), top, as_of="2001-08-01", names=2, corridors=2).collect()}
    assert sorted(got) == ["Show playbook: Expo A", "Show playbook: Expo B"]
    assert got["Show playbook: Expo A"].body.split("\n")[1:] == [
        "Evidence:", "Starts on 2001-08-01", "Corridors: LARGE x N1 (82.0); LARGE x N3 (82.0)", "Exhibitors (3): A; B", "Scored brands: X (70.0); Y (65.0)",
    ]
    other = got["Show playbook: Expo B"]
    assert "general goods" in other.body and other.body.split("\n")[1:] == ["Evidence:", "Starts on 2001-09-01"] and other.score is None


def test_digest_counts_what_this_run_wrote(spark):
    gaps, trends = facts(spark)
    brands = spark.createDataFrame([("X", 90.0), ("Y", 10.0)], "brand string, composite_score double")
    shows = spark.createDataFrame([(1, "Expo A", date(2001, 8, 5))], "show_id int, show_name string, start_on date")
    alerts = insights.corridor_insights(scores(spark), gaps, trends, threshold=80.0)
    log = spark.createDataFrame([("Opportunity alert: LARGE x N3", date(2001, 7, 30))], "title string, created_on date")
    week = lambda fresh: insights.digest(fresh, scores(spark), brands, shows, trends, 80.0, as_of="2001-08-01")
    rows = insights.all_insights([alerts], log, week, as_of="2001-08-01").collect()
    body = next(r.body for r in rows if r.kind == "digest")
    assert "This run: 1 alerts, 3 briefs, 0 playbooks" in body and "Next shows: Expo A on 2001-08-05" in body
    assert "Trends: LARGE x N1 7.0% (mature)" in body and "Brands above the threshold: 1." in body
    again = log.unionByName(spark.createDataFrame([(r.title, date(2001, 8, 1)) for r in rows], log.schema))
    assert insights.all_insights([alerts], again, week, as_of="2001-08-01").count() == 0


def test_empty_tables_give_a_digest_only(spark):
    gaps, trends = facts(spark)
    none = lambda df: df.filter(F.lit(False))
    shows = spark.createDataFrame([], "show_id int, show_name string, country string, start_on date")
    brands = spark.createDataFrame([], "brand string, composite_score double")
    log = spark.createDataFrame([], "title string, created_on date")
    alerts = insights.corridor_insights(none(scores(spark)), none(gaps), none(trends), 50.0)
    week = lambda fresh: insights.digest(fresh, none(scores(spark)), brands, shows, none(trends), 50.0)
    rows = insights.all_insights([alerts], log, week).collect()
    assert [r.kind for r in rows] == ["digest"] and "week: none." in rows[0].body


def test_a_view_name_is_given_once():
    try:
        oracle_views.register("v_lines", "SELECT 1")
    except ValueError:
        return
    raise AssertionError("a second view of the same name was taken")
