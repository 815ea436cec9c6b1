from datetime import date

from pyspark.sql import functions as F

from tradewind.operators import distributors as dist
from tradewind.operators import leads as ops
from tradewind.sources import dims


def corridor_leads(spark):
    leads = spark.createDataFrame(
        [(1, "One", "NATION_1", "A", True), (2, "Two", "NATION_1", "A", False), (3, "Three", "NATION_2", "B", True), (4, "Four", "NATION_3", "Z", True)],
        "lead long, company string, country string, brand string, linked boolean",
    )
    scores = "brand string, country string, category string, composite_score double"
    brand_scores = spark.createDataFrame([("A", "NATION_7", "LARGE", 60.0), ("A", "NATION_6", "SMALL", 70.0)], scores)
    corridor_scores = spark.createDataFrame(
        [("NATION_11", "LARGE", 80.0), ("NATION_9", "SMALL", 50.0)], "country string, category string, composite_score double"
    )
    categories = spark.createDataFrame([("A", "LARGE"), ("A", "SMALL")], "brand string, category string")
    targets = ops.brand_targets(brand_scores, corridor_scores, categories)
    return dist.lead_profiles(ops.resolve_corridor(leads, targets), categories)


def test_the_best_corridor_is_not_the_home_country(spark):
    rows = {r.lead: r for r in corridor_leads(spark).collect()}
    assert [(rows[1].home, rows[1].country, rows[1].category, rows[1].composite)] == [("NATION_1", "NATION_6", "SMALL", 70.0)]
    assert (rows[2].country, rows[2].category, rows[2].composite) == ("NATION_11", "LARGE", 80.0 * 0.7)
    assert (rows[3].country, rows[3].profile, rows[4].country, rows[4].composite) == (None, "", None, 0.0)
    assert rows[1].profile == rows[2].profile == "LARGE,SMALL"


def test_a_brand_without_categories_is_matched_by_its_best_one(spark):
    leads = spark.createDataFrame([(1, "A", "NATION_6", "SMALL")], "lead long, brand string, country string, category string")
    none = spark.createDataFrame([], "brand string, category string")
    rows = dist.profile_categories(dist.lead_profiles(leads, none)).collect()
    assert [tuple(r) for r in rows] == [("NATION_6", "SMALL", 1, "SMALL")]


def test_match_takes_distributors_of_the_best_country_only(spark):
    profiles = dist.profile_categories(corridor_leads(spark))
    firms = spark.createDataFrame([(1, "home", "NATION_1"), (2, "best", "NATION_6"), (3, "fallback", "NATION_11")], "suppkey long, name string, country string")
    categories = spark.createDataFrame([(1, "SMALL"), (2, "SMALL"), (3, "LARGE"), (3, "SMALL")], "suppkey long, category string")
    intent = spark.createDataFrame([(2, "SMALL", 0.9), (3, "LARGE", 0.3)], "suppkey long, category string, strength double")
    scores = spark.createDataFrame([(1, 90), (2, 40), (3, 80)], "suppkey long, score int")
    got = {r.suppkey: r for r in dist.match(profiles, firms, categories, intent, scores).collect()}
    assert sorted(got) == [2, 3]
    assert (got[2].country, got[2].match_score, got[2].reasons) == ("NATION_6", 0.625, "category_alignment,intent_signal,country_match")
    assert (got[3].country, got[3].match_score, got[3].reasons) == ("NATION_11", 0.725, "category_alignment,country_match")


def test_risk_is_that_of_the_corridor_and_a_second_run_changes_nothing(spark):
    leads = corridor_leads(spark)
    flags = dims.regulatory_flags(spark)
    risks = dist.regulatory_risk(leads, flags)
    got = {(r.country, r.category): (r.flags, r.risk) for r in risks.collect()}
    # SMALL in NATION_6 has one low flag, the medium one of NATION_14 is another market's; LARGE has a medium one and one of the whole market.
    assert got == {("NATION_6", "SMALL"): (1, "low"), ("NATION_11", "LARGE"): (2, "medium")}
    again = dist.regulatory_risk(leads.join(risks, ops.CORRIDOR, "left"), flags)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, risks.collect()))


def test_quality_uses_matches_and_risk_of_the_corridor(spark):
    leads = corridor_leads(spark).select("*", F.lit("new").alias("status"), F.lit(None).cast("date").alias("exported_on"),
                                         *[F.lit(False).alias(c) for c in ("has_email", "has_profile", "has_site")])
    gaps = spark.createDataFrame([], "country string, category string, gap_score double")
    tiers = spark.createDataFrame([], "country string, category string, tier string")
    counts = spark.createDataFrame([("NATION_1", "LARGE,SMALL", 9), ("NATION_6", "LARGE,SMALL", 2)], "country string, profile string, matches long")
    risks = spark.createDataFrame([("NATION_6", "SMALL", "medium"), ("NATION_1", "SMALL", "high")], "country string, category string, risk string")
    got = {r.lead: (r.matches, r.risk, r.quality) for r in ops.lead_quality(leads, gaps, tiers, counts, risks).collect()}
    assert got == {1: (2, "medium", 70 * 0.35 + 6 - 8), 2: (0, "low", 19.6), 3: (0, "low", 0.0), 4: (0, "low", 0.0)}


def test_export_carries_the_pipeline_and_the_newest_briefing(spark):
    quality = spark.createDataFrame(
        [(1, "One", "won", 10.0, "N1", "LARGE", None), (2, "Two", "new", 80.0, "N1", "LARGE", None), (3, "Three", "new", 80.0, "N1", "LARGE", date(2001, 7, 30))],
        "lead long, company string, status string, quality double, best_country string, best_category string, exported_on date",
    )
    campaigns = spark.createDataFrame(
        [(7, 1, "sent", date(2001, 1, 2), "x", 1), (8, 1, "draft", date(2001, 1, 1), "y", 2)], "campaign long, lead long, status string, created_on date, stage string, cents long"
    )
    pipeline = spark.createDataFrame([(1, "proposal", 12.5, 60)], "lead long, stage string, estimated_value double, probability_percent int")
    briefings = spark.createDataFrame(
        [(1, "old", date(2001, 1, 1)), (1, "a", date(2001, 2, 1)), (1, "b", date(2001, 2, 1)), (9, "other", date(2001, 3, 1))], "lead long, title string, created_on date"
    )
    chosen = ops.crm_selection(quality, campaigns, pipeline, briefings, as_of="2001-08-01")
    got = {r.lead: (r.status, r.last_campaign, r.stage, r.estimated_value, r.probability_percent, r.briefing) for r in chosen.collect()}
    assert got == {1: ("won", 7, "proposal", 12.5, 60, "b"), 2: ("new", None, None, None, None, None)}
    nested = {r.lead: r for r in ops.nested_export(chosen).collect()}
    assert (nested[1].pipeline.probabilityPercent, nested[1].briefingTitle, nested[2].pipeline, nested[2].lastCampaign) == (60, "b", None, None)


def test_match_rate_is_zero_without_exhibitors_and_skips_unknown_and_past_shows(spark):
    shows = spark.createDataFrame([(1, date(2001, 8, 1)), (2, date(2001, 9, 1)), (3, date(2001, 7, 1)), (4, date(2001, 9, 1))], "show_id int, start_on date")
    categories = spark.createDataFrame([(1, "LARGE"), (1, "SMALL"), (2, "LARGE"), (3, "LARGE")], "show_id int, category string")
    booths = spark.createDataFrame([(1, "A"), (1, None), (1, None), (3, "B"), (4, "C")], "show_id int, brand string")
    assert tuple(ops.match_rate(shows, categories, booths, "2001-08-01").first()) == (2, 3, 1, 0.333333)
    assert tuple(ops.match_rate(shows, categories, booths.filter("false"), "2001-08-01").first()) == (2, 0, 0, 0.0)
