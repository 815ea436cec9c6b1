"""Sides of joins that grow with the input are merged, and rollups taken in one pass equal those taken apart."""

from pyspark.sql import functions as F

from tradewind.operators import distributors as dist
from tradewind.operators import leads, scores
from tradewind.plans.leads import part_labels
from tradewind.sources import views
from tradewind.sources.tables import Tables

DIR = "/root/testdata/sf0.001"


def broadcast_joins(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]


def test_parts_customers_and_names_are_not_broadcast(spark):
    t = Tables(spark, DIR)
    wide = [line for make in (views.lines, views.activity, views.distributors) for line in broadcast_joins(make(t))]
    assert not [line for line in wide if "partkey" in line or "custkey" in line]
    rollups = broadcast_joins(views.supply_rollup(t)) + broadcast_joins(views.market_rollup(t))
    assert not [line for line in rollups if "partkey" in line or "custkey" in line]
    assert not [line for line in broadcast_joins(part_labels(t)) if "p_name" in line]


def small(spark, columns):
    """Rows whose size the planner knows to be small."""
    return spark.range(3).selectExpr(*[f"CAST(id AS {c.split()[1]}) AS {c.split()[0]}" for c in columns.split(", ")])


def test_distributors_and_their_pairs_are_not_broadcast(spark):
    firms = small(spark, "suppkey long, name string, country string, region string, has_profile boolean, description string")
    pairs = small(spark, "suppkey long, category string")
    booths, shows = small(spark, "show_id int, exhibitor string"), small(spark, "show_id int, category string")
    profiles = small(spark, "country string, profile string, n_categories int, category string")
    rated, intent = small(spark, "suppkey long, score int"), small(spark, "suppkey long, category string, strength double")
    matches = small(spark, "country string, profile string, suppkey long, match_score double")
    portfolio, labels = small(spark, "suppkey long, label string, parent string, n long"), small(spark, "brand string, profile string, label string, parent string")
    plans = (
        dist.buying_intent(firms, pairs, booths, shows, dist.audit_rows(firms)),
        dist.match(profiles, firms, pairs, intent, rated),
        dist.proximity(matches, portfolio, labels),
        scores.brand_density(firms, pairs, small(spark, "suppkey long, brand string")),
    )
    for df in plans:
        assert not [line for line in broadcast_joins(df) if "suppkey" in line or "lower_name" in line]


def test_one_pass_gives_the_totals_of_separate_ones(spark):
    t = Tables(spark, DIR)
    rows = lambda df: sorted(map(tuple, df.collect()))
    columns = ["reporter", "partner", "partner_region", "category", "ym", "cents", "qty", "n"]
    market = views.market_rollup(t).cache()
    assert rows(views.named_cube(t, market.filter("monthly = 1")).select(columns)) == rows(views.corridor_cube(t).select(columns))
    cells = views.lines(t).groupBy("brand", "category", "partner_region").agg(F.sum("cents").alias("c"))
    assert rows(views.brand_cells(t, market)) == rows(cells)
    supply = views.supply_rollup(t).cache()
    sold = t.read("lineitem").join(t.read("part"), F.col("l_partkey") == F.col("p_partkey"))
    by_type = sold.groupBy("l_suppkey", "p_type").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")))
    assert rows(supply.filter("by_type = 1").select("suppkey", "category", "c")) == rows(by_type)
    assert rows(supply.filter("by_type = 0").select("suppkey", "brand", "n")) == rows(sold.groupBy("l_suppkey", "p_brand").count())


def test_lines_are_not_sorted_to_meet_parts(spark):
    """the shares of parts and customers are hashed, so no merge sorts the lines or orders on their keys."""
    t = Tables(spark, DIR)
    for make in (views.market_rollup, views.supply_rollup):
        plan = make(t)._jdf.queryExecution().executedPlan().toString().splitlines()
        joins = [line for line in plan if "partkey" in line and "Join [" in line]
        assert joins and all("ShuffledHashJoin" in line for line in joins)
        assert not [line for line in plan if "SortMergeJoin" in line and "custkey" in line]


def test_latest_campaigns_are_not_broadcast(spark):
    """the picked leads are few, their campaigns are a row for every lead with an order."""
    pitched = small(spark, "lead long, company string, status string, quality double, has_email boolean, angle string")
    sent = small(spark, "campaign long, lead long, status string, created_on timestamp, stage string, cents long")
    assert not broadcast_joins(leads.outreach_pick(pitched, sent))
