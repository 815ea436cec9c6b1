import datetime as dt

import pytest
from pyspark.sql import functions as F

from tradewind.operators import keywords, merge
from tradewind.sources import postings

SIGNALS = "grp string, category string, captured_on date, terms array<string>"


def terms(spark, rows, as_of="2024-02-01", **more):
    table = spark.createDataFrame([(g, c, dt.date.fromisoformat(d), t) for g, c, d, t in rows], SIGNALS)
    return sorted((r["category"], r["place"], r["keyword"]) for r in keywords.dynamic_keywords(table, ["grp"], as_of, **more).collect())


def test_dynamic_keywords_come_from_the_newest_runs(spark):
    rows = [("g", "tea", "2024-01-30", ["a", "b"]), ("g", "tea", "2024-01-31", ["c", "a"]), ("g", "jam", "2024-01-20", ["z"]), ("g", "tea", "2023-12-01", ["old"])]
    assert terms(spark, rows) == [("jam", 1, "z"), ("tea", 1, "c"), ("tea", 2, "a")]
    assert terms(spark, rows, days=5) == [("tea", 1, "c"), ("tea", 2, "a")]
    assert terms(spark, rows, recent=1) == [("tea", 1, "c"), ("tea", 2, "a")]
    assert terms(spark, rows[:1]) == [("tea", 1, "a"), ("tea", 2, "b")]


def test_keywords_of_day_keep_the_fixed_ones(spark):
    base = spark.createDataFrame([("g", "tea", "tea")], "grp string, category string, keyword string")
    dynamic = spark.createDataFrame([("g", "tea", "tea", 1), ("g", "tea", "green tea", 2)], "grp string, category string, keyword string, place int")
    assert sorted((r["keyword"], r["place"]) for r in keywords.keywords_of_day(base, dynamic, ["grp"]).collect()) == [("green tea", 2), ("tea", 0)]


@pytest.mark.parametrize(
    "kind, at, holds",
    [
        ("hours", "2001-07-31 16:00:00", True), ("hours", "2001-07-31 15:59:59", False),
        ("day", "2001-08-01 00:00:00", True), ("day", "2001-07-31 23:59:59", False),
        ("month", "2001-07-02 12:00:00", True), ("month", "2001-07-02 11:59:59", False),
        ("year", "2000-12-31 23:59:59", True), ("year", "1990-01-01 00:00:00", True), ("year", "2001-01-01 00:00:00", False), ("year", "2001-07-20 00:00:00", True),
        ("other", "2001-08-01 00:00:00", False), ("hours", "2001-08-01 13:00:00", False),
    ],
)
def test_validity_by_kind(spark, kind, at, holds):
    wanted = spark.createDataFrame([(1, kind)], "k int, kind string")
    captured = spark.createDataFrame([(1, at, 5)], "k int, captured_at string, v int").withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    row = merge.reuse(wanted, captured, ["k"], F.lit("2001-08-01 12:00:00").cast("timestamp"), ["v"]).first()
    assert (row["reused"], row["v"]) == (holds, 5 if holds else None)


def test_newest_valid_value_is_used_and_absent_keys_are_fetched(spark):
    wanted = spark.createDataFrame([(1, "month"), (2, "year")], "k int, kind string")
    captured = spark.createDataFrame([(1, "2001-07-20", 3), (1, "2001-07-25", 4), (1, "2001-09-01", 9)], "k int, at string, v int").select("k", F.col("at").cast("timestamp").alias("captured_at"), "v")
    got = {r["k"]: (r["reused"], r["v"]) for r in merge.reuse(wanted, captured, ["k"], F.lit("2001-08-01").cast("timestamp"), ["v"]).collect()}
    assert got == {1: (True, 4), 2: (False, None)}


def test_postings_answer_all_and_any_from_their_buckets(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, []), (4, None), (5, ["a", "c", None])], "k long, tags array<string>")
    path = str(tmp_path / "postings")
    postings.write(rows, "k", "tags", path)
    found = lambda wanted, every: sorted(r["k"] for r in postings.holding(rows.select("k"), path, "k", wanted, every).collect())
    assert found(["a", "b"], True) == [1] and found(["a", "b"], False) == [1, 2, 5] and found(["a", "a"], True) == [1, 5]
    assert found([], True) == [1, 2, 3, 4, 5] and found([], False) == [] and found(["none"], False) == []
    plan = postings.keys_holding(path, rows.select("k"), ["a"], False)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "EqualTo(value,a)" in plan or "In(value" in plan


def test_reliance_takes_stored_primary_fallback_category_and_default(spark):
    from tradewind.operators import scores

    corridors = spark.createDataFrame([(c, k) for c in (1, 2) for k in ("a", "b", "c", "d")], "country int, category string")
    mapping = spark.createDataFrame([("a", "P", "Q", 0.9), ("b", "X", "Q", 0.8), ("c", "Z", "Q", 0.7)], "category string, primary string, fallback string, usual double")
    flows = spark.createDataFrame([(1, "P", 3, 4), (1, "Q", 9, 6), (1, "Z", 0, 0)], "country int, code string, own long, world long")
    stored = spark.createDataFrame([(2, "a", "2001-07-25", 0.1), (2, "b", "2001-06-01", 0.2)], "country int, category string, at string, reliance double").select(
        "country", "category", F.col("at").cast("timestamp").alias("captured_at"), "reliance"
    )
    got = {(r["country"], r["category"]): (r["reliance"], r["source"]) for r in scores.reliance_by_code(corridors, mapping, flows, stored, "2001-08-01", 0.15).collect()}
    assert got == {
        (1, "a"): (0.75, "primary"), (1, "b"): (1.0, "fallback"), (1, "c"): (0.7, "category"), (1, "d"): (0.15, "default"),
        (2, "a"): (0.1, "stored"), (2, "b"): (0.8, "category"), (2, "c"): (0.7, "category"), (2, "d"): (0.15, "default"),
    }
