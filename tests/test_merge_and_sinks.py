import json

from pyspark.sql import functions as F

from tradewind import sinks
from tradewind.operators import leads, merge
from tradewind.sources import feeds
from tradewind.sources.tables import list_scan, optional

SCHEMA = "k int, g string, v int"


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_upsert_twice_equals_once(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "a", 2)], SCHEMA)
    delta = spark.createDataFrame([(2, "b", 9), (3, "b", 3)], SCHEMA)
    once = merge.upsert(base, delta, ["k"])
    assert rows(once) == [(1, "a", 1), (2, "b", 9), (3, "b", 3)] == rows(merge.upsert(once, delta, ["k"]))


def test_insert_absent_keeps_the_first(spark):
    base = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    delta = spark.createDataFrame([(1, "b", 9), (2, "b", 2)], SCHEMA)
    once = merge.insert_absent(base, delta, ["k"])
    assert rows(once) == [(1, "a", 1), (2, "b", 2)] == rows(merge.insert_absent(once, delta, ["k"]))


def test_grains_are_updated_apart(spark):
    base = spark.createDataFrame([(1, None, 1), (1, "x", 2)], SCHEMA)
    delta = spark.createDataFrame([(1, None, 7)], SCHEMA)

    got = {r["g"]: r["v"] for r in merge.upsert_by_grain(base, delta, "g", ["k", "g"], ["k"]).collect()}
    assert got == {"x": 2, None: 7}


def test_update_where_and_stale_keys(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "a", 2)], SCHEMA)
    hit = spark.createDataFrame([(2, "z", 0), (2, "y", 0)], SCHEMA)
    assert rows(merge.update_where(base, hit, ["k"], {"v": F.lit(5)})) == [(1, "a", 1), (2, "a", 5)]
    assert rows(merge.stale_keys(base.select("k"), base, ["k"], F.col("v") > 1)) == [(1,)]


def test_store_upsert_insert_and_publication(spark, tmp_path):
    store = str(tmp_path / "store")
    first = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    assert sinks.read_table(spark, store, "t") is None
    sinks.upsert_table(spark, store, "t", first, ["k"])
    sinks.upsert_table(spark, store, "t", spark.createDataFrame([(1, "b", 2)], SCHEMA), ["k"])
    sinks.insert_table(spark, store, "t", spark.createDataFrame([(1, "c", 3), (2, "c", 3)], SCHEMA), ["k"])
    assert rows(sinks.read_table(spark, store, "t")) == [(1, "b", 2), (2, "c", 3)]


def test_failed_publication_shows_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    good = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    bad = good.withColumn("v", F.raise_error(F.lit("boom")).cast("int"))
    try:
        sinks.publish(spark, store, {"one": good, "two": bad})
    except Exception:
        pass
    assert sinks.read_table(spark, store, "one") is None and sinks.read_table(spark, store, "two") is None


def test_audit_appends_and_export_nests(spark, tmp_path):
    for n in (1, 2):
        sinks.append_audit(spark, str(tmp_path / "audit"), "run", {"n": n})
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2
    chosen = spark.createDataFrame(
        [(1, "Acme", "won", 80.0, "DE", "toys", 7, "sent", "2001-01-01", "won", 12.5)],
        "lead int, company string, status string, quality double, best_country string, best_category string, last_campaign int,"
        " campaign_status string, campaign_on string, stage string, estimated_value double",
    )
    sinks.export_json(leads.nested_export(chosen), str(tmp_path / "crm"))
    line = json.loads(spark.read.text(str(tmp_path / "crm")).first()[0])
    assert line["lastCampaign"]["id"] == 7 and line["pipeline"]["estimatedValue"] == 12.5


def test_list_scan_filters_hold_and_limit_bounds(spark):
    df = spark.range(100).withColumn("s", F.col("id") % 10)
    out = list_scan(df, {"a": optional("s", ">=", 5), "b": optional("s", "=", None)}, [F.desc("id")], 7, 2)
    got = [r["id"] for r in out.collect()]
    assert len(got) == 7 and all(i % 10 >= 5 for i in got) and got == sorted(got, reverse=True)
    assert list_scan(df, {"a": optional("s", ">=", 0)}, [F.asc("id")]).count() == 100
    assert list_scan(df, {"pct": optional("s", ">=", 500, 0.01)}, [F.asc("id")]).count() == 50


def test_trade_feed_rules(spark):
    docs = [
        ('{"refYear":1999,"refMonth":2,"cmdCode":"HS 2106.90","primaryValue":10.0,"netWgt":4.0}',),
        ('{"period":199903,"cmdCode":"3304","primaryValue":-1.0,"netWgt":0}',),
        ('{"period":202203,"cmdCode":"3304","primaryValue":5.0}',),
        ("not json",),
    ]
    got = feeds.trade_rows(spark.createDataFrame(docs, "payload string")).orderBy("ym").collect()
    assert [(r["ym"], r["chapter"], r["trade_value"], r["unit_value"]) for r in got] == [(199902, "2106", 10.0, 2.5), (199903, "33", None, None)]
