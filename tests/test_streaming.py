from datetime import datetime, timedelta

from tradewind.sources.tables import Tables
from tradewind.streaming import jobs

T0 = datetime(2024, 1, 1)


def write_events(spark, path, ids):
    rows = [(i, T0 + timedelta(minutes=10 * i), i % 3, ["view", "click", "purchase", "error"][i % 4], float(i), '{"k": %d}' % i) for i in ids]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(path)


def test_running_aggregate_over_several_batches_equals_batch(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    write_events(spark, path, range(0, 60))
    write_events(spark, path, range(60, 120))
    t = Tables(spark, str(tmp_path))
    stream = jobs.read_stream(t, "events", max_files=1)
    got = jobs.run_available(jobs.daily_aggregate(stream), "update", ["window_start", "day", "event_type"])
    batch = jobs.daily_aggregate(t.read("events"))
    key = lambda r: (str(r["day"]), r["event_type"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
    assert len({key(r) for r in got.collect()}) == got.count()


def test_replayed_events_come_out_once(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    write_events(spark, path, range(40))
    write_events(spark, path, range(40))
    t = Tables(spark, str(tmp_path))
    assert jobs.run_available(jobs.deduplicated(jobs.read_stream(t, "events", max_files=1))).count() == 40


def test_latest_event_decides_the_state(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    write_events(spark, path, range(24))
    t = Tables(spark, str(tmp_path))
    replies = spark.createDataFrame([(0, "Sounds good, schedule a call"), (1, "please unsubscribe me")], "lead long, text string")
    rows = {r["lead"]: r for r in jobs.run_available(jobs.engagement_state(jobs.read_stream(t, "events"), replies), "update", ["lead"]).collect()}
    # Of the purchases (2, 6, 10, 14, 18, 22) lead 0 has 6 and 18, lead 1 has 10 and 22, lead 2 has 2 and 14.
    assert (rows[0]["stage"], rows[0]["probability"]) == ("qualified", 40)
    assert (rows[1]["status"], rows[1]["stage"]) == ("lost", "engaged")
    assert rows[2]["sentiment"] == "neutral" and rows[0]["events"] == 8
    assert sorted(rows) == [0, 1, 2]
