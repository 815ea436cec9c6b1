import pytest
from pyspark.sql import functions as F

from tradewind import sinks

SCHEMA = "k int, g string, v int"


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    base = spark.createDataFrame([(i, "a", 0) for i in range(200)], SCHEMA)
    sinks.upsert_table(spark, path, "t", base, ["k"], buckets=16)
    return path


def keys_of_bucket(spark, number, buckets=16):
    return [r["k"] for r in spark.range(200).select(F.col("id").cast("int").alias("k")).filter(sinks.bucket_of(["k"], buckets) == number).collect()]


def test_upsert_rewrites_touched_buckets_only(spark, store):
    before = sinks.snapshot(spark, store).tables["t"]["files"]
    some = keys_of_bucket(spark, 3)[:2]
    sinks.upsert_table(spark, store, "t", spark.createDataFrame([(k, "b", 9) for k in some], SCHEMA), ["k"])
    after = sinks.snapshot(spark, store).tables["t"]["files"]
    assert {b for b in before if before[b] != after[b]} == {"3"} and len(before) == 16
    assert rows(sinks.read_table(spark, store, "t")) == sorted([(i, "b", 9) if i in some else (i, "a", 0) for i in range(200)], key=str)


def test_upsert_twice_equals_once_and_history_stays(spark, store):
    delta = spark.createDataFrame([(5, "x", 1), (5, "y", 2), (900, "n", 1)], SCHEMA)
    first = sinks.upsert_table(spark, store, "t", delta, ["k"], ["v"])
    once = rows(sinks.read_table(spark, store, "t"))
    sinks.upsert_table(spark, store, "t", delta, ["k"], ["v"])
    assert rows(sinks.read_table(spark, store, "t")) == once and (5, "y", 2) in once and len(once) == 201
    assert sinks.read_table(spark, store, "t", first - 1).count() == 200


def test_undefined_duplicates_have_one_winner(spark, store):
    delta = spark.createDataFrame([(700, "a", 1), (700, "c", 1), (700, "b", 7)], SCHEMA)
    sinks.insert_table(spark, store, "t", delta, ["k"])
    assert sinks.read_table(spark, store, "t").filter("k = 700").first()["g"] == "c"


def interleaved(spark, store, monkeypatch, first_keys, second_keys):
    """Upserts ``first_keys``; between its reading and its commit another writer upserts ``second_keys``."""
    plain, done = sinks.commit, []

    def commit(*args):
        if not done:
            done.append(True)
            sinks.upsert_table(spark, store, "t", spark.createDataFrame([(k, "second", 2) for k in second_keys], SCHEMA), ["k"])
        return plain(*args)

    monkeypatch.setattr(sinks, "commit", commit)
    sinks.upsert_table(spark, store, "t", spark.createDataFrame([(k, "first", 1) for k in first_keys], SCHEMA), ["k"])
    monkeypatch.undo()
    return {r["k"]: r["g"] for r in sinks.read_table(spark, store, "t").collect()}


def test_interleaved_writers_on_other_buckets_both_stay(spark, store, monkeypatch):
    one, two = keys_of_bucket(spark, 1)[0], keys_of_bucket(spark, 2)[0]
    start = sinks.snapshot(spark, store).number
    got = interleaved(spark, store, monkeypatch, [one], [two])
    assert (got[one], got[two], len(got)) == ("first", "second", 200) and sinks.snapshot(spark, store).number == start + 2


def test_interleaved_writers_on_one_bucket_come_one_after_the_other(spark, store, monkeypatch):
    one, two, both = keys_of_bucket(spark, 1)[:3]
    got = interleaved(spark, store, monkeypatch, [one, both], [two, both])
    assert (got[one], got[two], got[both], len(got)) == ("first", "second", "first", 200)


def test_stale_publication_is_refused_whole(spark, store):
    read = sinks.snapshot(spark, store)
    one = spark.createDataFrame([(1, "p", 1)], SCHEMA)
    sinks.publish(spark, store, {"a": one}, read)
    with pytest.raises(sinks.Conflict):
        sinks.publish(spark, store, {"a": one, "b": one}, read)
    assert sinks.read_table(spark, store, "b") is None
    sinks.publish(spark, store, {"b": one}, read)
    assert {*sinks.snapshot(spark, store).tables} == {"t", "a", "b"}


def test_grains_share_a_bucket_and_are_updated_apart(spark, tmp_path):
    store, schema = str(tmp_path / "grains"), "brand string, c string, v int"
    sinks.upsert_grain_table(spark, store, "s", spark.createDataFrame([(None, "x", 1), ("b", "x", 2)], schema), "brand", ["c"])
    sinks.upsert_grain_table(spark, store, "s", spark.createDataFrame([(None, "x", 7), ("n", "x", 3), ("n", "x", 4)], schema), "brand", ["c"])
    assert {r["brand"]: r["v"] for r in sinks.read_table(spark, store, "s").collect()} == {None: 7, "b": 2, "n": 4}


def test_audit_is_read_by_run_and_export_keeps_absent_parts(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    for n in (1, 2):
        sinks.append_summary(spark.createDataFrame([(n, "s")], "n int, label string"), log, f"run{n}")
    assert rows(sinks.read_audit(spark, log, "run2", "n int, label string")) == [(2, "s")]
    nested = spark.createDataFrame([(1, "won", (7, None)), (2, "lost", None)], "id int, status string, last struct<id: int, at: string>")
    sinks.export_json(nested, out, ["status"])
    assert rows(sinks.read_export(spark, out, nested.schema)) == rows(nested)
