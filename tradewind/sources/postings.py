"""Postings of an array column: which rows hold a value, so that "holds all" and "holds any" read only the values asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS, SPREAD = 64, 16


def _bucket(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


def write(rows: DataFrame, key: str, values: str, path: str) -> None:
    """(value, key), once each, in one folder a bucket of values. Files are sorted by value; a frequent value is spread over several."""
    pairs = rows.select(F.explode(F.array_distinct(values)).alias("value"), F.col(key).alias("key")).filter("value is not null").distinct()
    dealt = pairs.withColumn("bucket", _bucket(F.col("value"))).repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(SPREAD)))
    dealt.sortWithinPartitions("bucket", "value").write.mode("error").partitionBy("bucket").parquet(path)


def keys_holding(path: str, rows: DataFrame, wanted: list[str], every: bool) -> DataFrame:
    """Keys that hold all or any of the wanted values; only their buckets, and in them only their row groups, are read."""
    different = sorted(set(wanted))
    schema = f"value string, key {rows.schema[0].dataType.simpleString()}, bucket int"
    hits = rows.sparkSession.read.schema(schema).parquet(path).filter(F.col("bucket").isin([_bucket(F.lit(v)) for v in different]) & F.col("value").isin(different))
    if every:
        return hits.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") == len(different)).select("key")
    return hits.select("key")


def holding(rows: DataFrame, path: str, key: str, wanted: list[str], every: bool) -> DataFrame:
    """The rows whose array holds all (``every``) or any of the wanted values. All of no values is every row, any of none is no row."""
    if not wanted:
        return rows if every else rows.limit(0)
    keys = keys_holding(path, rows.select(key), wanted, every)
    return rows.join(keys.withColumnRenamed("key", key), key, "left_semi")
