"""Streaming jobs: engagement state, on-arrival classification, replay-safe ingest, running aggregates.

Each job is a transformation of a streaming frame; ``run_available`` drives one over all waiting
files and returns what it wrote. State and output live in the shared stage folder, so a restarted
query resumes from its checkpoint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradewind.functions import text
from tradewind.operators import merge
from tradewind.operators.pages import classify_records
from tradewind.sources import views
from tradewind.sources.stages import stage_root
from tradewind.sources.tables import Tables


def read_stream(t: Tables, name: str, max_files: int | None = None) -> DataFrame:
    """File-source stream over a table; a new file is a new micro-batch input."""
    reader = t.spark.readStream.schema(t.read(name).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{t.path}/{name}*.parquet")


def run_available(df: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run over everything available and return the result table.

    Append output goes straight to files. Update output is written per batch with its number, and
    the newest row per key counts; rewriting a batch after a failure replaces it, so a replay
    changes nothing.
    """
    spark = df.sparkSession
    root = f"{stage_root(spark)}/tradewind-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{root}/out").start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{root}/out")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    writer.foreachBatch(write).start().awaitTermination()
    rows = spark.read.schema(df.schema.add("batch", "long")).parquet(f"{root}/out")
    return merge.latest(rows, keys, ["batch"]).drop("batch")


def daily_aggregate(events: DataFrame) -> DataFrame:
    """Running count and value per day and kind, with a one-day watermark.

    Windows are cut at UTC midnight; the calendar day of the session zone is a key of its own, so
    outside UTC a day may come in two parts that add up.
    """
    return (
        events.withWatermark("ts", "1 day")
        .groupBy(F.window("ts", "1 day"), F.to_date("ts").alias("day"), "event_type")
        .agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
        .select(F.col("window.start").alias("window_start"), "day", "event_type", "n", "cents")
    )


def deduplicated(events: DataFrame) -> DataFrame:
    """First arrival per event id; a replay within a day of event time is dropped."""
    return events.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")


def recent(events: DataFrame, as_of: str, hours: int = 2) -> DataFrame:
    """Signals captured in the last hours, to be queued for classification."""
    end = F.lit(as_of).cast("timestamp")
    return events.filter((F.col("ts") >= end - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts") <= end)).select("event_id", "event_type")


def classified(records: DataFrame) -> DataFrame:
    """Classification on arrival and where the record goes next."""
    out = classify_records(records, "p_partkey", F.col("content"))
    route = F.when(F.col("needs_fallback"), "fallback").when(F.col("needs_review"), "review").otherwise("accepted")
    return out.select("p_partkey", "node", "confidence", route.alias("route"))


def engagement_state(events: DataFrame, replies: DataFrame) -> DataFrame:
    """Campaign times, lead status and pipeline stage per lead; the latest event time decides.

    ``replies`` is a static table of (lead, text) with one row per lead.
    """
    kind, at = F.col("kind"), F.struct("ts", "event_id")
    sentiment = text.sentiment(F.col("text"))
    status = (
        F.when((kind == "bounced") & F.col("hard"), "invalid")
        .when(kind == "complained", "lost")
        .when((kind == "replied") & (sentiment == "negative"), "lost")
        .when(kind == "replied", "replied")
    )
    last = lambda name: F.max(F.when(kind == name, F.col("ts"))).alias(f"{name}_at")
    joined = views.engagement(events).join(replies, "lead", "left").withColumn("status", status).withColumn("sentiment", sentiment)
    latest = lambda value, test: F.max_by(value, F.when(test, at))
    state = joined.groupBy("lead").agg(
        last("opened"), last("clicked"), last("bounced"), last("replied"),
        latest(F.col("status"), F.col("status").isNotNull()).alias("status"),
        latest(F.col("sentiment"), kind == "replied").alias("sentiment"),
        F.count("*").alias("events"),
    )
    positive = F.col("sentiment") == "positive"
    return state.withColumn("stage", F.when(positive, "qualified").when(F.col("sentiment").isNotNull(), "engaged")).withColumn(
        "probability", F.when(positive, 40).when(F.col("sentiment").isNotNull(), 15)
    )


def reply_texts(conversations: DataFrame) -> DataFrame:
    """The latest user turn of each conversation as the reply of the lead with that number."""
    said = conversations.filter((F.col("role") == "user") & F.col("text").isNotNull())
    return said.groupBy(F.col("conv_id").alias("lead")).agg(F.max_by("text", F.struct("turn", "text")).alias("text"))


def events_stream(t: Tables) -> DataFrame:
    return read_stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def ingest_signals(spark: SparkSession, batch: DataFrame, store: str) -> None:
    """Sink of the replay-safe ingest: insert what the table does not have yet."""
    from tradewind import sinks

    sinks.insert_table(spark, store, "signals", batch, ["event_id"])
