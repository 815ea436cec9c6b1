"""Queries: streaming jobs run over all available input, each checked against batch SQL on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradewind.plans.registry import query
from tradewind.plans.text import SENTIMENT_SQL, records
from tradewind.sources import dims
from tradewind.sources.tables import Tables
from tradewind.streaming import jobs


@query("stream_agg", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2""")
def stream_agg(t: Tables) -> DataFrame:
    parts = jobs.run_available(jobs.daily_aggregate(jobs.events_stream(t)), "update", ["window_start", "day", "event_type"])
    return parts.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))


@query("stream_dedup", "SELECT DISTINCT event_id, event_type FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    """The event stream delivered twice; every event must come out once."""
    twice = jobs.events_stream(t).unionByName(jobs.events_stream(t))
    return jobs.run_available(jobs.deduplicated(twice))


@query("stream_recent", "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-30 22:00:00' AND ts <= TIMESTAMP '2024-01-31'")
def stream_recent(t: Tables) -> DataFrame:
    return jobs.run_available(jobs.recent(jobs.events_stream(t), dims.EVENTS_AS_OF))


@query("stream_classify", """
SELECT p_partkey, node, confidence, CASE WHEN needs_fallback THEN 'fallback' WHEN needs_review THEN 'review' ELSE 'accepted' END AS route FROM v_classified""")
def stream_classify(t: Tables) -> DataFrame:
    parts = jobs.read_stream(t, "part")
    return jobs.run_available(jobs.classified(records(t, parts)))


@query("stream_engagement", f"""
SELECT lead, strftime(opened_at, '%Y-%m-%d %H:%M:%S') AS opened_at, strftime(clicked_at, '%Y-%m-%d %H:%M:%S') AS clicked_at, strftime(bounced_at, '%Y-%m-%d %H:%M:%S') AS bounced_at, strftime(replied_at, '%Y-%m-%d %H:%M:%S') AS replied_at,
 status, sentiment, events, CASE WHEN sentiment = 'positive' THEN 'qualified' WHEN sentiment IS NOT NULL THEN 'engaged' END AS stage, CASE WHEN sentiment = 'positive' THEN 40 WHEN sentiment IS NOT NULL THEN 15 END AS probability
FROM (SELECT lead, max(ts) FILTER (WHERE kind = 'opened') AS opened_at, max(ts) FILTER (WHERE kind = 'clicked') AS clicked_at, max(ts) FILTER (WHERE kind = 'bounced') AS bounced_at, max(ts) FILTER (WHERE kind = 'replied') AS replied_at,
  arg_max(st, (ts, event_id)) FILTER (WHERE st IS NOT NULL) AS status, arg_max(sentiment, (ts, event_id)) FILTER (WHERE kind = 'replied') AS sentiment, count(*) AS events
 FROM (SELECT *, CASE WHEN kind = 'bounced' AND hard THEN 'invalid' WHEN kind = 'complained' THEN 'lost' WHEN kind = 'replied' AND sentiment = 'negative' THEN 'lost' WHEN kind = 'replied' THEN 'replied' END AS st FROM (
  SELECT e.*, {SENTIMENT_SQL} AS sentiment FROM v_engagement e LEFT JOIN (SELECT conv_id, arg_max(text, (turn, text)) AS text FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY 1) c ON c.conv_id = e.lead)) GROUP BY 1)""")
def stream_engagement(t: Tables) -> DataFrame:
    state = jobs.engagement_state(jobs.events_stream(t), jobs.reply_texts(t.read("conversations")))
    rows = jobs.run_available(state, "update", ["lead"])
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("opened_at", "clicked_at", "bounced_at", "replied_at")})
