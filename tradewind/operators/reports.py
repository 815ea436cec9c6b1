"""Report sections as rows of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tradewind.functions.numeric import half_up
from tradewind.sources import dims


def _ranked(df: DataFrame, section: str, score: str, line, k: int) -> DataFrame:
    """Top-k lines of a section; the limit comes first, so the numbering window sees k rows."""
    order = [F.desc(score), F.asc("country"), F.asc("category")]
    top = df.orderBy(*order).limit(k)
    return top.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("position"), line.alias("line"))


def _single(df: DataFrame, section: str, line) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.lit(1).alias("position"), line.alias("line"))


def weekly(corridor_scores: DataFrame, active_trends: DataFrame, leads: DataFrame, as_of: str = dims.AS_OF) -> DataFrame:
    """Top corridors, breakthrough trends and lead counts of the week."""
    counts = leads.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "qualified").alias("q"))
    one = lambda c: half_up(c, 1)  # rounded here, so the text never depends on a formatter's tie rule
    corridor_line = F.format_string("%s x %s: composite %.1f", F.col("category"), F.col("country"), one(F.col("composite_score")))
    trend_line = F.format_string("%s x %s (+%.1f%%)", F.col("category"), F.col("country"), one(F.col("growth") * 100))
    day = F.lit(as_of).cast("date")
    title = F.format_string("Weekly digest: week %d, %d", F.weekofyear(day), F.year(day))
    return (
        _ranked(corridor_scores, "top_corridor", "composite_score", corridor_line, 5)
        .unionByName(_ranked(active_trends.filter("tier = 'breakthrough'"), "breakthrough", "growth", trend_line, 5))
        .unionByName(_single(counts, "leads", F.format_string("Total leads: %d", "n")))
        .unionByName(_single(counts, "qualified", F.format_string("Qualified leads: %d", "q")))
        .unionByName(_single(counts, "title", title))
    )


def monthly(corridor_scores: DataFrame, active_trends: DataFrame, leads: DataFrame, as_of: str = dims.AS_OF) -> DataFrame:
    """Top ten corridors with their parts, lead totals and the number of active trends."""
    one = lambda c: half_up(F.col(c), 1)
    line = F.format_string(
        "%s x %s: composite %.1f (category %.1f, routing %.1f)", F.col("category"), F.col("country"), one("composite_score"), one("category_score"), one("ni_score")
    )
    counts = leads.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "qualified").alias("q"))
    day = F.lit(as_of).cast("date")
    return (
        _ranked(corridor_scores, "top_corridor", "composite_score", line, 10)
        .unionByName(_single(counts, "leads", F.format_string("Total leads: %d", "n")))
        .unionByName(_single(counts, "qualified", F.format_string("Qualified leads: %d", "q")))
        .unionByName(_single(active_trends.agg(F.count("*").alias("n")), "trends", F.format_string("Trends detected: %d", "n")))
        .unionByName(_single(counts, "title", F.concat(F.lit("Monthly market brief: "), F.date_format(day, "MMMM yyyy"))))
    )
