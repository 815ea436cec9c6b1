"""Search-interest operators over (key, day, keyword, value, is_partial) points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tradewind.functions.numeric import half_up


def daily_mean(points: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over keywords per day, partial points left out."""
    return points.filter(~F.col("is_partial")).groupBy(*keys, "day").agg(half_up(F.avg("value")).alias("value"))


def keyword_scores(points: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, last minus first, rank and winner per keyword. Points are reduced per keyword before ranking."""
    v = F.col("value")
    stats = points.filter(~F.col("is_partial")).groupBy(*keys, "keyword").agg(
        half_up(F.avg(v)).alias("avg_interest"), (F.max_by(v, "day") - F.min_by(v, "day")).alias("change")
    )
    w = Window.partitionBy(*keys).orderBy(F.desc("avg_interest"), "keyword")
    return (
        stats.withColumn("position", F.row_number().over(w))
        .withColumn("is_winner", F.col("position") == 1)
        .withColumn("is_accelerating", F.col("change") > 0)
    )


def breakouts(points: DataFrame, keys: list[str]) -> DataFrame:
    """Keywords whose last value exceeds 1.5 times the mean of the four before; five points needed."""
    w = Window.partitionBy(*keys, "keyword").orderBy("day")
    whole = points.filter(~F.col("is_partial"))
    return (
        whole.withColumn("before", F.avg("value").over(w.rowsBetween(-4, -1)))
        .withColumn("n", F.row_number().over(w))
        .groupBy(*keys, "keyword")
        .agg(F.max_by(F.struct("value", "before", "n"), "day").alias("l"))
        .select(*keys, "keyword", F.col("l.value").alias("last_value"), half_up(F.col("l.before")).alias("mean_before"),
                F.coalesce((F.col("l.n") >= 5) & (F.col("l.before") > 0) & (F.col("l.value") > F.col("l.before") * 1.5), F.lit(False)).alias("breakout"))
    )


def emerging_terms(queries: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """First k distinct rising queries of plausible length, in order of appearance."""
    fine = queries.filter((F.length("query") > 2) & (F.length("query") < 50))
    first = fine.groupBy(*keys, "query").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy(*keys).orderBy("pos", "query")
    top = first.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rn", "query"))), lambda s: s["query"])
    return top.groupBy(*keys).agg(F.array_join(ordered, ",").alias("terms"))


def signal_terms(queries: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """(keys, terms) as an array: what a run stores for the next one."""
    return emerging_terms(queries, keys, k).withColumn("terms", F.split("terms", ","))


def dynamic_keywords(signals: DataFrame, keys: list[str], as_of: str, recent: int = 16, per: int = 2, days: int = 30) -> DataFrame:
    """(keys, category, keyword, place): rising terms that earlier runs stored and that join today's keywords.

    ``signals`` (keys, category, captured_on, terms) are the stored runs. Those older than ``days`` have expired; of the rest
    the newest ``recent`` of each key count, and each category takes its first ``per`` different terms, newest first.
    """
    alive = signals.filter(F.col("captured_on") >= F.date_sub(F.lit(as_of).cast("date"), days))
    newest = Window.partitionBy(*keys).orderBy(F.desc("captured_on"), "category")
    ranked = alive.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= recent)
    terms = ranked.select(*keys, "category", "age", F.posexplode("terms").alias("pos", "keyword"))
    first = terms.groupBy(*keys, "category", "keyword").agg(F.min(F.struct("age", "pos")).alias("at"))
    place = F.row_number().over(Window.partitionBy(*keys, "category").orderBy("at", "keyword"))
    return first.withColumn("place", place).filter(F.col("place") <= per).select(*keys, "category", "keyword", "place")


def keywords_of_day(base: DataFrame, dynamic: DataFrame, keys: list[str]) -> DataFrame:
    """The fixed keywords (keys, category, keyword) and behind them the dynamic ones that are not among them."""
    fixed = base.select(*keys, "category", "keyword", F.lit(0).alias("place"))
    return fixed.unionByName(dynamic.join(fixed.select(*keys, "category", "keyword"), [*keys, "category", "keyword"], "left_anti"))
