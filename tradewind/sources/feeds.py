"""Readers of feed payloads: statistics rows, JSON-stat cubes, timelines and candidate lists.

Payloads arrive as JSON text, one document per row, and are parsed by typed ``from_json``; a document
of the wrong shape becomes NULL and drops out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradewind.functions.numeric import half_up, ratio
from tradewind.sources import dims

STAT_ROW = "refYear int, refMonth int, period int, cmdCode string, primaryValue double, netWgt double"
CUBE = "geo map<string,int>, time map<string,int>, value map<string,double>"
TIMELINE = "keywords array<string>, points array<struct<time: bigint, value: array<double>, isPartial: boolean>>"
CANDIDATE = "companyName string, websiteUrl string, isDistributor boolean, countryCode string"


def positive(value: Column) -> Column:
    return F.when(value > 0, value)


def chapter(code: Column) -> Column:
    """Digits only; the 2106 prefix stands alone, otherwise the first two digits."""
    digits = F.regexp_replace(code, r"\D", "")
    return F.when(digits.startswith("2106"), "2106").otherwise(F.substring(digits, 1, 2))


def chapter_category(chapter_code: Column) -> Column:
    table = F.create_map(*[x for k, v in dims.CHAPTER_CATEGORY.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, chapter_code)


def trade_rows(feed: DataFrame, payload: str = "payload") -> DataFrame:
    """Annual or monthly statistics rows of all feeds in one pass: month from period or year and month, cleaned code, unit value.

    Rows keep the columns beside the payload, such as the name of their feed.
    """
    r = F.from_json(payload, STAT_ROW)
    return (
        feed.withColumn("r", r)
        .filter("r IS NOT NULL")
        .select(
            *[c for c in feed.columns if c != payload],
            F.coalesce("r.period", F.col("r.refYear") * 100 + F.col("r.refMonth")).alias("ym"),
            chapter(F.col("r.cmdCode")).alias("chapter"),
            positive(F.col("r.primaryValue")).alias("trade_value"),
            positive(F.col("r.netWgt")).alias("net_weight"),
        )
        .withColumn("category", chapter_category(F.col("chapter")))
        .withColumn("unit_value", half_up(ratio(F.col("trade_value"), F.col("net_weight"))))
        .filter(F.col("ym").between(*dims.MONTH_RANGE))
    )


def cube_cells(cubes: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """Cells of a geo x time cube by flat index geo * nTime + time, for every value present."""
    c = F.from_json(payload, CUBE)
    n_time = F.size("c.time")
    return (
        cubes.withColumn("c", c)
        .filter("c.value IS NOT NULL")
        .select(*keys, "c", n_time.alias("n_time"), F.explode("c.value").alias("cell", "value"))
        .withColumn("cell", F.col("cell").cast("int"))
        .select(
            *keys,
            _key_of(F.col("c.geo"), F.floor(F.col("cell") / F.col("n_time")).cast("int")).alias("geo"),
            _key_of(F.col("c.time"), (F.col("cell") % F.col("n_time")).cast("int")).alias("time"),
            "value",
        )
    )


def _key_of(index: Column, position: Column) -> Column:
    inverse = F.map_from_arrays(F.map_values(index), F.map_keys(index))
    return F.try_element_at(inverse, position)


def time_totals(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over geographies per time position, thousands of EUR as USD."""
    return cells.groupBy(*keys, "time").agg((F.sum("value") * 1000.0 * dims.USD_PER_EUR).alias("usd"))


def timeline_points(timelines: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """(day, keyword, value, partial) of every point of a timeline; a missing value is 0."""
    return (
        timelines.withColumn("t", F.from_json(payload, TIMELINE))
        .filter("t IS NOT NULL")
        .select(*keys, "t.keywords", F.explode("t.points").alias("p"))
        .select(*keys, "p", F.posexplode("keywords").alias("pos", "keyword"))
        .select(
            *keys,
            F.to_date(F.timestamp_seconds("p.time")).alias("day"),
            "keyword",
            F.coalesce(F.get("p.value", F.col("pos")), F.lit(0.0)).alias("value"),
            F.coalesce("p.isPartial", F.lit(False)).alias("is_partial"),
        )
    )


def candidates(audits: DataFrame, payload: str = "payload") -> DataFrame:
    """Candidates listed in audit rows; a payload that is not an array is skipped."""
    listed = F.when(F.trim(payload).startswith("["), F.from_json(payload, f"array<struct<{_typed(CANDIDATE)}>>"))
    return audits.withColumn("c", F.explode(listed)).select(*[c for c in audits.columns if c != payload], "c.*")


def _typed(ddl: str) -> str:
    return ", ".join(": ".join(part.split()) for part in ddl.split(", "))
