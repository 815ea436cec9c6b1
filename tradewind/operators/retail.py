"""Retail activity patterns and their correlation with trade, shows and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradewind.functions.numeric import half_up
from tradewind.sources import dims

CORRIDOR = ["country", "category"]


def _groups(rows: DataFrame) -> DataFrame:
    """Retailers, activity and date range per corridor; the two-step distinct count splits hot corridors."""
    return (
        rows.groupBy(*CORRIDOR, "retailer")
        .agg(F.count("*").alias("n"), F.min("detected_at").alias("first"), F.max("detected_at").alias("last"))
        .groupBy(*CORRIDOR)
        .agg(
            F.count("*").alias("retailers"),
            F.sum("n").alias("activities"),
            F.min("first").alias("first_at"),
            F.max("last").alias("last_at"),
        )
        .filter("retailers >= 2")
    )


def _pattern(groups: DataFrame, name: str, confidence: Column) -> DataFrame:
    return groups.select(
        *CORRIDOR,
        F.lit(name).alias("pattern"),
        "retailers",
        "activities",
        F.date_format("first_at", "yyyy-MM-dd").alias("first_on"),
        F.date_format("last_at", "yyyy-MM-dd").alias("last_on"),
        half_up(confidence).alias("confidence"),
    )


def expansion(activity: DataFrame, as_of: str = dims.AS_OF) -> DataFrame:
    rows = activity.filter(F.col("kind").isin("new_listing", "category_expansion"))
    days = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_at")) / 86400.0
    recency = F.greatest(F.lit(0.0), (30.0 - days) / 30.0)
    score = F.least(0.5 + (F.col("retailers") - 2) * 0.1 + recency * 0.2, F.lit(1.0))
    return _pattern(_groups(rows), "expansion", score)


def rotation(activity: DataFrame) -> DataFrame:
    rows = activity.filter("kind = 'seasonal_rotation'")
    return _pattern(_groups(rows), "rotation", F.least(0.4 + (F.col("retailers") - 2) * 0.08, F.lit(0.85)))


US_SUFFIX = r"(?i)\b(inc|llc|corp|co\.|company|brands|foods|nutrition|wellness)\b"
EU_SUFFIX = r"(?i)\b(gmbh|bv|sarl|srl|ltd|plc|ag|nv|oy|as|ab)\b"


def is_foreign(details: Column, known: Column) -> Column:
    """Origin test: country field, known name, or corporate suffix without a local one."""
    name = brand_name(details)
    country = F.upper(F.get_json_object(details, "$.brandCountry"))
    by_suffix = name.rlike(US_SUFFIX) & ~name.rlike(EU_SUFFIX)
    return F.coalesce(country == "US", F.lit(False)) | F.coalesce(known, F.lit(False)) | F.coalesce(by_suffix, F.lit(False))


def brand_name(details: Column) -> Column:
    """First of the three keys that is present."""
    return F.trim(F.coalesce(*[F.get_json_object(details, f"$.{k}") for k in ("brandName", "brand", "name")]))


def with_details(activity: DataFrame) -> DataFrame:
    """The JSON details an event carries: brand label and, for one seller region, its country."""
    line = F.split("id", "-").getItem(1).cast("int")
    label = F.when(line % 4 == 1, F.concat("brand", F.lit(" Inc"))).when(line % 4 == 2, F.concat("brand", F.lit(" Foods GmbH"))).otherwise(F.col("brand"))
    return activity.withColumn(
        "details",
        F.to_json(F.struct(F.when(F.col("reporter") == "AMERICA", F.lit("us")).alias("brandCountry"), label.alias("brandName"))),
    )


def foreign_events(activity: DataFrame, known_brands: DataFrame) -> DataFrame:
    """New listings of foreign brands; ``known_brands`` holds distinct lower-case ``name`` values."""
    rows = with_details(activity.filter("kind = 'new_listing'"))
    flagged = known_brands.withColumn("known", F.lit(True))
    return rows.join(flagged, F.lower(brand_name(F.col("details"))) == F.col("name"), "left").filter(
        is_foreign(F.col("details"), F.col("known"))
    )


def foreign_entry(events: DataFrame) -> DataFrame:
    return _pattern(_groups(events), "foreign_entry", F.least(0.55 + (F.col("retailers") - 2) * 0.1, F.lit(0.90)))


def evidence(rows: DataFrame, insights: DataFrame) -> DataFrame:
    """Events behind each insight, as rows: the list of a busy corridor is never gathered in one place."""
    return insights.select(*CORRIDOR, "pattern").join(rows.select(*CORRIDOR, "id"), CORRIDOR)


def sample_names(rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    """First k distinct names of each corridor in order; tasks pre-select k rows per group before the shuffle."""
    w = Window.partitionBy(*CORRIDOR).orderBy(column)
    return (
        rows.select(*CORRIDOR, column)
        .distinct()
        .withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= k)
        .groupBy(*CORRIDOR)
        .agg(F.array_join(F.sort_array(F.collect_list(column)), ", ").alias("names"))
    )


def order_months(lines: DataFrame) -> DataFrame:
    """Retail activity of a corridor per month."""
    ym = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    return lines.groupBy(F.col("partner").alias("country"), "category", ym.alias("ym")).agg(F.count("*").alias("n"))


def month_diff(start: Column, end: Column) -> Column:
    months = lambda ym: F.floor(ym / 100) * 12 + ym % 100
    return (months(end) - months(start)).cast("int")


def dashed(ym: Column) -> Column:
    text = ym.cast("string")
    return F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2))


def lead_lag(retail_months: DataFrame, trade_months: DataFrame) -> DataFrame:
    """Months between the peaks of retail activity and trade; the earlier of equal peaks counts."""
    peak = lambda value: F.max_by("ym", F.struct(F.col(value), -F.col("ym")))
    retail = retail_months.groupBy(*CORRIDOR).agg(peak("n").alias("retail_peak"), F.sum("n").alias("activities"))
    totals = (
        trade_months.filter("flow = 'us_to_eu'")
        .groupBy(F.col("partner").alias("country"), "category", "ym")
        .agg(F.sum("cents").alias("c"))
    )
    trade = totals.groupBy(*CORRIDOR).agg(peak("c").alias("trade_peak"), F.count("*").alias("months"))
    lag = F.col("lag_months")
    return (
        retail.filter("activities >= 3")
        .join(trade.filter("months >= 3"), CORRIDOR)
        .withColumn("lag_months", month_diff(F.col("retail_peak"), F.col("trade_peak")))
        .select(
            *CORRIDOR,
            "lag_months",
            (lag > 0).alias("leads_trade"),
            "activities",
            dashed(F.col("retail_peak")).alias("retail_peak"),
            dashed(F.col("trade_peak")).alias("trade_peak"),
            F.when(F.abs(lag) >= 2, "high").when(F.abs(lag) == 1, "medium").otherwise("low").alias("confidence"),
        )
    )


def show_categories(shows: DataFrame, keywords: DataFrame) -> DataFrame:
    """(show, category) pairs whose label contains a keyword of the category; keywords are a fixed list."""
    labels = shows.select("show_id", F.explode("labels").alias("label"))
    return (
        labels.join(F.broadcast(keywords), F.lower("label").contains(F.col("keyword")))
        .groupBy("show_id", "category")
        .agg(F.array_join(F.sort_array(F.collect_set("label")), ", ").alias("overlap"))
    )


def days_until(start: Column, as_of: str = dims.AS_OF) -> Column:
    seconds = F.unix_timestamp(start.cast("timestamp")) - F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    return F.greatest(F.lit(0), F.floor(seconds / 86400.0 + 0.5).cast("int"))


def show_targets(shows: DataFrame, exhibitors: DataFrame, keywords: DataFrame, as_of: str = dims.AS_OF) -> DataFrame:
    counts = exhibitors.groupBy("show_id").agg(F.count("*").alias("exhibitors"))
    days = F.col("days_until")
    return (
        shows.filter(F.col("start_on") >= F.lit(as_of).cast("date"))
        .join(show_categories(shows, keywords), "show_id")
        .join(counts, "show_id", "left")
        .withColumn("days_until", days_until(F.col("start_on"), as_of))
        .select(
            "category",
            "show_id",
            "show_name",
            "country",
            "days_until",
            F.when(days <= 60, "high").when(days <= 180, "medium").otherwise("low").alias("urgency"),
            "overlap",
            F.coalesce("exhibitors", F.lit(0)).alias("exhibitors"),
        )
    )


def coverage_density(corridor_growth: DataFrame, distributors: DataFrame, categories: DataFrame, keywords: DataFrame) -> DataFrame:
    """Distributors of a corridor by keyword match, and the score for brokering new ones there."""
    labels = (
        categories.select(F.col("category").alias("label")).distinct()
        .join(F.broadcast(keywords), F.lower("label").contains(F.col("keyword")))
        .select("label", "category").distinct()
    )
    counts = (
        distributors.select("suppkey", "country")
        .join(categories.withColumnRenamed("category", "label"), "suppkey")
        .join(labels, "label")
        .groupBy(*CORRIDOR)
        .agg(F.countDistinct("suppkey").alias("distributors"))
    )
    n = F.col("distributors")
    growth = F.least(F.greatest(F.coalesce("yoy_growth_pct", F.lit(0.0)), F.lit(0.0)) / 50.0, F.lit(1.0))
    cover = F.greatest(F.lit(0.0), 1.0 - n / 10.0)
    return (
        corridor_growth.join(counts, CORRIDOR, "left")
        .withColumn("distributors", F.coalesce("distributors", F.lit(0)))
        .select(
            *CORRIDOR,
            "distributors",
            "yoy_growth_pct",
            F.when(n < 2, "sparse").when(n < 5, "moderate").otherwise("dense").alias("density"),
            half_up(0.6 * growth + 0.4 * cover).alias("brokered_score"),
        )
    )


def correlation_score(trends: DataFrame, lag: DataFrame, targets: DataFrame, coverage: DataFrame) -> DataFrame:
    """Tier base, lead-lag bonus, show urgency and coverage gap, capped at 100, with its statements."""
    base = F.create_map(*[x for k, v in dims.TIER_BASE.items() for x in (F.lit(k), F.lit(v))])
    urgent = targets.groupBy("category").agg(
        F.count_if(F.col("urgency") == "high").alias("high"), F.count_if(F.col("urgency") == "medium").alias("medium")
    )
    conf, leads = F.col("confidence"), F.col("leads_trade")
    bonus = (
        F.when(leads & (conf == "high"), 25.0).when(leads & (conf == "medium"), 15.0).when(leads, 8.0)
        .when(~leads & (conf != "low"), 5.0).otherwise(0.0)
    )
    high, medium = F.coalesce("high", F.lit(0)), F.coalesce("medium", F.lit(0))
    gap = F.coalesce(F.floor(F.col("brokered_score") * 15 + 0.5), F.lit(0))
    total = F.coalesce(F.try_element_at(base, F.col("tier")), F.lit(8.0)) + bonus + F.least(high * 10 + medium * 4, F.lit(20)) + gap
    statements = F.array(
        F.when(leads & (conf != "low"), F.format_string("Retail in %s precedes trade by %d month(s)", "country", "lag_months")),
        F.when(~leads & (conf != "low"), F.format_string("Retail in %s lags trade by %d month(s)", F.col("country"), F.abs("lag_months"))),
        F.when(high > 0, F.format_string("%d show(s) within 60 days cover %s", high, F.col("category"))),
        F.when(F.col("density") == "sparse", F.format_string("Only %d distributor(s) cover %s in %s", "distributors", "category", "country")),
    )
    return (
        trends.select(*CORRIDOR, "tier")
        .join(lag, CORRIDOR, "left")
        .join(urgent, "category", "left")
        .join(coverage, CORRIDOR, "left")
        .select(
            *CORRIDOR,
            "tier",
            F.least(F.floor(total + 0.5), F.lit(100)).cast("int").alias("correlation_score"),
            F.array_join(F.filter(statements, lambda s: s.isNotNull()), "; ").alias("signals"),
        )
    )
