"""Routing signals and the suitability score built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradewind.functions.numeric import clamp, half_up
from tradewind.sources import dims
from tradewind.sources.tables import grows

LATEST, EARLIER = 2000, 1998
MIN_GROWTH = 5.0
SPARSE = 3


def _signal(kind: str, dimension: str) -> list[Column]:
    return [F.lit(kind).alias("signal_type"), F.lit(dimension).alias("dimension")]


def routing_shift(yoy: DataFrame) -> DataFrame:
    """The gateway route growing at least 5 points faster than the direct one, per category."""
    mean = lambda flow: F.avg(F.when(F.col("flow") == flow, F.col("growth_yoy")))
    value = F.sum(F.when(F.col("flow") == "uk_to_eu", F.col("cents")))
    premium = F.col("gateway") - F.coalesce("direct", F.lit(0.0))
    return (
        yoy.filter((F.col("year") == LATEST) & F.col("flow").isin("us_to_uk", "us_to_eu", "uk_to_eu"))
        .groupBy("category")
        .agg(mean("us_to_uk").alias("gateway"), mean("us_to_eu").alias("direct"), value.alias("c"))
        .withColumn("premium", premium)
        .filter((F.col("premium") >= 5.0) & (F.col("gateway") >= MIN_GROWTH))
        .select(
            "category",
            F.lit("ALL").alias("country"),
            *_signal("gateway_shift", "vat_advantage"),
            half_up(clamp((F.col("premium") - 5.0) / 30.0, 0, 1), 6).alias("strength"),
            half_up(F.col("gateway")).alias("gateway_growth_pct"),
            half_up(F.coalesce("direct", F.lit(0.0))).alias("direct_growth_pct"),
            half_up(F.col("premium")).alias("premium_pp"),
            (F.coalesce("c", F.lit(0)) / 100.0).alias("onward_value"),
        )
    )


def reexport_ratio(annual: DataFrame) -> DataFrame:
    """Onward over direct value of a market, at least 10 %; a growing ratio adds a fifth."""
    at = lambda flow, year: F.sum(F.when((F.col("flow") == flow) & (F.col("year") == year), F.col("cents"))).cast("double")
    ratio, base = F.col("ratio"), F.col("ratio_before")
    strength = clamp(ratio / 0.5, 0, 1)
    return (
        annual.filter(F.col("flow").isin("us_to_eu", "uk_to_eu") & F.col("year").isin(LATEST, EARLIER))
        .groupBy("category", F.col("partner").alias("country"))
        .agg(
            at("uk_to_eu", LATEST).alias("onward"),
            at("us_to_eu", LATEST).alias("direct"),
            at("uk_to_eu", EARLIER).alias("onward0"),
            at("us_to_eu", EARLIER).alias("direct0"),
        )
        .filter("onward > 0 AND direct > 0")
        .withColumn("ratio", F.col("onward") / F.col("direct"))
        .withColumn("ratio_before", F.when((F.col("direct0") > 0) & (F.col("onward0") > 0), F.col("onward0") / F.col("direct0")))
        .filter("ratio >= 0.10")
        .withColumn("is_growing", F.coalesce(ratio > base, F.lit(False)))
        .select(
            "category",
            "country",
            *_signal("reexport", "vat_advantage"),
            half_up(F.when(F.col("is_growing"), clamp(strength * 1.2, 0, 1)).otherwise(strength), 6).alias("strength"),
            half_up(ratio).alias("ratio"),
            half_up(base).alias("ratio_before"),
            half_up(ratio - base).alias("ratio_growth"),
            "is_growing",
        )
    )


def unit_value_fit(annual: DataFrame) -> DataFrame:
    """Categories whose mean unit value reaches 30 per kg, over all direct-route years."""
    uv = F.col("unit_value")
    total = F.sum(F.when(F.col("year") == LATEST, F.col("cents")))
    # Unit values have two decimals, so they are averaged as whole cents.
    mean = F.sum(F.round(uv * 100).cast("bigint")).cast("double") / F.count("*") / 100.0
    return (
        annual.filter((F.col("flow") == "us_to_eu") & (uv > 0) & (uv < 100000))
        .groupBy("category")
        .agg(mean.alias("mean_uv"), F.max(uv).alias("max_unit_value"), total.alias("c"), F.count("*").alias("sample_size"))
        .filter("mean_uv >= 30")
        .select(
            "category",
            F.lit("ALL").alias("country"),
            *_signal("unit_value", "distribution_efficiency"),
            half_up(clamp((F.col("mean_uv") - 30.0) / 120.0, 0, 1), 6).alias("strength"),
            half_up(F.col("mean_uv")).alias("mean_unit_value"),
            "max_unit_value",
            (F.coalesce("c", F.lit(0)) / 100.0).alias("latest_value"),
            "sample_size",
        )
    )


def importer_counts(distributors: DataFrame, categories: DataFrame) -> DataFrame:
    """Importing distributors per (category, country)."""
    return (
        distributors.filter("imports")
        .join(grows(categories), "suppkey")
        .groupBy("category", "country")
        .agg(F.count("*").alias("importers"))
    )


def distributor_gap(yoy: DataFrame, importers: DataFrame) -> DataFrame:
    """Fewer than three importers in a market whose direct imports grow at least 5 %."""
    n = F.col("importers")
    return (
        yoy.filter((F.col("flow") == "us_to_eu") & (F.col("year") == LATEST) & F.col("growth_yoy").isNotNull())
        .groupBy("category", F.col("partner").alias("country"))
        .agg(F.avg("growth_yoy").alias("growth"))
        .filter(F.col("growth") >= MIN_GROWTH)
        .join(importers, ["category", "country"], "left")
        .withColumn("importers", F.coalesce("importers", F.lit(0)))
        .filter(n < SPARSE)
        .select(
            "category",
            "country",
            *_signal("distributor_gap", "distribution_efficiency"),
            half_up(clamp(clamp(F.col("growth") / 50.0, 0, 1) * (1.0 - n / float(SPARSE)), 0, 1), 6).alias("strength"),
            "importers",
            half_up(F.col("growth")).alias("growth_pct"),
        )
    )


CORE = ["category", "country", "signal_type", "dimension", "strength"]


def all_signals(annual: DataFrame, yoy: DataFrame, importers: DataFrame) -> DataFrame:
    """Union of the four detectors."""
    parts = [routing_shift(yoy), reexport_ratio(annual), unit_value_fit(annual), distributor_gap(yoy, importers)]
    out = parts[0].select(*CORE)
    for part in parts[1:]:
        out = out.unionByName(part.select(*CORE))
    return out


def corridor_dimensions(signals: DataFrame, corridors: DataFrame) -> DataFrame:
    """Strongest signal per sub-dimension of every corridor; category-wide signals reach each of its markets.

    Signals are reduced to one row per (category, country, dimension) before they meet corridors.
    """
    best = signals.groupBy("category", "country", "dimension").agg(F.max("strength").alias("strength"))
    wide = best.filter("country = 'ALL'").drop("country").join(corridors, "category")
    own = best.filter("country <> 'ALL'").join(corridors, ["category", "country"])
    cols = ["category", "country", "dimension", "strength"]
    top = lambda d: F.coalesce(F.max(F.when(F.col("dimension") == d, F.col("strength"))), F.lit(0.0)).alias(d)
    return (
        wide.select(*cols)
        .unionByName(own.select(*cols))
        .groupBy("category", "country")
        .agg(top("vat_advantage"), top("distribution_efficiency"), top("regulatory_clarity"), F.count("*").alias("n_dims"))
    )


def complexity(category: Column) -> Column:
    out = None
    for name, value in dims.REGULATORY_COMPLEXITY.items():
        out = F.when(category == name, F.lit(value)) if out is None else out.when(category == name, F.lit(value))
    return out.otherwise(F.lit(0.5))


def suitability(signals: DataFrame, corridors: DataFrame) -> DataFrame:
    vat, dist = F.col("vat_advantage"), F.col("distribution_efficiency")
    reg = 1.0 - complexity(F.col("category"))
    w = dims.NI_WEIGHTS
    parts = [w["vat_advantage"] * vat, w["distribution_efficiency"] * dist, w["regulatory_clarity"] * reg]
    return (
        corridor_dimensions(signals, corridors)
        .filter("vat_advantage > 0 OR distribution_efficiency > 0")
        .select(
            "category",
            "country",
            "vat_advantage",
            "distribution_efficiency",
            half_up(reg, 6).alias("regulatory_clarity"),
            half_up(100.0 * (parts[0] + parts[1] + parts[2])).alias("suitability_score"),
            F.when((parts[0] >= parts[1]) & (parts[0] >= parts[2]), "vat_advantage")
            .when(parts[1] >= parts[2], "distribution_efficiency")
            .otherwise("regulatory_clarity")
            .alias("primary_driver"),
        )
    )
