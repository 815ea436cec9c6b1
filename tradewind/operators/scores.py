"""Corridor and brand scores: gap, composite, brand fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradewind.functions.numeric import clamp, half_up, ladder, min_max
from tradewind.operators import merge
from tradewind.operators.routing import complexity
from tradewind.sources import dims
from tradewind.sources.stages import stage
from tradewind.sources.tables import grows
from tradewind.sources.views import closed_years, month_before

CORRIDOR = ["country", "category"]


def import_reliance(corridors: DataFrame, share: DataFrame, as_of: str = dims.AS_OF) -> DataFrame:
    """Direct imports over all imports, capped at 1: last closed year, else the year before, else a default."""
    latest, before = closed_years(as_of, 2)
    of = lambda year: F.max(
        F.when((F.col("year") == year) & (F.col("world") > 0), F.least(F.lit(1.0), F.coalesce("us", F.lit(0.0)) / F.col("world")))
    )
    by_market = share.groupBy(*CORRIDOR).agg(of(latest).alias("primary"), of(before).alias("fallback"))
    return corridors.join(by_market, CORRIDOR, "left").select(
        *CORRIDOR,
        half_up(F.coalesce("primary", "fallback", F.lit(dims.DEFAULT_RELIANCE)), 6).alias("reliance"),
        F.when(F.col("primary").isNotNull(), "primary").when(F.col("fallback").isNotNull(), "fallback").otherwise("default").alias("source"),
    )


def reliance_by_code(corridors: DataFrame, mapping: DataFrame, flows: DataFrame, stored: DataFrame, as_of: str, default: float) -> DataFrame:
    """country, category, reliance, source: own over all imports of a category, capped at 1.

    A stored value of the last 30 days is used again. Else the flow of the category's primary code counts, where there is none that
    of its fallback code; without imports the category's own default, and without a mapping ``default``.
    ``mapping`` has one row a category: primary, fallback, usual. ``flows`` has one a country and code: own, world.
    """
    kept = merge.reuse(corridors.select(*CORRIDOR, F.lit("month").alias("kind")), stored, CORRIDOR, F.lit(as_of).cast("timestamp"), ["reliance"])
    flow_of = lambda code: flows.select("country", F.col("code").alias(code), F.struct("own", "world").alias(f"{code}_flow"))
    wide = kept.join(mapping, "category", "left").join(flow_of("primary"), ["country", "primary"], "left").join(flow_of("fallback"), ["country", "fallback"], "left")
    flow = F.coalesce("primary_flow", "fallback_flow")
    ratio = F.when(flow["world"] > 0, F.least(F.lit(1.0), flow["own"] / flow["world"]))
    source = F.when(F.col("reused"), "stored").when(ratio.isNotNull(), F.when(F.col("primary_flow").isNotNull(), "primary").otherwise("fallback"))
    value = F.when(F.col("reused"), F.col("reliance")).otherwise(F.coalesce(ratio, "usual", F.lit(default)))
    return wide.select(*CORRIDOR, half_up(value, 6).alias("reliance"), source.when(F.col("usual").isNotNull(), "category").otherwise("default").alias("source"))


def brand_density(distributors: DataFrame, categories: DataFrame, brands: DataFrame) -> DataFrame:
    """Distinct brands carried by a market's distributors of a category."""
    local = distributors.select("suppkey", "country").join(grows(categories), "suppkey")
    return local.join(grows(brands), "suppkey").groupBy(*CORRIDOR).agg(F.countDistinct("brand").alias("density"))


def _shares_below(values: DataFrame, column: str, size: int) -> DataFrame:
    """(value, percent rank) of each different value of a column: rows below it over all others, 0.5 for a single row.

    Counts are taken by value, values are dealt out in ranges, and a range adds what lies in the ranges
    before it. What reaches the driver is one count a range; no task sees more than its range.
    """
    counts = stage(values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).repartitionByRange("value").withColumn("range", F.spark_partition_id()), "value-counts")
    before, total = [], 0
    sizes = {r["range"]: r["n"] for r in counts.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    for i in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(i, 0)
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = inside + F.element_at(F.lit(before), F.col("range") + 1)
    return counts.select("value", (F.lit(0.5) if size <= 1 else below / F.lit(float(size - 1))).alias(f"{column}_share"))


def gap_scores(trends: DataFrame, strength: DataFrame, density: DataFrame, reliance: DataFrame, limit: int | None = None) -> DataFrame:
    """Demand-supply gap of every trend; with ``limit`` a report over the fastest-growing ones, ranked among themselves."""
    batch = trends.select(*CORRIDOR, "growth")
    if limit is not None:
        batch = batch.orderBy(F.desc("growth"), *CORRIDOR).limit(limit)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    metrics = stage(
        batch.join(strength, CORRIDOR, "left")
        .join(density, CORRIDOR, "left")
        .join(reliance, CORRIDOR, "left")
        .select(*CORRIDOR, "growth", zero("strength").alias("strength"), F.coalesce("density", F.lit(0)).alias("density"),
                F.coalesce("reliance", F.lit(dims.DEFAULT_RELIANCE)).alias("reliance")),
        "gap-metrics",
    )
    ends = metrics.agg(*[f(c).alias(f"{n}_{c}") for c in ("growth", "strength") for n, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("n")).first()
    scaled = lambda c: min_max(F.col(c), F.lit(ends[f"lo_{c}"]), F.lit(ends[f"hi_{c}"]), 0.5)
    ranked = metrics.withColumn("demand", half_up(0.6 * scaled("growth") + 0.4 * scaled("strength"), 9))
    for c in ("demand", "reliance", "density"):
        ranked = ranked.join(_shares_below(ranked.select(c), c, ends["n"]), F.col(c) == F.col("value")).drop("value")
    w = dims.GAP_WEIGHTS
    return ranked.select(
        *CORRIDOR,
        half_up(F.col("demand"), 6).alias("demand_signal"),
        "reliance",
        "density",
        F.col("demand_share").alias("demand_pct"),
        F.col("reliance_share").alias("import_pct"),
        F.col("density_share").alias("density_pct"),
        half_up(
            100.0 * (w["demand"] * F.col("demand_share") + w["imports"] * F.col("reliance_share") + w["density"] * (1 - F.col("density_share"))), 1
        ).alias("gap_score"),
    )


def active_trends(trends: DataFrame, since_ym: int = month_before(dims.AS_OF, 3)) -> DataFrame:
    return trends.filter(F.col("last_ym") >= since_ym)


def margin_potential(annual: DataFrame) -> DataFrame:
    """Best unit value per category on the direct route, scaled over the categories; all equal gives 0."""
    best = annual.filter("flow = 'us_to_eu'").groupBy("category").agg(F.max("unit_value").alias("uv")).filter("uv IS NOT NULL")
    ends = best.agg(F.struct(F.min("uv").alias("lo"), F.max("uv").alias("hi"))).scalar()
    return best.select("category", min_max(F.col("uv"), ends["lo"], ends["hi"], 0.0).alias("margin"))


def composite(
    trends: DataFrame, gaps: DataFrame, margins: DataFrame, dimensions: DataFrame, entry_confidence: DataFrame
) -> DataFrame:
    """Category, brand-proxy and routing sub-scores of every active corridor and their weighted sum."""
    batch = trends.agg(F.struct(F.min("growth").alias("lo"), F.max("growth").alias("hi"), F.count("*").alias("n"))).scalar()
    lo, hi, size = batch["lo"], batch["hi"], batch["n"]
    fact = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    corridors = (
        trends.select(*CORRIDOR, "growth")
        .join(gaps.select(*CORRIDOR, "gap_score", "demand_pct"), CORRIDOR, "left")
        .join(margins, "category", "left")
        .join(dimensions, CORRIDOR, "left")
        .join(entry_confidence, CORRIDOR, "left")
    )
    vat, dist, reg = fact("vat_advantage"), fact("distribution_efficiency"), fact("regulatory_clarity")
    logistics = (vat + dist + reg) / 3.0
    scaled = F.when(size > 1, min_max(F.col("growth"), lo, hi, 0.5)).otherwise(F.lit(0.0))
    demand = F.coalesce("demand_pct", scaled)
    pull = F.coalesce(F.col("gap_score") / 100.0, clamp(F.col("growth"), 0, 1))
    c, b, n, total = dims.CATEGORY_WEIGHTS, dims.BRAND_WEIGHTS, dims.NI_WEIGHTS, dims.COMPOSITE_WEIGHTS
    burden = 1.0 - complexity(F.col("category"))
    score = lambda x: clamp(100.0 * x, 0, 100)
    category = score(c["demand"] * demand + c["margin"] * fact("margin") + c["regulatory"] * burden + c["logistics"] * logistics)
    brand = score(b["demand"] * pull + b["fit"] * fact("entry_confidence") + b["logistics"] * logistics)
    routing = score(n["vat_advantage"] * vat + n["distribution_efficiency"] * dist + n["regulatory_clarity"] * reg)
    return corridors.select(
        *CORRIDOR,
        half_up(category).alias("category_score"),
        half_up(brand).alias("brand_score"),
        half_up(routing).alias("ni_score"),
        half_up(total["category"] * category + total["brand"] * brand + total["ni"] * routing).alias("composite_score"),
        ((vat > 0).cast("int") + (dist > 0).cast("int") + (reg > 0).cast("int")).alias("signal_count"),
        half_up(fact("entry_confidence")).alias("entry_confidence"),
    )


def category_match(brand_categories: DataFrame, aliases: DataFrame) -> DataFrame:
    """Best text match of a brand's labels with each category: 1 exact, 0.7 either contains the other.

    Distinct labels meet the fixed alias list (a broadcast of known size); brands join the matched
    labels on equality, so brand rows are never paired with every alias.
    """
    label, alias = F.col("label"), F.col("alias")
    labels = brand_categories.select(F.lower(F.trim("category")).alias("label")).distinct()
    matches = (
        labels.join(F.broadcast(aliases), label.contains(alias) | alias.contains(label))
        .groupBy("label", F.col("category").alias("matched_category"))
        .agg(F.max(F.when(label == alias, F.lit(1.0)).otherwise(F.lit(0.7))).alias("match"))
    )
    return (
        brand_categories.select("brand", F.lower(F.trim("category")).alias("label"))
        .join(matches, "label")
        .groupBy("brand", F.col("matched_category").alias("category"))
        .agg(F.max("match").alias("match"))
    )


def revenue_score(revenue: Column) -> Column:
    return ladder(revenue, [(1e6, 0.3), (1e7, 0.7), (1e8, 1.0)], 0.5, 0.5)


def size_fit(revenue: Column) -> Column:
    return ladder(revenue, [(1e6, 0.4), (1e7, 0.8), (1e8, 1.0)], 0.5, 0.5)


def brand_fit(brands: DataFrame, matches: DataFrame, corridors: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Fit, suitability and composite of every (brand, corridor in a matched category)."""
    fact = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    strength = (fact("vat_advantage") + fact("distribution_efficiency") + fact("regulatory_clarity")) / 3.0
    present = F.col("eu_presence")
    fit = clamp(
        100.0
        * (0.40 * F.col("match") + 0.30 * revenue_score(F.col("revenue")) + 0.30 * F.when(F.col("has_store"), 1.0).otherwise(0.0))
        * F.when(present, 0.6).otherwise(1.0),
        0,
        100,
    )
    routing = clamp(
        100.0 * (0.40 * strength + 0.30 * F.when(present, 0.3).otherwise(1.0) + 0.30 * size_fit(F.col("revenue"))), 0, 100
    )
    total = dims.COMPOSITE_WEIGHTS
    return (
        brands.join(matches, "brand")
        .join(corridors.select(*CORRIDOR, "category_score"), "category")
        .join(dimensions, CORRIDOR, "left")
        .select(
            "brand",
            *CORRIDOR,
            F.col("match").alias("category_match"),
            "category_score",
            half_up(fit).alias("brand_score"),
            half_up(routing).alias("ni_score"),
            half_up(total["category"] * F.col("category_score") + total["brand"] * fit + total["ni"] * routing).alias("composite_score"),
        )
    )


def gap_summary(gaps: DataFrame) -> DataFrame:
    """Corridors, those at 80 or more, the mean score as a whole number and the largest gap (ties: first by country and category)."""
    score = F.col("gap_score")
    return gaps.agg(
        F.count("*").alias("corridors"),
        F.count_if(score >= 80).alias("above_80"),
        half_up(F.avg(F.round(score * 10).cast("bigint")) / 10.0, 0).alias("mean_score"),
        F.min_by(F.concat_ws(" x ", "category", "country"), F.struct((-score).alias("s"), *CORRIDOR)).alias("top_gap"),
        F.max(score).alias("top_score"),
    )
