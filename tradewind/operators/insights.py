"""Insights with texts: alerts, brand alerts, market briefs, show playbooks and the weekly digest.

Texts are templates with named slots, filled by expressions. Evidence is a list of lines in report order; a line whose
value is missing drops out. Every row stands on a corridor, brand or show, so all tables here are bounded by dimensions.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradewind.functions.numeric import half_up
from tradewind.operators.leads import CORRIDOR
from tradewind.sources import dims
from tradewind.sources.stages import stage

TITLES = {
    "alert": "Opportunity alert: {category} x {country}",
    "brand_alert": "Brand opportunity: {brand} in {category} x {country}",
    "brief": "Market brief: {category} in {country}",
    "playbook": "Show playbook: {show}",
    "digest": "Weekly digest: week {week}, {year}",
}

NARRATIVES = {
    "alert": "{category} in {country} stands at {score} of 100{tier}. Assess this corridor next and list brands for it.",
    "brand_alert": "{brand} reaches {score} of 100 for {category} in {country}. Put it on the list of the next campaign.",
    "brief": "Demand for {category} in {country} gives a score of {score} of 100{tier}. Distributors there are worth a first call.",
    "playbook": "{show} in {place} covers {categories}. Meet exhibitors of its best corridors and ask who distributes them.",
    "digest": "Best corridors of the week: {top}. Brands above the threshold: {brands}.",
}

EVIDENCE = {
    "corridor": [
        "Corridor: {category} x {country}",
        "Composite {score} (category {category_score}, brand {brand_score}, routing {ni_score})",
        "Growth tier: {tier_name}",
        "Gap score: {gap}",
        "Demand above {demand}% of all corridors",
        "Foreign brands entering: {entry}% confidence",
    ],
    "brand": [
        "Brand: {brand}",
        "Composite {score} (fit {brand_score}, routing {ni_score}, category {category_score})",
        "Category match: {match}%",
        "Own store: {store}",
        "Present in the market: {present}",
    ],
    "playbook": [
        "Starts on {start}",
        "Corridors: {corridors}",
        "Exhibitors ({n}): {exhibitors}",
        "Scored brands: {brands}",
    ],
    "digest": [
        "This run: {alerts} alerts, {briefs} briefs, {playbooks} playbooks",
        "Corridors: {corridors}",
        "Next shows: {shows}",
        "Trends: {trends}",
    ],
}


def render(template: str, slots: dict[str, Column]) -> Column:
    """The template with its slots filled; null if one of them is."""
    parts = []
    for text, slot, _, _ in Formatter().parse(template):
        parts += ([F.lit(text)] if text else []) + ([slots[slot].cast("string")] if slot else [])
    return F.concat(*parts)


def body(narrative: str, evidence: list[str], slots: dict[str, Column]) -> Column:
    """Narrative, then the evidence lines that have all their values, in their order."""
    return F.concat_ws("\n", render(narrative, slots), F.lit("Evidence:"), *[render(line, slots) for line in evidence])


def one(c: Column) -> Column:
    """The number with one digit; null stays null, where a format would write the word."""
    return F.when(c.isNotNull(), F.format_string("%.1f", half_up(c, 1)))


def percent(c: Column) -> Column:
    return F.floor(c * 100 + 0.5).cast("bigint")


def listed(df: DataFrame, keys: list[str], order: list[Column], line: Column, name: str, limit: int) -> DataFrame:
    """The first ``limit`` lines of each group in order, joined to one text; tasks keep ``limit`` rows a group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).withColumn("line", line)
    rows = F.array_sort(F.collect_list(F.struct("rn", "line")))
    return first.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "; ").alias(name))


def _best(df: DataFrame, order: list[Column], line: Column, name: str, limit: int) -> DataFrame:
    """One row: the first ``limit`` lines of the whole table. The limit comes before the single group."""
    return listed(df.orderBy(*order).limit(limit).withColumn("all", F.lit(1)), ["all"], order, line, name, limit).drop("all")


def _corridor_rows(kind: str, rows: DataFrame) -> DataFrame:
    c = F.col
    slots = {
        "category": c("category"), "country": c("country"), "score": one(c("composite_score")), "category_score": one(c("category_score")),
        "brand_score": one(c("brand_score")), "ni_score": one(c("ni_score")), "tier_name": c("tier"), "gap": one(c("gap_score")),
        "tier": F.coalesce(F.concat(F.lit(", tier "), c("tier")), F.lit("")), "demand": percent(c("demand_pct")),
        "entry": F.when(c("entry_confidence") > 0, percent(c("entry_confidence"))),
    }
    return rows.select(
        F.lit(kind).alias("kind"), render(TITLES[kind], slots).alias("title"), c("composite_score").alias("score"),
        body(NARRATIVES[kind], EVIDENCE["corridor"], slots).alias("body"),
    )


def corridor_insights(corridor_scores: DataFrame, gaps: DataFrame, trends: DataFrame, threshold: float, briefs: int = 10) -> DataFrame:
    """An alert for each corridor at or above the threshold and a brief for each of the best ``briefs``."""
    known = (
        corridor_scores.join(gaps.select(*CORRIDOR, "gap_score", "demand_pct"), CORRIDOR, "left")
        .join(trends.select(*CORRIDOR, "tier"), CORRIDOR, "left")
    )
    top = known.orderBy(F.desc("composite_score"), *CORRIDOR).limit(briefs)
    return _corridor_rows("alert", known.filter(F.col("composite_score") >= threshold)).unionByName(_corridor_rows("brief", top))


def brand_insights(brand_scores: DataFrame, brands: DataFrame, threshold: float, limit: int = 20) -> DataFrame:
    """Alerts for the best ``limit`` brand and corridor scores at or above the threshold."""
    c = F.col
    best = brand_scores.filter(c("composite_score") >= threshold).orderBy(F.desc("composite_score"), "brand", *CORRIDOR).limit(limit)
    yes = lambda name: F.when(c(name), "yes").otherwise("no")
    slots = {
        "brand": c("brand"), "category": c("category"), "country": c("country"), "score": one(c("composite_score")),
        "category_score": one(c("category_score")), "brand_score": one(c("brand_score")), "ni_score": one(c("ni_score")),
        "match": percent(c("category_match")), "store": yes("has_store"), "present": yes("eu_presence"),
    }
    return best.join(brands.select("brand", "has_store", "eu_presence"), "brand").select(
        F.lit("brand_alert").alias("kind"), render(TITLES["brand_alert"], slots).alias("title"), c("composite_score").alias("score"),
        body(NARRATIVES["brand_alert"], EVIDENCE["brand"], slots).alias("body"),
    )


def show_insights(
    shows: DataFrame, show_categories: DataFrame, exhibitors: DataFrame, corridor_scores: DataFrame, top_brands: DataFrame,
    as_of: str = dims.AS_OF, corridors: int = 5, names: int = 12, brands: int = 10,
) -> DataFrame:
    """A playbook for each show that is still to come; a show of no known category covers general goods."""
    c = F.col
    pairs = show_categories.select("show_id", "category")
    score_line = lambda name: F.format_string("%s (%s)", name, one(c("composite_score")))
    where = pairs.join(corridor_scores.select(*CORRIDOR, "composite_score"), "category")
    down = F.desc("composite_score")
    best = pairs.join(top_brands.select("brand", "category", "composite_score"), "category").groupBy("show_id", "brand").agg(
        F.max("composite_score").alias("composite_score")
    )
    n = exhibitors.groupBy("show_id").agg(F.count("*").alias("n"))
    slots = {
        "show": c("show_name"), "place": c("place"), "start": F.date_format("start_on", "yyyy-MM-dd"), "n": c("n"), "corridors": c("corridors"),
        "categories": F.coalesce("categories", F.lit("general goods")), "exhibitors": c("names"), "brands": c("brands"),
    }
    return (
        shows.filter(c("start_on") >= F.lit(as_of).cast("date")).select("show_id", "show_name", c("country").alias("place"), "start_on")
        .join(listed(pairs.distinct(), ["show_id"], [c("category")], c("category"), "categories", len(dims.SHOW_KEYWORDS)), "show_id", "left")
        .join(listed(where, ["show_id"], [down, *map(c, CORRIDOR)], score_line(F.concat_ws(" x ", "category", "country")), "corridors", corridors), "show_id", "left")
        .join(where.groupBy("show_id").agg(F.max("composite_score").alias("score")), "show_id", "left")
        .join(n, "show_id", "left")
        .join(listed(exhibitors, ["show_id"], [c("exhibitor"), c("suppkey")], c("exhibitor"), "names", names), "show_id", "left")
        .join(listed(best, ["show_id"], [down, c("brand")], score_line(c("brand")), "brands", brands), "show_id", "left")
        .select(
            F.lit("playbook").alias("kind"), render(TITLES["playbook"], slots).alias("title"), "score",
            body(NARRATIVES["playbook"], EVIDENCE["playbook"], slots).alias("body"),
        )
    )


def unrecorded(rows: DataFrame, recorded: DataFrame, as_of: str = dims.AS_OF, days: int = 7) -> DataFrame:
    """Rows whose title was not recorded in the last days; ``recorded`` has (title, created_on)."""
    recent = recorded.filter(F.col("created_on") >= F.date_sub(F.lit(as_of).cast("date"), days)).select("title").distinct()
    return rows.join(recent, "title", "left_anti").select("kind", "title", "score", "body")


def digest(
    fresh: DataFrame, corridor_scores: DataFrame, brand_scores: DataFrame, shows: DataFrame, trends: DataFrame, threshold: float, as_of: str = dims.AS_OF
) -> DataFrame:
    """One row on the week: what this run wrote, the best corridors, brands above the threshold, next shows, fastest trends."""
    c = F.col
    day = F.lit(as_of).cast("date")
    pair = F.concat_ws(" x ", "category", "country")
    order = [F.desc("composite_score"), *map(c, CORRIDOR)]
    scored = F.format_string("%s (%s)", pair, one(c("composite_score")))
    of = lambda *kinds: F.count_if(c("kind").isin(*kinds))
    counts = fresh.agg(of("alert", "brand_alert").alias("alerts"), of("brief").alias("briefs"), of("playbook").alias("playbooks"))
    above = brand_scores.agg(F.count_if(c("composite_score") >= threshold).alias("above"))
    parts = [
        above,
        _best(corridor_scores, order, scored, "corridors", 5),
        _best(corridor_scores, order, scored, "top", 3),
        _best(shows.filter(c("start_on") >= day), [c("start_on"), c("show_id")], F.format_string("%s on %s", "show_name", F.date_format("start_on", "yyyy-MM-dd")), "shows", 3),
        _best(trends, [F.desc("growth"), *map(c, CORRIDOR)], F.format_string("%s %s%% (%s)", pair, one(c("growth") * 100), "tier"), "trends", 5),
    ]
    row = counts.withColumn("one", F.lit(1))
    for part in parts:  # one row each
        row = row.join(part.withColumn("one", F.lit(1)), "one", "left")
    slots = {k: c(k) for k in ("alerts", "briefs", "playbooks", "corridors", "shows", "trends")}
    slots |= {"top": F.coalesce("top", F.lit("none")), "brands": c("above"), "week": F.weekofyear(day), "year": F.year(day)}
    return row.select(
        F.lit("digest").alias("kind"), render(TITLES["digest"], slots).alias("title"), F.lit(None).cast("double").alias("score"),
        body(NARRATIVES["digest"], EVIDENCE["digest"], slots).alias("body"),
    )


def all_insights(parts: list[DataFrame], recorded: DataFrame, make_digest, as_of: str = dims.AS_OF) -> DataFrame:
    """The parts without recorded titles, and the digest over what is left of them, if its own title is new too."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    fresh = stage(unrecorded(rows, recorded, as_of), "insights")
    return fresh.unionByName(unrecorded(make_digest(fresh), recorded, as_of))
