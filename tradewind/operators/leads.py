"""Lead discovery, quality, pitch, outreach, export, rules, insights and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradewind.functions.numeric import clamp, half_up
from tradewind.sources import dims
from tradewind.sources.tables import grows

CORRIDOR = ["country", "category"]


def best_by(df: DataFrame, keys: list[str], score: str, tiebreak: list[str], keep: list[str]) -> DataFrame:
    """Row with the highest score per key as an aggregate: each task sends one row per key.

    Ties go to the first in ``tiebreak`` order.
    """
    best = F.min_by(F.struct(*keep), F.struct((-F.col(score)).alias("s"), *tiebreak))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in keep])


def brand_targets(brand_scores: DataFrame, corridor_scores: DataFrame, brand_categories: DataFrame) -> DataFrame:
    """Best corridor of a brand, and the fallback for a lead without one: best corridor score times 0.7."""
    own = best_by(brand_scores, ["brand"], "composite_score", CORRIDOR, ["composite_score", *CORRIDOR])
    fallback = best_by(
        brand_categories.join(corridor_scores, "category"), ["brand"], "composite_score", CORRIDOR, ["composite_score", *CORRIDOR]
    )
    rename = {"composite_score": "fb_score", "country": "fb_country", "category": "fb_category"}
    return (
        own.withColumnsRenamed({"composite_score": "own_score", "country": "own_country", "category": "own_category"})
        .join(fallback.withColumnsRenamed(rename), "brand", "full_outer")
    )


def resolve_corridor(leads: DataFrame, targets: DataFrame) -> DataFrame:
    """Best corridor of every lead as (country, category) with its ``composite`` score; the lead's own country becomes ``home``.

    A linked lead takes its brand's best scored corridor, any other the best corridor of the brand's categories at 0.7 of
    its score. A brand without scores gives no corridor. The targets are one row a brand, so the leads are not grouped.
    """
    linked = F.col("linked") & F.col("own_score").isNotNull()
    pick = lambda own, fallback: F.when(linked, F.col(own)).otherwise(fallback)
    return (
        leads.withColumnRenamed("country", "home")
        .join(targets, "brand", "left")
        .withColumn("country", pick("own_country", F.col("fb_country")))
        .withColumn("category", pick("own_category", F.col("fb_category")))
        .withColumn("composite", pick("own_score", F.coalesce(F.col("fb_score") * 0.7, F.lit(0.0))))
        .drop("own_score", "own_country", "own_category", "fb_score", "fb_country", "fb_category")
    )


def lead_quality(leads: DataFrame, gaps: DataFrame, trends: DataFrame, counts: DataFrame, risks: DataFrame) -> DataFrame:
    """Quality 0-100 of every lead from its best corridor, contacts, distributor matches and risk.

    ``leads`` carries its resolved corridor and ``profile``. Everything joined here is at corridor or profile grain; the
    lead table is never shuffled on a skewed key unless those grains outgrow a broadcast.
    """
    c = F.col
    bonus_map = F.create_map(*[x for k, v in dims.TIER_BONUS.items() for x in (F.lit(k), F.lit(v))])
    have = lambda name, w: F.when(c(name), F.lit(w)).otherwise(0.0)
    contact = have("has_email", 50.0) + have("has_profile", 30.0) + have("has_site", 20.0)
    penalty = F.when(c("risk") == "high", 20.0).when(c("risk") == "medium", 8.0).otherwise(0.0)
    bonus = F.coalesce(F.try_element_at(bonus_map, c("tier")), F.lit(0.0))
    total = (
        c("composite") * 0.35
        + F.coalesce("gap_score", F.lit(0.0)) * 0.22
        + bonus * 0.18
        + contact * 0.12
        + F.least(F.coalesce("matches", F.lit(0)) * 3.0, F.lit(15.0))
        - penalty
    )
    return (
        leads.join(gaps.select(*CORRIDOR, "gap_score"), CORRIDOR, "left")
        .join(trends.select(*CORRIDOR, "tier"), CORRIDOR, "left")
        .join(counts.select("country", "profile", "matches"), ["country", "profile"], "left")
        .join(risks.select(*CORRIDOR, "risk"), CORRIDOR, "left")
        .select(
            "lead",
            "company",
            "home",
            "brand",
            "profile",
            "status",
            "exported_on",
            "has_email",
            F.when(c("composite") > 0, half_up(c("composite"))).alias("opportunity_score"),
            c("country").alias("best_country"),
            c("category").alias("best_category"),
            "gap_score",
            "tier",
            F.coalesce("matches", F.lit(0)).alias("matches"),
            F.coalesce("risk", F.lit("low")).alias("risk"),
            half_up(clamp(F.round(total, 9), 0, 100)).alias("quality"),
        )
    )


def pitch_angle(quality: DataFrame, corridor_strength: DataFrame) -> DataFrame:
    """Angle by the first rule that holds, and its hook text."""
    c = F.col
    gap, tier = F.coalesce("gap_score", F.lit(0.0)), c("tier")
    strength = F.coalesce("mean_strength", F.lit(0.0))
    where = corridor_strength.withColumnsRenamed({"country": "best_country", "category": "best_category"})
    angle = (
        F.when(c("matches") >= 2, "distributor_pull")
        .when((gap > 70) & tier.isin("breakthrough", "accelerating"), "first_mover")
        .when(gap > 60, "unmet_demand")
        .when(strength > 0.7, "cost_optimisation")
        .otherwise("margin_expansion")
    )
    hook = (
        F.when(c("angle") == "distributor_pull", F.format_string("%d distributors in %s are sourcing this category now.", "matches", "best_country"))
        .when(c("angle") == "first_mover", F.format_string("The %s market in %s is growing rapidly.", "best_category", "best_country"))
        .when(
            c("angle") == "unmet_demand",
            F.format_string("Retailers in %s look for %s (gap score: %d/100).", c("best_country"), c("best_category"), F.floor(gap + 0.5)),
        )
        .when(c("angle") == "cost_optimisation", F.lit("Gateway routing cuts the landed cost."))
        .otherwise(F.format_string("The %s category in %s commands higher unit values.", "best_category", "best_country"))
    )
    return (
        quality.join(where, ["best_country", "best_category"], "left").withColumn("angle", angle).withColumn("hook", hook)
    )


def latest_campaign(campaigns: DataFrame) -> DataFrame:
    return campaigns.groupBy("lead").agg(
        F.max_by(F.struct("campaign", "status", "created_on", "stage", "cents"), F.struct("created_on", "campaign")).alias("last")
    )


def outreach_pick(
    pitched: DataFrame, campaigns: DataFrame, min_quality: float = 70.0, per_day: int = 50, min_gap_days: int = 3, as_of: str = dims.AS_OF
) -> DataFrame:
    """Approved leads within today's remaining quota, without a campaign in the last days."""
    today = F.lit(as_of).cast("date")
    sent = campaigns.filter((F.col("status") == "sent") & (F.col("created_on") >= today)).agg(F.count("*")).scalar()
    candidates = (
        pitched.filter((F.col("status") == "approved") & (F.col("quality") >= min_quality) & F.col("has_email") & F.col("angle").isNotNull())
        .orderBy(F.desc("quality"), "lead")
        .limit(per_day)
    )
    order = Window.orderBy(F.desc("quality"), "lead")  # at most per_day rows
    last = latest_campaign(campaigns).select("lead", F.col("last.created_on").alias("last_on"))
    return (
        candidates.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= F.lit(per_day) - sent)
        .join(grows(last), "lead", "left")
        .filter(F.col("last_on").isNull() | (F.col("last_on") <= F.date_sub(today, min_gap_days)))
        .select("lead", "company", "quality", "angle", "rank", F.ceil(F.col("quality") / 34.0).cast("int").alias("priority"))
    )


def crm_selection(
    quality: DataFrame, campaigns: DataFrame, pipeline: DataFrame, briefings: DataFrame, as_of: str = dims.AS_OF, min_quality: float = 75.0
) -> DataFrame:
    """Leads to export: by status, or good and not exported for a week; latest campaign, pipeline entry and newest briefing attached.

    ``pipeline`` has one row a lead; of several briefings the newest counts (ties: the later title).
    """
    titles = briefings.groupBy("lead").agg(F.max_by("title", F.struct("created_on", "title")).alias("briefing"))
    stale = F.col("exported_on").isNull() | (F.col("exported_on") < F.date_sub(F.lit(as_of).cast("date"), 7))
    chosen = quality.filter(F.col("status").isin("replied", "qualified", "won") | ((F.col("quality") >= min_quality) & stale))
    joined = chosen.join(latest_campaign(campaigns), "lead", "left").join(pipeline, "lead", "left").join(titles, "lead", "left")
    return joined.select(
        "lead",
        "company",
        chosen.status,
        "quality",
        "best_country",
        "best_category",
        F.col("last.campaign").alias("last_campaign"),
        F.col("last.status").alias("campaign_status"),
        F.date_format("last.created_on", "yyyy-MM-dd").alias("campaign_on"),
        "stage",
        "estimated_value",
        "probability_percent",
        "briefing",
    )


def nested_export(selection: DataFrame) -> DataFrame:
    """The JSON shape of the export: the campaign and pipeline parts as sub-objects. A selection without probability or briefing has none in its JSON."""
    chance = [F.col("probability_percent").alias("probabilityPercent")] if "probability_percent" in selection.columns else []
    briefing = [F.col("briefing").alias("briefingTitle")] if "briefing" in selection.columns else []
    return selection.select(
        "lead", "company", "status", "quality", "best_country", "best_category",
        F.when(
            F.col("last_campaign").isNotNull(),
            F.struct(F.col("last_campaign").alias("id"), F.col("campaign_status").alias("status"), F.col("campaign_on").alias("sentAt")),
        ).alias("lastCampaign"),
        F.when(F.col("stage").isNotNull(), F.struct("stage", F.col("estimated_value").alias("estimatedValue"), *chance)).alias("pipeline"),
        *briefing,
    )


def unify_scores(corridor: DataFrame, brand: DataFrame) -> DataFrame:
    """Both grains in one table; corridor rows have no brand."""
    cols = [*CORRIDOR, "category_score", "brand_score", "ni_score", "composite_score"]
    return corridor.select(F.lit(None).cast("string").alias("brand"), *cols).unionByName(brand.select("brand", *cols))


def fire_rules(scores: DataFrame, rules: DataFrame, per_rule: int = 50) -> DataFrame:
    """Scores above a rule's threshold, the top 50 per rule. Rules are a short fixed list (broadcast)."""
    pick = F.when(F.col("metric") == "composite_score", F.col("composite_score")).when(F.col("metric") == "category_score", F.col("category_score"))
    metric = pick.when(F.col("metric") == "brand_score", F.col("brand_score"))
    hits = scores.join(F.broadcast(rules), metric > F.col("threshold"))
    w = Window.partitionBy("rule").orderBy(F.desc("metric_value"), "country", "category", F.asc_nulls_first("brand"))
    return hits.withColumn("metric_value", metric).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_rule)


def alert_title(prefix: str) -> Column:
    return F.format_string(f"{prefix}: %s x %s", "category", "country")


def alerts(fired: DataFrame, recent: DataFrame) -> DataFrame:
    """One alert per new title among the fired alert rules; the first rule by name wins a shared title."""
    rows = fired.filter("action = 'alert_insight'").withColumn("title", alert_title("High-score alert"))
    fresh = rows.join(recent, "title", "left_anti")
    pick = F.min_by(F.struct("rule", "metric_value", "composite_score"), F.struct("rule", "rank"))
    return fresh.groupBy("title").agg(pick.alias("b")).select("title", "b.rule", "b.metric_value", "b.composite_score")


def approvals(fired: DataFrame, leads: DataFrame) -> DataFrame:
    """Leads whose brand a rule approves: new or reviewed ones become approved, others keep their status."""
    chosen = fired.filter("action = 'approve_lead' AND brand IS NOT NULL").select("brand").distinct().withColumn("hit", F.lit(True))
    change = F.col("hit").isNotNull() & F.col("linked") & F.col("status").isin("new", "reviewed")
    return leads.join(chosen, "brand", "left").withColumn("status", F.when(change, "approved").otherwise(F.col("status"))).drop("hit")


def top_brands(brand_scores: DataFrame, per_category: int = 3) -> DataFrame:
    best = best_by(brand_scores, ["brand", "category"], "composite_score", ["country"], ["composite_score", "country"])
    w = Window.partitionBy("category").orderBy(F.desc("composite_score"), "brand")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_category)


def stage_rollup(campaigns: DataFrame) -> DataFrame:
    """Count and value per stage of each lead's latest campaign, with the total and the win rate."""
    current = latest_campaign(campaigns).select(F.col("last.stage").alias("stage"), F.col("last.cents").alias("cents"))
    won = F.count_if(F.col("stage") == "won")
    closed = F.count_if(F.col("stage").isin("won", "lost"))
    return (
        current.rollup("stage")
        .agg(F.count("*").alias("leads"), F.coalesce(F.sum("cents"), F.lit(0)).alias("c"), won.alias("won"), closed.alias("closed"))
        .select(
            F.coalesce("stage", F.lit("all")).alias("stage"),
            "leads",
            (F.col("c") / 100.0).alias("value"),
            half_up(F.when(F.col("closed") > 0, F.col("won") / F.col("closed") * 100.0)).alias("win_rate_pct"),
        )
    )


def exhibitor_match(exhibitors: DataFrame, brands: DataFrame, brand_scores: DataFrame, show_categories: DataFrame) -> DataFrame:
    """Exhibitors matched to brands by name, with the brand's best score in the show's categories."""
    known = brands.select(F.lower("brand").alias("lower_name"), "brand", "eu_presence", "has_store")
    named = exhibitors.withColumn("lower_name", F.lower("exhibitor")).join(known, "lower_name", "left")
    in_show = show_categories.select("show_id", "category").join(brand_scores.select("brand", *CORRIDOR, "composite_score"), "category")
    best = best_by(in_show, ["show_id", "brand"], "composite_score", CORRIDOR, ["composite_score", *CORRIDOR])
    score = F.col("composite_score")
    pitch = (
        F.when(F.col("brand").isNull(), "introduce")
        .when(score >= 70, "priority")
        .when(~F.col("eu_presence"), "first_entry")
        .when(F.col("has_store"), "store_led")
        .otherwise("nurture")
    )
    return named.join(best, ["show_id", "brand"], "left").select(
        "show_id", "suppkey", "exhibitor", "brand", score.alias("best_score"), F.col("country").alias("best_country"),
        F.col("category").alias("best_category"), pitch.alias("pitch"),
    )


def match_rate(shows: DataFrame, show_categories: DataFrame, matched: DataFrame, as_of: str = dims.AS_OF) -> DataFrame:
    """Over all shows to come that have a known category: shows, exhibitors, those found among the brands, and their share (0 without any)."""
    coming = shows.filter(F.col("start_on") >= F.lit(as_of).cast("date")).join(show_categories.select("show_id").distinct(), "show_id").select("show_id")
    per_show = matched.groupBy("show_id").agg(F.count("*").alias("e"), F.count("brand").alias("m"))
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    return coming.join(per_show, "show_id", "left").agg(F.count("*").alias("shows"), total("e").alias("exhibitors"), total("m").alias("matched")).withColumn(
        "match_rate", half_up(F.when(F.col("exhibitors") > 0, F.col("matched") / F.col("exhibitors")).otherwise(0.0), 6)
    )


def playbook(shows: DataFrame, show_categories: DataFrame, matched: DataFrame, corridor_scores: DataFrame, coverage: DataFrame, top: DataFrame,
             as_of: str = dims.AS_OF, shown: int | None = None) -> DataFrame:
    """One row per upcoming show: categories, its corridors by score (all, or the first ``shown``), exhibitor cards, coverage gaps, pipeline brands."""
    names = show_categories.groupBy("show_id").agg(F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))
    in_show = show_categories.select("show_id", "category").join(corridor_scores.select(*CORRIDOR, "composite_score"), "category")
    w = Window.partitionBy("show_id").orderBy(F.desc("composite_score"), *CORRIDOR)
    ranked = in_show.withColumn("rank", F.row_number().over(w))
    ranked = (ranked if shown is None else ranked.filter(F.col("rank") <= shown)).join(coverage, CORRIDOR, "left")
    corridors = ranked.groupBy("show_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", *CORRIDOR))), lambda s: F.concat_ws("/", s["category"], s["country"])), "; "
        ).alias("corridors"),
        F.count_if("coverage_gap").alias("gaps"),
    )
    cards = matched.groupBy("show_id").agg(F.count("*").alias("exhibitors"), F.count("brand").alias("matched"))
    pipeline = (
        show_categories.select("show_id", "category").join(top.select("brand", "category"), "category")
        .groupBy("show_id").agg(F.array_join(F.sort_array(F.collect_set("brand")), ",").alias("pipeline_brands"))
    )
    return (
        shows.filter(F.col("start_on") >= F.lit(as_of).cast("date")).select("show_id", "show_name")
        .join(names, "show_id")
        .join(corridors, "show_id", "left")
        .join(cards, "show_id", "left")
        .join(pipeline, "show_id", "left")
        .select("show_id", "show_name", "categories", "corridors", "gaps", F.coalesce("exhibitors", F.lit(0)).alias("exhibitors"),
                F.coalesce("matched", F.lit(0)).alias("matched"), "pipeline_brands")
    )


def discovered_leads(sources: list[DataFrame], existing: DataFrame) -> DataFrame:
    """Union of lead sources, the earlier source winning a shared key, without the leads already known.

    Each source has (key, company, source); its place in the list is its rank.
    """
    ranked = None
    for rank, df in enumerate(sources):
        part = df.select("key", "company", "source", F.lit(rank).alias("rank"))
        ranked = part if ranked is None else ranked.unionByName(part)
    first = ranked.groupBy("key").agg(F.min_by(F.struct("company", "source"), F.struct("rank", "company")).alias("b"))
    return first.join(existing, "key", "left_anti").select("key", "b.company", "b.source")
