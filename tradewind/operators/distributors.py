"""Distributor intent, score, matching with leads, and competitor proximity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradewind.functions.numeric import half_up
from tradewind.sources import dims
from tradewind.sources.tables import grows

PROFILE = ["country", "profile"]


def text_category(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Category of a text: the first rule with a word the text contains."""
    out = None
    for name, words in rules:
        test = F.lit(False)
        for word in words:
            test = test | text.contains(word)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def audit_rows(distributors: DataFrame) -> DataFrame:
    """Profile audits as JSON: company and the job titles found there."""
    key = F.col("suppkey")
    title = F.when(key % 7 == 0, "Purchasing Manager").when(key % 7 == 1, "Category Buyer").otherwise("Engineer")
    return distributors.filter("has_profile").select(F.to_json(F.struct(F.col("name").alias("companyName"), title.alias("jobTitles"))).alias("payload"))


def buyer_companies(audits: DataFrame) -> DataFrame:
    """Lower-case names of companies whose audit names a buying role."""
    roles = F.lower(F.get_json_object("payload", "$.jobTitles"))
    return (
        audits.filter(roles.rlike("|".join(dims.BUYER_ROLES)))
        .select(F.lower(F.get_json_object("payload", "$.companyName")).alias("lower_name"))
        .distinct()
    )


def buying_intent(
    distributors: DataFrame, categories: DataFrame, exhibitors: DataFrame, show_categories: DataFrame, audits: DataFrame
) -> DataFrame:
    """Strongest evidence per (distributor, category) over four kinds, with the sources seen."""
    level = dims.INTENT_STRENGTH
    row = lambda df, strength, source: df.select("suppkey", "category", F.lit(strength).alias("strength"), F.lit(source).alias("source"))
    named = distributors.withColumn("lower_name", F.lower("name"))
    described = distributors.withColumn("category", text_category(F.lower("description"), dims.DESCRIPTION_RULES)).filter("category IS NOT NULL")
    booths = exhibitors.select("show_id", F.lower("exhibitor").alias("lower_name"))
    shown = named.select("suppkey", "lower_name").join(grows(booths), "lower_name").join(show_categories, "show_id")
    buyers = named.join(grows(buyer_companies(audits)), "lower_name", "left_semi").select("suppkey").join(grows(categories), "suppkey")
    evidence = (
        row(categories, level["category"], "directory")
        .unionByName(row(described, level["description"], "directory"))
        .unionByName(row(shown, level["show"], "trade_show"))
        .unionByName(row(buyers, level["job"], "linkedin_job"))
    )
    return evidence.groupBy("suppkey", "category").agg(
        F.max("strength").alias("strength"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources")
    )


def distributor_score(distributors: DataFrame, categories: DataFrame, active: DataFrame, intent: DataFrame) -> DataFrame:
    """0-100 from category alignment, market coverage, mean intent and contact completeness."""
    aligned = (
        categories.join(active.withColumn("hit", F.lit(1)), "category", "left")
        .groupBy("suppkey")
        .agg((F.count("hit") / F.count("*")).alias("alignment"))
    )
    activity = intent.groupBy("suppkey").agg(F.avg("strength").alias("activity"))
    coverage = F.when(F.col("country").isin(dims.TARGET_MARKETS), 1.0).when(F.col("region") == "EUROPE", 0.6).otherwise(0.2)
    have = lambda c, w: F.when(F.col(c), F.lit(w)).otherwise(0.0)
    contact = have("has_email", 0.4) + have("has_site", 0.3) + have("has_profile", 0.3)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    total = zero("alignment") * 0.35 + coverage * 0.30 + zero("activity") * 0.25 + contact * 0.10
    return (
        distributors.join(grows(aligned), "suppkey", "left")
        .join(grows(activity), "suppkey", "left")
        .select("suppkey", "country", half_up(zero("alignment"), 6).alias("alignment"), half_up(zero("activity"), 6).alias("activity"),
                F.floor(F.round(total * 100, 6) + 0.5).cast("int").alias("score"))
    )


def lead_profiles(leads: DataFrame, brand_categories: DataFrame) -> DataFrame:
    """Each lead with its profile: the sorted list of its categories, as one key; its best category for a brand without any.

    ``leads`` carries its resolved corridor (country, category). Matching depends on a lead only through that country and
    its categories, so it is done once per (country, profile) and leads look the result up; pairs of leads and
    distributors are never formed. A lead without a corridor has no country and finds nothing.
    """
    profiles = brand_categories.groupBy("brand").agg(F.array_join(F.sort_array(F.collect_set("category")), ",").alias("profile"))
    return leads.join(profiles, "brand", "left").withColumn("profile", F.coalesce("profile", "category", F.lit("")))


def profile_categories(leads_with_profile: DataFrame) -> DataFrame:
    """Distinct (country, profile) of the leads with a corridor, one row per category of the profile."""
    distinct = leads_with_profile.filter("country IS NOT NULL").select(*PROFILE).distinct()
    listed = F.split("profile", ",")
    return distinct.select(*PROFILE, F.size(listed).alias("n_categories"), F.explode(listed).alias("category"))


def match(profiles: DataFrame, distributors: DataFrame, categories: DataFrame, intent: DataFrame, scores: DataFrame) -> DataFrame:
    """Distributors of a profile's country, the leads' best corridor's, with a shared category, scored; at least 0.30 to stay."""
    supply = (
        categories.join(grows(distributors.select("suppkey", "name", "country")), "suppkey")
        .join(grows(intent.select("suppkey", "category", "strength")), ["suppkey", "category"], "left")
    )
    strength = F.coalesce("max_intent", F.lit(0.0))
    overlap = F.col("overlap") / F.col("n_categories")
    total = F.round(0.50 * overlap + 0.35 * strength + 0.15 * F.col("score") / 100.0, 9)
    return (
        profiles.join(supply, ["country", "category"])
        .groupBy(*PROFILE, "suppkey", "name", "n_categories")
        .agg(F.count("*").alias("overlap"), F.max("strength").alias("max_intent"))
        .join(grows(scores.select("suppkey", "score")), "suppkey")
        .withColumn("match_score", total)
        .filter("match_score >= 0.30")
        .select(
            *PROFILE,
            "suppkey",
            "name",
            half_up(overlap, 6).alias("category_overlap"),
            half_up(strength, 6).alias("max_intent"),
            half_up(F.col("match_score"), 6).alias("match_score"),
            F.array_join(
                F.filter(
                    F.array(F.lit("category_alignment"), F.when(strength > 0.5, "intent_signal"), F.lit("country_match")),
                    lambda r: r.isNotNull(),
                ),
                ",",
            ).alias("reasons"),
        )
    )


def match_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy(*PROFILE).agg(F.count("*").alias("matches"), F.max("match_score").alias("best_match"))


def match_top(matches: DataFrame, k: int = 5) -> DataFrame:
    """Best k distributors per profile; tasks keep k rows per group before the shuffle."""
    w = Window.partitionBy(*PROFILE).orderBy(F.desc("match_score"), "suppkey")
    return matches.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def lead_category(profile: Column) -> Column:
    return F.split(profile, ",").getItem(0)


def proximity(matches: DataFrame, portfolio: DataFrame, lead_labels: DataFrame) -> DataFrame:
    """Exact and adjacent competitors in a distributor's portfolio and the adjusted match score.

    ``portfolio`` holds (suppkey, label, parent, n); ``lead_labels`` the (brand, profile, label, parent) sought.
    The factor always applies to the base score, so a second run changes nothing.
    """
    sought = lead_labels.withColumnsRenamed({"label": "lead_label", "parent": "lead_parent"})
    exact, adjacent = F.col("exact"), F.col("adjacent")
    near = F.when(exact > 0, "exact").when(adjacent > 0, "adjacent")
    factor = F.when(exact > 0, 0.85).when(adjacent > 0, 1.05).otherwise(1.0)
    same = F.col("label") == F.col("lead_label")
    return (
        matches.select(*PROFILE, "suppkey", "match_score")
        .join(F.broadcast(sought), "profile")  # a row for each profile of a brand
        .join(grows(portfolio), "suppkey")
        .groupBy(*PROFILE, "brand", "suppkey", "match_score")
        .agg(
            F.sum(F.when(same, F.col("n")).otherwise(0)).alias("exact"),
            F.sum(F.when(~same & (F.col("parent") == F.col("lead_parent")), F.col("n")).otherwise(0)).alias("adjacent"),
        )
        .select(
            *PROFILE,
            "brand",
            "suppkey",
            near.alias("proximity"),
            (exact + adjacent).alias("competitors"),
            half_up(F.least(F.col("match_score") * factor, F.lit(1.0)), 6).alias("adjusted_score"),
        )
    )


def regulatory_risk(corridors: DataFrame, flags: DataFrame) -> DataFrame:
    """Highest risk of the flags on a corridor's category in its country or in the whole market; low without any.

    ``corridors`` are (country, category) of leads, repeats allowed; one row each comes back.
    """
    key = ["country", "category"]
    order = F.create_map(*[x for k, v in dims.FLAG_ORDER.items() for x in (F.lit(k), F.lit(v))])
    best = F.coalesce(F.max("level"), F.lit(1))
    return (
        corridors.filter("country IS NOT NULL").select(*key).distinct()
        .join(flags, "category", "left")
        .withColumn("level", F.when(F.col("market").isin("EU") | (F.col("market") == F.col("country")), F.try_element_at(order, F.col("risk"))))
        .groupBy(*key)
        .agg(F.count("level").alias("flags"), best.alias("level"))
        .select(*key, "flags", F.element_at(F.array(*[F.lit(k) for k in dims.FLAG_ORDER]), F.col("level")).alias("risk"))
    )


def coverage(categories: DataFrame, distributors: DataFrame, corridors: DataFrame, shown: int = 10) -> DataFrame:
    """Distributors per corridor, all counted, with the first ``shown`` names for the report; one or none is a gap."""
    key = ["country", "category"]
    local = categories.join(grows(distributors.select("suppkey", "name", "country")), "suppkey")
    w = Window.partitionBy(*key).orderBy("name")
    names = (
        local.withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= shown)
        .groupBy(*key)
        .agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"))
    )
    counts = local.groupBy(*key).agg(F.count("*").alias("distributors"))
    n = F.coalesce("distributors", F.lit(0))
    return corridors.join(counts, key, "left").join(names, key, "left").select(*key, n.alias("distributors"), "names", (n <= 1).alias("coverage_gap"))
