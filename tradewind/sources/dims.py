"""Fixed dimensions: weights, dictionaries, keyword lists and thresholds.

Every value here is a constant that results depend on; changing one changes scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Reference dates. The order tables end in 2001; all trailing windows count back from here.
AS_OF = "2001-08-01"
AS_OF_YM = 200108
TRADE_YEARS = [1996, 1997, 1998, 1999, 2000]
MONTH_RANGE = (199901, 200012)
EVENTS_AS_OF = "2024-01-31"

# Which (supplier region, customer region) pair is which named flow.
FLOW_ROUTES = {
    ("AMERICA", "EUROPE"): "us_to_eu",
    ("EUROPE", "AMERICA"): "eu_to_us",
    ("AMERICA", "ASIA"): "us_to_uk",
    ("ASIA", "EUROPE"): "uk_to_eu",
}

# Currency.
USD_PER_EUR = 1.08

# Scoring weights.
COMPOSITE_WEIGHTS = {"category": 0.40, "brand": 0.35, "ni": 0.25}
CATEGORY_WEIGHTS = {"demand": 0.30, "margin": 0.25, "regulatory": 0.25, "logistics": 0.20}
BRAND_WEIGHTS = {"demand": 0.375, "fit": 0.3125, "logistics": 0.3125}
NI_WEIGHTS = {"vat_advantage": 0.40, "distribution_efficiency": 0.30, "regulatory_clarity": 0.30}
GAP_WEIGHTS = {"demand": 0.40, "imports": 0.35, "density": 0.25}
DEFAULT_RELIANCE = 0.30

# Regulatory burden per category, 0 = none (0.5 when a category is not listed).
REGULATORY_COMPLEXITY = {
    "ECONOMY": 0.2,
    "LARGE": 0.4,
    "MEDIUM": 0.5,
    "PROMO": 0.8,
    "SMALL": 0.3,
}

# Tier thresholds and bonuses.
TIERS = [("breakthrough", 0.50), ("accelerating", 0.25), ("sustained", 0.10), ("mature", 0.05)]
WATCH_VOLATILITY = 0.45
CONFIDENCE_FLOOR = 0.85
TIER_BONUS = {
    "breakthrough": 100.0,
    "accelerating": 75.0,
    "sustained": 50.0,
    "mature": 25.0,
    "disrupted": 30.0,
    "watch": 10.0,
}
TIER_BASE = {
    "breakthrough": 40.0,
    "accelerating": 32.0,
    "sustained": 24.0,
    "mature": 16.0,
    "disrupted": 28.0,
    "watch": 8.0,
}

# Markets scored at full and at partial coverage.
TARGET_MARKETS = ["NATION_3", "NATION_8", "NATION_13", "NATION_18", "NATION_23"]
FLAG_ORDER = {"low": 1, "medium": 2, "high": 3}

# Regulatory flags made for the test categories (category, market, risk, kind, description). EU means every market.
REGULATORY_FLAGS = [
    ("MEDIUM", "EU", "low", "packaging", "Packaging has to be registered by volume"),
    ("PROMO", "NATION_2", "high", "advertising", "Prize draws need a licence"),
    ("PROMO", "EU", "low", "advertising", "Terms of an offer stand on the pack"),
    ("LARGE", "NATION_11", "medium", "transport", "Oversize loads need a permit"),
    ("STANDARD", "NATION_17", "low", "language", "Manuals in the local language"),
    ("ECONOMY", "NATION_6", "medium", "pricing", "Unit prices have to be shown"),
    ("MEDIUM", "NATION_20", "high", "safety", "Each batch is tested before sale"),
    ("SMALL", "NATION_14", "medium", "safety", "A warning on small parts"),
    ("LARGE", "EU", "low", "energy", "Energy use class on the label"),
    ("SMALL", "NATION_6", "low", "waste", "Take-back scheme for old devices"),
]

# Stages of open business, the furthest first, with the probability of a close in percent.
PIPELINE_PROBABILITY = {"negotiation": 80, "proposal": 60, "meeting": 40, "contact": 20, "prospect": 10}

# Alert and approval rules (name, metric, threshold, action).
TRIGGER_RULES = [
    ("high_composite", "composite_score", 45.0, "alert_insight"),
    ("high_category", "category_score", 50.0, "alert_insight"),
    ("strong_brand_fit", "brand_score", 75.0, "approve_lead"),
]

# Category words used to recognise a show or a label.
SHOW_KEYWORDS = {
    "ECONOMY": ["economy", "budget"],
    "LARGE": ["large", "bulk"],
    "MEDIUM": ["medium", "midsize"],
    "PROMO": ["promo", "offer"],
    "SMALL": ["small", "compact"],
    "STANDARD": ["standard", "classic"],
}

# Names a brand may use for a category, matched as text in either direction.
CATEGORY_SYNONYMS = {
    "ECONOMY": ["economy", "budget"],
    "LARGE": ["large", "bulk"],
    "MEDIUM": ["medium", "small to medium"],
    "PROMO": ["promo", "large promotional"],
    "SMALL": ["small", "compact"],
    "STANDARD": ["standard", "classic"],
}

# Keywords of the product sub-categories and the group each belongs to.
SUBCATEGORY_KEYWORDS = {
    "bolts_small": ["small", "bolt"],
    "bolts_large": ["large", "bolt"],
    "gears": ["gear", "rod", "small"],
    "gizmos": ["gizmo", "widget", "hot"],
    "plates": ["anvil", "plate", "blue"],
    "rings": ["ring", "red"],
}
SUBCATEGORY_GROUP = {
    "bolts_small": "fasteners",
    "bolts_large": "fasteners",
    "rings": "fasteners",
    "gears": "machinery",
    "gizmos": "consumer",
    "plates": "materials",
}
MIN_KEYWORD_DENSITY = 0.08

# A small product taxonomy (node, parent, level, keywords).
TAXONOMY = [
    ("hardware", None, 1, ["bolt", "ring", "gear"]),
    ("hardware_fasteners", "hardware", 2, ["bolt", "small bolt", "large bolt"]),
    ("hardware_fasteners_small", "hardware_fasteners", 3, ["small bolt", "small ring"]),
    ("hardware_drive", "hardware", 2, ["gear", "small gear", "large gear"]),
    ("consumer", None, 1, ["widget", "gizmo"]),
    ("consumer_gizmos", "consumer", 2, ["gizmo", "red gizmo", "blue gizmo"]),
    ("consumer_widgets", "consumer", 2, ["widget", "red widget", "blue widget"]),
    ("consumer_widgets_red", "consumer_widgets", 3, ["red widget"]),
]

# Weighted segment keywords; a segment needs a total of 5.
SEGMENT_KEYWORDS = {
    "fastening": [("bolt", 5), ("ring", 3), ("small", 1)],
    "drive": [("gear", 6), ("large", 1)],
    "gifts": [("gizmo", 4), ("widget", 4), ("red", 2), ("blue", 1)],
}
SEGMENT_FLOOR = 5

# Reply sentiment words; the negative list is tested first.
NEGATIVE_REPLY = ["not interested", "unsubscribe", "remove", "stop", "no thanks", "do not contact"]
POSITIVE_REPLY = ["interested", "yes", "sounds good", "tell me more", "schedule", "call", "meeting", "great"]

# Label dictionary and aliases for free-text category labels.
LABEL_MAP = {
    "building": "home_goods",
    "furniture": "home_goods",
    "household": "home_goods",
    "automobile": "toys_games",
    "machinery": "toys_games",
}
CATEGORY_ALIASES = {
    "home_goods": ["home_goods", "household", "furniture", "home", "building"],
    "toys_games": ["toys_games", "automobile", "mobile", "play"],
    "tools": ["tools", "machine"],
}

# Top-level domain to market.
TLD_COUNTRY = {
    "de": "DE",
    "fr": "FR",
    "nl": "NL",
    "be": "BE",
    "es": "ES",
    "it": "IT",
    "uk": "GB",
    "co": "GB",
    "ie": "IE",
    "at": "AT",
    "pl": "PL",
    "se": "SE",
    "dk": "DK",
}

# Chapter prefix to category for commodity codes; the four-digit prefix is tested first.
CHAPTER_CATEGORY = {
    "2106": "SMALL",
    "21": "ECONOMY",
    "33": "LARGE",
    "39": "MEDIUM",
    "94": "PROMO",
    "95": "STANDARD",
}
CATEGORY_CODE = {
    "ECONOMY": "210320",
    "LARGE": "330499",
    "MEDIUM": "392490",
    "PROMO": "940360",
    "SMALL": "210690",
    "STANDARD": "950300",
}


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal dimension as a local relation: its size is fixed in code and known to the planner."""

    def literal(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("'", "\\'") + "'"
        return f"{value}D" if isinstance(value, float) else str(value)

    names = ", ".join(part.split()[0] for part in schema.split(", "))
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS d({names})")


def regulatory_flags(spark: SparkSession) -> DataFrame:
    return frame(spark, REGULATORY_FLAGS, "category string, market string, risk string, kind string, description string")


def trigger_rules(spark: SparkSession) -> DataFrame:
    return frame(spark, TRIGGER_RULES, "rule string, metric string, threshold double, action string")


def show_keywords(spark: SparkSession) -> DataFrame:
    rows = [(c, k) for c, words in SHOW_KEYWORDS.items() for k in words]
    return frame(spark, rows, "category string, keyword string")


def category_synonyms(spark: SparkSession) -> DataFrame:
    rows = [(c, a) for c, words in CATEGORY_SYNONYMS.items() for a in words]
    return frame(spark, rows, "category string, alias string")


def subcategory_keywords(spark: SparkSession) -> DataFrame:
    rows = [(label, SUBCATEGORY_GROUP[label], k) for label, words in SUBCATEGORY_KEYWORDS.items() for k in words]
    return frame(spark, rows, "label string, parent string, keyword string")


def segment_keywords(spark: SparkSession) -> DataFrame:
    rows = [(s, k, w) for s, words in SEGMENT_KEYWORDS.items() for k, w in words]
    return frame(spark, rows, "segment string, keyword string, weight int")


def taxonomy_keywords(spark: SparkSession) -> DataFrame:
    """One row per (node, keyword) with the node's depth and its path from the root."""
    parents = {node: parent for node, parent, _, _ in TAXONOMY}

    def path(node: str) -> str:
        names = []
        step: str | None = node
        while step:
            names.append(step)
            step = parents[step]
        return " > ".join(reversed(names))

    rows = [(node, level, path(node), k, len(k.split())) for node, _, level, words in TAXONOMY for k in words]
    return frame(spark, rows, "node string, level int, path string, keyword string, weight int")


def label_aliases(spark: SparkSession) -> DataFrame:
    rows = [(c, a) for c, words in CATEGORY_ALIASES.items() for a in words]
    return frame(spark, rows, "category string, alias string")

# Words in a distributor's description and the category they point to, tested in this order.
DESCRIPTION_RULES = [
    ("SMALL", ["small", "rod"]),
    ("LARGE", ["large", "plate"]),
    ("PROMO", ["new", "gizmo"]),
    ("STANDARD", ["old", "anvil"]),
    ("ECONOMY", ["red", "blue"]),
]

# Job titles that show a buying role.
BUYER_ROLES = ["buyer", "purchasing", "procurement", "category manager", "buying manager", "head of buying", "sourcing"]

# Strength of each kind of buying evidence.
INTENT_STRENGTH = {"category": 0.3, "description": 0.4, "show": 0.7, "job": 0.9}

# Words in booth information that mark a distributor.
DISTRIBUTOR_WORDS = ["distributor", "importer", "wholesaler", "buyer", "procurement", "import"]
