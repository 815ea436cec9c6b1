"""Entity resolution: substring name match, URL match, portfolio edges, distributor discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradewind.functions import text
from tradewind.sources import dims

#: Shortest name that is matched, and the longest gram that names are joined on.
GRAM, LONG_GRAM = 3, 12


def clean_query(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", ""))


def clean_target(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[^a-zA-Z0-9 ]", ""))


def _grams(name: Column, size: Column) -> Column:
    """Different substrings of one size; none of a shorter name."""
    n = F.length(name) - size + 1
    at = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(name, i, size)))


def substring_candidates(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(q, id, t): cleaned queries with the targets that share the query's rarest gram.

    A target that contains a query contains every gram of it, so joining on any one gram loses nothing. A
    query of up to LONG_GRAM characters is its own gram, so all its candidates are hits; a longer one uses
    its rarest gram of that size, and a gram no target has rules it out. Work is per distinct cleaned name.
    """
    q = queries.select(clean_query(F.col("name")).alias("q")).filter(F.length("q") >= GRAM).distinct().withColumn("size", F.least(F.length("q"), F.lit(LONG_GRAM)))
    t = targets.select("id", clean_target(F.col("name")).alias("t")).filter(F.length("t") >= GRAM)
    sizes = [r["size"] for r in q.select("size").distinct().collect()]  # LONG_GRAM - GRAM + 1 at most
    by_gram = t.select("id", "t", F.explode(F.concat(F.array().cast("array<string>"), *[_grams(F.col("t"), F.lit(n)) for n in sizes])).alias("gram"))
    frequency = by_gram.groupBy("gram").agg(F.count("*").alias("df"))
    wanted = q.select("q", F.explode(_grams(F.col("q"), F.col("size"))).alias("gram")).join(frequency, "gram", "left")
    rarest = (
        wanted.groupBy("q")
        .agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"), F.count_if(F.col("df").isNull()).alias("missing"))
        .filter("missing = 0")
    )
    return rarest.join(by_gram, "gram").select("q", "id", "t")


def substring_match(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """First target (lowest id) whose cleaned name contains the cleaned query name.

    ``queries`` has ``name``, ``targets`` has (``id``, ``name``).
    """
    hits = substring_candidates(queries, targets).filter(F.col("t").contains(F.col("q")))
    first = hits.groupBy("q").agg(F.min("id").alias("id"))
    return queries.withColumn("q", clean_query(F.col("name"))).join(first, "q", "left").drop("q")


def url_match(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates (``url``) joined to known sites (``site``, ``owner``) on the normalised origin."""
    sites = known.select(text.origin(F.col("site")).alias("origin"), "owner").groupBy("origin").agg(F.min("owner").alias("owner"))
    return candidates.withColumn("origin", text.origin(F.col("url"))).join(sites, "origin", "left")


def portfolio_edges(audits: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (distributor, brand) edges named in audit JSON; buyer name first, else retailer name."""
    field = lambda k: F.get_json_object("payload", f"$.{k}")
    parsed = audits.select(
        field("brandName").alias("brand"), F.coalesce(field("buyerName"), field("retailerName")).alias("name"), field("category").alias("category")
    ).filter("brand IS NOT NULL AND name IS NOT NULL")
    return (
        substring_match(parsed, targets)
        .filter("id IS NOT NULL")
        .groupBy(F.col("id").alias("suppkey"), "brand")
        .agg(F.max("category").alias("category"), F.lit(0.9).alias("confidence"))
    )


def discover_distributors(candidates: DataFrame, booths: DataFrame) -> DataFrame:
    """Flagged candidates and booths that speak of distribution, one per (name, country); candidates first."""
    country = F.coalesce(F.nullif(F.col("countryCode"), F.lit("")), text.tld_country(F.col("websiteUrl")), F.lit("EU"))
    flagged = candidates.filter("isDistributor").select(F.trim("companyName").alias("name"), country.alias("country"), F.lit("directory").alias("source"))
    words = "|".join(dims.DISTRIBUTOR_WORDS)
    shown = booths.filter(F.lower("booth").rlike(words)).select(F.trim("exhibitor").alias("name"), F.lit("EU").alias("country"), F.lit("trade_show").alias("source"))
    return (
        flagged.unionByName(shown)
        .filter(F.length("name") >= 2)
        .groupBy(F.lower("name").alias("key"), "country")
        .agg(F.min_by(F.struct("name", "source"), F.struct("source", "name")).alias("b"))
        .select("key", "country", "b.name", "b.source")
    )
