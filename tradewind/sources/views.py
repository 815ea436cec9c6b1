"""Market-shaped views over the star-schema tables.

Money is summed as whole cents, so totals do not depend on the order in which partitions arrive.
Raw rows are read once per view and reduced map-side; what leaves a view is bounded by dimensions
(regions, nations, product types, months), not by the number of order lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradewind.functions.numeric import cents, half_up, money, ratio
from tradewind.sources import dims
from tradewind.sources.stages import stage
from tradewind.sources.tables import Tables, grows, hashed, trailing


def flow_type(reporter: Column, partner_region: Column) -> Column:
    out = None
    for (source, target), name in dims.FLOW_ROUTES.items():
        test = (reporter == source) & (partner_region == target)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


def nations(t: Tables, prefix: str) -> DataFrame:
    """A fixed table of names, so it is the side that is broadcast, whatever the size of the other."""
    return F.broadcast(
        t.read("nation")
        .join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_nationkey").alias(f"{prefix}_nationkey"),
            F.col("n_name").alias(f"{prefix}_nation"),
            F.col("r_name").alias(f"{prefix}_region"),
        )
    )


def customers(t: Tables) -> DataFrame:
    return (
        t.read("customer")
        .join(nations(t, "cust"), F.col("c_nationkey") == F.col("cust_nationkey"))
        .select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "cust_nation", "cust_region")
    )


def suppliers(t: Tables) -> DataFrame:
    return (
        t.read("supplier")
        .join(nations(t, "supp"), F.col("s_nationkey") == F.col("supp_nationkey"))
        .select("s_suppkey", "s_name", "s_acctbal", "s_nationkey", "supp_nation", "supp_region")
    )


def facts(t: Tables) -> DataFrame:
    """Order lines with their part, supplier, order and customer rows.

    Parts and customers are shuffled and hashed: their broadcasts grew with the input while their files stayed under
    the planner's threshold, and a merge sorts all lines. The tables are joined bare; only the columns a caller uses reach the scans.
    """
    # Orders meet their customers first: customers then cost a shuffle of orders, not of lines, and a filter on order dates
    # cuts the lines before they meet the parts.
    orders = t.read("orders").join(hashed(t.read("customer")), F.col("o_custkey") == F.col("c_custkey"))
    return (
        t.read("lineitem")
        .join(t.read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(hashed(t.read("part")), F.col("l_partkey") == F.col("p_partkey"))
    )


def lines(t: Tables) -> DataFrame:
    """Order lines with buyer, seller and product attributes."""
    return (
        facts(t)
        .join(nations(t, "supp"), F.col("s_nationkey") == F.col("supp_nationkey"))
        .join(nations(t, "cust"), F.col("c_nationkey") == F.col("cust_nationkey"))
        .select(
            F.col("supp_region").alias("reporter"),
            F.col("cust_nation").alias("partner"),
            F.col("cust_region").alias("partner_region"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
            F.col("l_suppkey").alias("suppkey"),
            F.col("c_custkey").alias("custkey"),
            "c_name",
            "o_orderkey",
            "o_orderdate",
            "o_orderpriority",
            "l_linenumber",
            F.col("l_shipdate").alias("ship"),
            cents(F.col("l_extendedprice")).alias("cents"),
            F.col("l_quantity").alias("qty"),
        )
    )


def corridor_cube(t: Tables, reuse: bool = False, start: str | None = None, until: str | None = None) -> DataFrame:
    """(seller region, buyer nation, product type, month) totals: the rollup most views start from.

    At most regions x nations x types x months rows. ``start`` and ``until`` (exclusive) bound the
    ship dates read, as scan filters. ``reuse`` stages the rollup for plans that read it several times.
    """
    rows = facts(t)
    if start:
        rows = rows.filter(F.col("l_shipdate") >= F.lit(start))
    if until:
        rows = rows.filter(F.col("l_shipdate") < F.lit(until))
    # Summed by nation keys first: names join the few rows that are left.
    by_nation = rows.groupBy("s_nationkey", "c_nationkey", F.col("p_type").alias("category"), _ship_month().alias("ym")).agg(
        F.sum(cents(F.col("l_extendedprice"))).alias("cents"), F.sum("l_quantity").alias("qty"), F.count("*").alias("n")
    )
    cube = named_cube(t, by_nation)
    return stage(cube, "corridor_cube") if reuse else cube


def _ship_month() -> Column:
    return F.year("l_shipdate") * 100 + F.month("l_shipdate")


def _with_nations(t: Tables, rows: DataFrame) -> DataFrame:
    return rows.join(nations(t, "supp"), F.col("s_nationkey") == F.col("supp_nationkey")).join(nations(t, "cust"), F.col("c_nationkey") == F.col("cust_nationkey"))


def named_cube(t: Tables, by_nation: DataFrame) -> DataFrame:
    """The corridor rollup from totals by nation keys."""
    return (
        _with_nations(t, by_nation)
        .groupBy(
            F.col("supp_region").alias("reporter"), F.col("cust_nation").alias("partner"), F.col("cust_region").alias("partner_region"), "category", "ym"
        )
        .agg(F.sum("cents").alias("cents"), F.sum("qty").alias("qty"), F.sum("n").alias("n"))
    )


def market_rollup(t: Tables) -> DataFrame:
    """Totals by nations and product type, once a month (``monthly`` = 1) and once a brand (0), from one pass over the joined lines."""
    nation, month, brand = ["s_nationkey", "c_nationkey", "category"], "ym", "brand"
    rows = facts(t).select(
        "s_nationkey", "c_nationkey", F.col("p_type").alias("category"), _ship_month().alias(month), F.col("p_brand").alias(brand),
        cents(F.col("l_extendedprice")).alias("cents"), F.col("l_quantity").alias("qty"),
    )
    return rows.groupingSets([[*nation, month], [*nation, brand]], *nation, month, brand).agg(
        F.grouping(brand).alias("monthly"), F.sum("cents").alias("cents"), F.sum("qty").alias("qty"), F.count("*").alias("n")
    )


def supply_rollup(t: Tables) -> DataFrame:
    """Revenue and lines of a supplier, once a product type (``by_type`` = 1) and once a brand (0), from one pass over the lines."""
    rows = t.read("lineitem").join(hashed(t.read("part")), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("suppkey"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), cents(F.col("l_extendedprice")).alias("c")
    )
    return rows.groupingSets([["suppkey", "category"], ["suppkey", "brand"]], "suppkey", "category", "brand").agg(
        F.grouping("brand").alias("by_type"), F.sum("c").alias("c"), F.count("*").alias("n")
    )


def annual_cube(t: Tables, reuse: bool = False) -> DataFrame:
    """The rollup over the reference years only."""
    return corridor_cube(t, reuse, f"{dims.TRADE_YEARS[0]}-01-01", f"{dims.TRADE_YEARS[-1] + 1}-01-01")


def monthly_cube(t: Tables) -> DataFrame:
    """The rollup over the monthly period only: two years of the fact table instead of all."""
    first, last = (ym // 100 for ym in dims.MONTH_RANGE)
    return corridor_cube(t, False, f"{first}-01-01", f"{last + 1}-01-01")


def annual(cube: DataFrame) -> DataFrame:
    """Annual trade rows per (flow, reporter, partner, category)."""
    return (
        cube.withColumn("year", F.floor(F.col("ym") / 100).cast("int"))
        .filter(F.col("year").isin(dims.TRADE_YEARS))
        .groupBy(
            flow_type(F.col("reporter"), F.col("partner_region")).alias("flow"), "reporter", "partner", "category", "year"
        )
        .agg(F.sum("cents").alias("cents"), (F.sum("qty") * 40.0).alias("weight"))
        .withColumn("value", money(F.col("cents")))
        .withColumn("unit_value", half_up(ratio(F.col("value"), F.col("weight"))))
    )


def monthly(cube: DataFrame) -> DataFrame:
    low, high = dims.MONTH_RANGE
    return (
        cube.filter(F.col("ym").between(low, high))
        .groupBy(
            flow_type(F.col("reporter"), F.col("partner_region")).alias("flow"), "reporter", "partner", "category", "ym"
        )
        .agg(F.sum("cents").alias("cents"))
        .withColumn("value", money(F.col("cents")))
    )


def share(cube: DataFrame) -> DataFrame:
    """Import totals of a market by origin, one row per (country, category, year)."""
    origin = lambda region: F.sum(F.when(F.col("reporter") == region, F.col("cents")))
    return (
        cube.withColumn("year", F.floor(F.col("ym") / 100).cast("int"))
        .filter(F.col("year").isin(dims.TRADE_YEARS))
        .groupBy(F.col("partner").alias("country"), "category", "year")
        .agg(
            money(F.sum("cents")).alias("world"),
            money(origin("AMERICA")).alias("us"),
            money(origin("ASIA")).alias("cn"),
            money(origin("EUROPE")).alias("gb"),
        )
    )


def month_before(as_of: str, months: int) -> int:
    """The month (as 200107) that lies so many months before that of a date."""
    year, month = int(as_of[:4]), int(as_of[5:7])
    n = year * 12 + month - 1 - months
    return n // 12 * 100 + n % 12 + 1


def closed_years(as_of: str, n: int) -> list[int]:
    """The last years that are over at a date, the latest first."""
    return [int(as_of[:4]) - i for i in range(1, n + 1)]


def consumption(cube: DataFrame, as_of: str = dims.AS_OF, left_out: tuple[str, ...] = ("AMERICA", "ASIA")) -> DataFrame:
    """Domestic consumption proxy in EUR millions of the last two closed years: all arrivals from outside the regions left out."""
    return (
        cube.withColumn("year", F.floor(F.col("ym") / 100).cast("int"))
        .filter(F.col("year").isin(closed_years(as_of, 2)) & ~F.col("reporter").isin(*left_out))
        .groupBy(F.col("partner").alias("country"), "category", "year")
        .agg((money(F.sum("cents")) / dims.USD_PER_EUR / 1e6).alias("eur_m"))
    )


def trends(cube: DataFrame, as_of: str = dims.AS_OF) -> DataFrame:
    """One trend per (country, category): growth of the last 12 closed months on the 12 before, with its tier."""
    ym = F.col("ym")
    first, middle, last = (month_before(as_of, n) for n in (24, 12, 1))
    month = (
        cube.filter(ym.between(first, last))
        .groupBy(F.col("partner").alias("country"), "category", "ym")
        .agg(F.sum("cents").cast("double").alias("c"))
    )
    current, previous = ym >= middle, ym < middle
    vol = half_up(0.5 * F.col("sd") / F.col("mean"), 6)
    return (
        month.groupBy("country", "category")
        .agg(
            F.sum(F.when(current, F.col("c"))).alias("cur"),
            F.sum(F.when(previous, F.col("c"))).alias("prev"),
            F.stddev_samp(F.when(current, F.col("c"))).alias("sd"),
            F.avg(F.when(current, F.col("c"))).alias("mean"),
            F.max("ym").alias("last_ym"),
        )
        .filter((F.col("cur") > 0) & (F.col("prev") > 0) & F.col("sd").isNotNull())
        .select(
            "country",
            "category",
            half_up(F.col("cur") / F.col("prev") - 1, 6).alias("growth"),
            vol.alias("volatility"),
            half_up(1 - vol * 0.3, 6).alias("confidence"),
            "last_ym",
        )
        .withColumn("tier", tier(F.col("growth"), F.col("volatility"), F.col("confidence")))
    )


def tier(growth: Column, volatility: Column, confidence: Column) -> Column:
    """Six tiers; a volatile or uncertain series is only watched, whatever its growth."""
    out = F.when((volatility > dims.WATCH_VOLATILITY) | (confidence < dims.CONFIDENCE_FLOOR), "watch")
    for name, floor in dims.TIERS:
        out = out.when(growth >= floor, name)
    return out.when(growth < 0, "disrupted").otherwise("watch")


def corridor_strength(cube: DataFrame, as_of: str = dims.AS_OF) -> DataFrame:
    """Mean signal strength (0-1) per corridor over the last three closed months."""
    return (
        cube.filter(F.col("ym").between(month_before(as_of, 3), month_before(as_of, 1)))
        .groupBy(F.col("partner").alias("country"), "category")
        .agg((F.sum("qty") / F.sum("n") / 50.0).alias("strength"))
    )


def signals(t: Tables) -> DataFrame:
    """Weekly demand signal per (region, market segment) over the year before the reference date.

    The weekly mean is formed before any series work, so a series never exceeds 53 points however
    many orders one corridor holds.
    """
    recent = trailing(t.read("orders"), "o_orderdate", dims.AS_OF, 365)
    return (
        recent.join(customers(t), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.col("cust_region").alias("country"),
            F.col("c_mktsegment").alias("category"),
            F.to_date(F.date_trunc("week", "o_orderdate")).alias("day"),
        )
        .agg((F.sum(cents(F.col("o_totalprice"))).cast("double") / F.count("*") / 100.0).alias("value"))
    )


def activity(t: Tables, days: int = 90) -> DataFrame:
    """Retail activity events: one per order line of the trailing window."""
    priority = F.substring("o_orderpriority", 1, 1)
    return (
        trailing(lines(t), "o_orderdate", dims.AS_OF, days)
        .select(
            F.concat_ws("-", F.col("o_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
            F.col("c_name").alias("retailer"),
            F.col("partner").alias("country"),
            "category",
            F.when(priority.isin("1", "2"), "new_listing")
            .when(priority == "3", "category_expansion")
            .otherwise("seasonal_rotation")
            .alias("kind"),
            "brand",
            "reporter",
            F.col("o_orderdate").alias("detected_at"),
        )
    )


def distributor_categories(supply: DataFrame) -> DataFrame:
    """(supplier, product type) pairs with at least the mean revenue of the supplier's types, so every supplier has one at any size."""
    totals = supply.filter("by_type = 1").select("suppkey", "category", "c")
    whole = totals.groupBy("suppkey").agg(F.sum("c").alias("all_c"), F.count("*").alias("n_types"))
    return totals.join(grows(whole), "suppkey").filter(F.col("c") * F.col("n_types") >= F.col("all_c")).select("suppkey", "category")


def distributor_brands(supply: DataFrame) -> DataFrame:
    """(supplier, brand) pairs with at least the mean number of lines of the supplier's brands."""
    counts = supply.filter("by_type = 0").select("suppkey", "brand", "n")
    whole = counts.groupBy("suppkey").agg(F.sum("n").alias("all_n"), F.count("*").alias("n_brands"))
    return counts.join(grows(whole), "suppkey").filter(F.col("n") * F.col("n_brands") >= F.col("all_n")).select("suppkey", "brand")


def distributors(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    return (
        suppliers(t)
        .join(grows(t.read("part").select("p_partkey", "p_name")), key == F.col("p_partkey"), "left")
        .select(
            key.alias("suppkey"),
            F.col("s_name").alias("name"),
            F.col("supp_nation").alias("country"),
            F.col("supp_region").alias("region"),
            (F.col("s_acctbal") > 0).alias("imports"),
            (key % 3 != 0).alias("has_email"),
            (key % 4 != 0).alias("has_site"),
            (key % 5 != 0).alias("has_profile"),
            F.concat(F.lit("supplier of "), F.col("p_name")).alias("description"),
        )
    )


def brand_cells(t: Tables, market: DataFrame) -> DataFrame:
    """(brand, product type, buyer region) cents: at most brands x types x regions rows."""
    cells = _with_nations(t, market.filter("monthly = 0"))
    return cells.groupBy("brand", "category", F.col("cust_region").alias("partner_region")).agg(F.sum("cents").alias("c"))


def brand_categories(cells: DataFrame) -> DataFrame:
    """(brand, product type) pairs with at least the mean revenue of the brand's types, so every brand has one at any size."""
    by_type = cells.groupBy("brand", "category").agg(F.sum("c").alias("c"))
    whole = by_type.groupBy("brand").agg(F.sum("c").alias("all_c"), F.count("*").alias("n_types"))
    return by_type.join(whole, "brand").filter(F.col("c") * F.col("n_types") >= F.col("all_c")).select("brand", "category")


def brands(cells: DataFrame) -> DataFrame:
    number = F.split("brand", "#").getItem(1).cast("int")
    scale = F.when(number % 4 == 0, 0.002).when(number % 4 == 1, 0.02).when(number % 4 == 2, 0.2).otherwise(1.0)
    return (
        cells.groupBy("brand")
        .agg(F.sum("c").alias("c"), F.sum(F.when(F.col("partner_region") == "EUROPE", F.col("c")).otherwise(0)).alias("eu"))
        .select(
            "brand",
            (money(F.col("c")) * scale).alias("revenue"),
            (F.col("eu") * 100 >= F.col("c") * 20).alias("eu_presence"),
            (number % 2 == 0).alias("has_store"),
            F.when(number % 5 == 0, "US").otherwise("XX").alias("origin"),
        )
    )


def leads(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    status = F.array(*[F.lit(s) for s in ("new", "reviewed", "approved", "replied", "qualified", "lost")])
    exported = F.lit(dims.AS_OF).cast("date")
    return customers(t).select(
        key.alias("lead"),
        F.col("c_name").alias("company"),
        F.col("cust_nation").alias("country"),
        F.concat(F.lit("Brand#"), (key % 25 + 1).cast("string")).alias("brand"),
        (key % 10 != 0).alias("linked"),
        (key % 3 != 0).alias("has_email"),
        (key % 4 != 0).alias("has_profile"),
        (key % 5 != 0).alias("has_site"),
        F.get(status, (key % 6).cast("int")).alias("status"),
        F.when(key % 2 == 1, F.date_sub(exported, (key % 15).cast("int"))).alias("exported_on"),
    )


def campaigns(t: Tables) -> DataFrame:
    """Outreach history of a lead: one campaign per order."""
    return t.read("orders").select(
        F.col("o_orderkey").alias("campaign"),
        F.col("o_custkey").alias("lead"),
        F.when(F.col("o_orderstatus") == "F", "sent").when(F.col("o_orderstatus") == "O", "draft").otherwise("opened").alias("status"),
        F.to_date("o_orderdate").alias("created_on"),
        F.element_at(
            F.array(*[F.lit(s) for s in ("won", "qualified", "engaged", "contacted", "lost")]),
            F.substring("o_orderpriority", 1, 1).cast("int"),
        ).alias("stage"),
        cents(F.col("o_totalprice")).alias("cents"),
    )


def pipeline(t: Tables) -> DataFrame:
    """Open business of a lead, one row each: its open orders, at the furthest stage among them, with that stage's probability."""
    stages = F.array(*[F.lit(s) for s in dims.PIPELINE_PROBABILITY])
    chance = F.array(*[F.lit(p) for p in dims.PIPELINE_PROBABILITY.values()])
    step = F.least(F.substring("o_orderpriority", 1, 1).cast("int"), F.lit(len(dims.PIPELINE_PROBABILITY)))
    return (
        t.read("orders").filter("o_orderstatus = 'O'")
        .groupBy(F.col("o_custkey").alias("lead")).agg(F.min(step).alias("step"), F.sum(cents(F.col("o_totalprice"))).alias("c"))
        .select("lead", F.element_at(stages, F.col("step")).alias("stage"), (F.col("c") / 100.0).alias("estimated_value"), F.element_at(chance, F.col("step")).alias("probability_percent"))
    )


def briefings(t: Tables) -> DataFrame:
    """Briefings written on a lead: one for each day with a filled order (lead, title, created_on)."""
    day = F.to_date("o_orderdate")
    return t.read("orders").filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("lead"), F.concat(F.lit("Briefing of "), F.date_format(day, "yyyy-MM-dd")).alias("title"), day.alias("created_on")
    ).distinct()


def shows(t: Tables) -> DataFrame:
    """Trade shows: one per nation, on a date that depends on it, in two of the product groups."""
    key = F.col("n_nationkey")
    words = [w[0] for w in dims.SHOW_KEYWORDS.values()]
    first, second = F.lit(len(words)), F.lit(len(words))
    labels = F.array(*[F.lit(f"{w.title()} goods") for w in words])
    return t.read("nation").select(
        key.cast("int").alias("show_id"),
        F.concat(F.lit("Expo "), F.col("n_name")).alias("show_name"),
        F.col("n_name").alias("country"),
        F.date_add(F.lit(dims.AS_OF).cast("date"), key * 15 - 30).alias("start_on"),
        F.array_distinct(
            F.array(F.get(labels, (key % first).cast("int")), F.get(labels, ((key * 3 + 1) % second).cast("int")))
        ).alias("labels"),
    )


def exhibitors(t: Tables) -> DataFrame:
    """Every supplier shows at its nation's fair; every third one under a brand name in capitals."""
    key = F.col("s_suppkey")
    return t.read("supplier").select(
        F.col("s_nationkey").cast("int").alias("show_id"),
        key.alias("suppkey"),
        F.when(key % 3 == 0, F.concat(F.lit("BRAND#"), (key % 40 + 1).cast("string")))
        .otherwise(F.col("s_name"))
        .alias("exhibitor"),
    )


def engagement(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("lead"),
        F.when(kind == "view", "opened")
        .when(kind == "click", "clicked")
        .when(kind == "error", "bounced")
        .when(kind == "signup", "complained")
        .when(kind == "purchase", "replied")
        .alias("kind"),
        (F.get_json_object("props", "$.k").cast("int") % 2 == 0).alias("hard"),
        "value",
    )
