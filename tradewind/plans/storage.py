"""Round trips through the writers: what is read back is compared with plain SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tradewind import sinks
from tradewind.operators import keywords, leads, merge, scores
from tradewind.plans.feeds import grain_rows
from tradewind.plans.leads import SCORING, LeadInputs
from tradewind.plans.registry import query
from tradewind.plans.scores import R
from tradewind.sources import dims, postings, views
from tradewind.sources.stages import stage_root
from tradewind.sources.tables import Tables


def _folder(t: Tables, name: str) -> str:
    return f"{stage_root(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("upsert_store", """
SELECT c_custkey, CASE WHEN c_custkey % 100 = 7 THEN 'MOVED' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 100 = 7 THEN 2 ELSE 0 END AS revision FROM customer
UNION ALL SELECT c_custkey + 10000000, 'NEW', 1 FROM customer WHERE c_custkey % 1000 = 3""")
def upsert_store(t: Tables) -> DataFrame:
    """One percent of the keys changes, each in two revisions of which the later one wins, and new keys come."""
    store, cols = _folder(t, "store"), ("c_custkey", "segment", "revision")
    rows = t.read("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.lit(0).alias("revision"))
    sinks.upsert_table(t.spark, store, "customers", rows, ["c_custkey"])
    moved = rows.filter("c_custkey % 100 = 7")
    new = rows.filter("c_custkey % 1000 = 3").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), F.lit("NEW").alias("segment"), F.lit(1).alias("revision"))
    revisions = [moved.select("c_custkey", F.lit(word).alias("segment"), F.lit(n).alias("revision")) for word, n in (("LEAVING", 1), ("MOVED", 2))]
    sinks.upsert_table(t.spark, store, "customers", revisions[0].unionByName(revisions[1]).unionByName(new).select(*cols), ["c_custkey"], ["revision"])
    return sinks.read_table(t.spark, store, "customers")


@query("grain_store", """
SELECT * FROM v_grain_new UNION ALL SELECT * FROM v_grain_old o WHERE NOT EXISTS (SELECT 1 FROM v_grain_new n WHERE n.country = o.country AND n.category = o.category AND n.brand IS NOT DISTINCT FROM o.brand)""")
def grain_store(t: Tables) -> DataFrame:
    store = _folder(t, "store")
    for rows in grain_rows(t):
        sinks.upsert_grain_table(t.spark, store, "scores", rows, "brand", ["country", "category"])
    return sinks.read_table(t.spark, store, "scores")


@query("publish_roundtrip", """
SELECT CASE WHEN p_size > 25 THEN 'accepted' WHEN p_size > 10 THEN 'review' ELSE 'rejected' END AS source, p_partkey, CASE WHEN p_size > 10 AND p_size <= 25 THEN 2 ELSE 1 END AS writer FROM part""")
def publish_roundtrip(t: Tables) -> DataFrame:
    """Three tables in one commit; then a writer that still rests on the state before is refused and comes again."""
    store, size = _folder(t, "store"), F.col("p_size")
    rows = t.read("part").select("p_partkey", F.lit(1).alias("writer"), "p_size")
    parts = {"accepted": rows.filter(size > 25), "review": rows.filter((size > 10) & (size <= 25)), "rejected": rows.filter(size <= 10)}
    before = sinks.snapshot(t.spark, store)
    sinks.publish(t.spark, store, {name: df.select("p_partkey", "writer") for name, df in parts.items()}, before)
    late = {"review": parts["review"].select("p_partkey", F.lit(2).alias("writer"))}
    try:
        sinks.publish(t.spark, store, {"review": late["review"], "rejected": late["review"]}, before)
    except sinks.Conflict:
        sinks.publish(t.spark, store, late, sinks.snapshot(t.spark, store))
    tables = [sinks.read_table(t.spark, store, name).select(F.lit(name).alias("source"), "p_partkey", "writer") for name in parts]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@query("audit_roundtrip", """
SELECT 'orders' AS kind, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY 2""")
def audit_roundtrip(t: Tables) -> DataFrame:
    """Summaries of two runs go to one log and are read back by run."""
    log = _folder(t, "audit")
    for kind, table, label in (("orders", "orders", "o_orderstatus"), ("events", "events", "event_type")):
        summary = t.read(table).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
        sinks.append_summary(summary, log, kind)
    runs = [sinks.read_audit(t.spark, log, kind, "label string, n long").select(F.lit(kind).alias("kind"), "label", "n") for kind in ("orders", "events")]
    return runs[0].unionByName(runs[1])


@query("export_roundtrip", "SELECT * FROM v_export")
def export_roundtrip(t: Tables) -> DataFrame:
    """The nested export, one folder a status, read back and laid flat again."""
    path = _folder(t, "export")
    nested = leads.nested_export(leads.crm_selection(LeadInputs(t, *SCORING).quality, views.campaigns(t), views.pipeline(t), views.briefings(t)))
    sinks.export_json(nested, path, ["status"])
    back = sinks.read_export(t.spark, path, nested.schema)
    return back.select(
        "lead", "company", "status", "quality", "best_country", "best_category",
        F.col("lastCampaign.id").alias("last_campaign"), F.col("lastCampaign.status").alias("campaign_status"), F.col("lastCampaign.sentAt").alias("campaign_on"),
        F.col("pipeline.stage").alias("stage"), F.col("pipeline.estimatedValue").alias("estimated_value"),
        F.col("pipeline.probabilityPercent").alias("probability_percent"), F.col("briefingTitle").alias("briefing"),
    )


FIRST_RUN, SECOND_RUN, EXPIRY = "2024-01-15", "2024-01-20", 12


@query("dynamic_keywords", f"""
WITH e AS (SELECT 'group' || CAST(user_id % 10 AS VARCHAR) AS grp, event_type AS category, CAST(ts AS DATE) AS day, event_type || ' ' || (props->>'$.k') AS query, event_id, value FROM events),
sig AS (SELECT grp, category, day, query, row_number() OVER (PARTITION BY grp, category, day ORDER BY pos, query) AS rn FROM (
 SELECT grp, category, day, query, min(event_id) AS pos FROM e WHERE value > 50 AND day < DATE '{SECOND_RUN}' GROUP BY 1, 2, 3, 4) QUALIFY rn <= 5),
runs AS (SELECT grp, category, day, row_number() OVER (PARTITION BY grp ORDER BY day DESC, category) AS age FROM (SELECT DISTINCT grp, category, day FROM sig WHERE day >= DATE '{SECOND_RUN}' - {EXPIRY}) QUALIFY age <= 16),
dyn AS (SELECT grp, category, query AS keyword, row_number() OVER (PARTITION BY grp, category ORDER BY best, query) AS place FROM (
 SELECT s.grp, s.category, s.query, min(r.age * 10 + s.rn) AS best FROM sig s JOIN runs r USING (grp, category, day) GROUP BY 1, 2, 3) QUALIFY place <= 2),
listed AS (SELECT DISTINCT grp, category, category AS keyword, 0 AS place FROM e WHERE day >= DATE '{SECOND_RUN}' UNION ALL SELECT grp, category, keyword, place FROM dyn)
SELECT l.grp, l.category, l.keyword, CAST(l.place AS INTEGER) AS place, (SELECT count(*) FROM e WHERE e.grp = l.grp AND e.category = l.category AND e.day >= DATE '{SECOND_RUN}' AND (l.place = 0 OR e.query = l.keyword)) AS n FROM listed l""")
def dynamic_keywords(t: Tables) -> DataFrame:
    """Two runs store their rising terms; the third day's keyword list takes up what they stored and counts it in the new events."""
    store, day, grp = _folder(t, "signals"), F.to_date("ts"), F.concat(F.lit("group"), (F.col("user_id") % 10).cast("string"))
    events = t.read("events").select(
        grp.alias("grp"), F.col("event_type").alias("category"), day.alias("captured_on"), F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")).alias("query"), F.col("event_id").alias("pos"), "value"
    )
    keys = ["grp", "category", "captured_on"]
    for start, end in (("0001-01-01", FIRST_RUN), (FIRST_RUN, SECOND_RUN)):
        seen = events.filter((F.col("captured_on") >= start) & (F.col("captured_on") < end) & (F.col("value") > 50))
        sinks.upsert_table(t.spark, store, "signals", keywords.signal_terms(seen, keys), keys, buckets=8)
    dynamic = keywords.dynamic_keywords(sinks.read_table(t.spark, store, "signals"), ["grp"], SECOND_RUN, days=EXPIRY)
    today = events.filter(F.col("captured_on") >= SECOND_RUN)
    listed = keywords.keywords_of_day(today.select("grp", "category", F.col("category").alias("keyword")).distinct(), dynamic, ["grp"])
    both = today.groupBy("grp", "category", "query").agg(F.count(F.lit(1)).alias("n"))
    terms = both.select("grp", "category", F.col("query").alias("keyword"), "n").unionByName(
        both.groupBy("grp", "category").agg(F.sum("n").alias("n")).select("grp", "category", F.col("category").alias("keyword"), "n")
    )
    return listed.join(terms, ["grp", "category", "keyword"], "left").select("grp", "category", "keyword", "place", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


KINDS = ["hours", "day", "month", "year"]
_CAPTURED_AT = "o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24)"


@query("freshness_classes", f"""
WITH wanted AS (SELECT c_custkey, ['hours', 'day', 'month', 'year'][c_custkey % 4 + 1] AS kind FROM customer),
held AS (SELECT o_custkey, o_orderkey, o_orderstatus, {_CAPTURED_AT} AS made FROM orders WHERE {_CAPTURED_AT} <= TIMESTAMP '{{0}}'),
alive AS (SELECT c_custkey, kind, o_orderkey, o_orderstatus, made FROM wanted JOIN held ON o_custkey = c_custkey WHERE CASE kind WHEN 'hours' THEN made >= TIMESTAMP '{{0}}' - INTERVAL 20 HOUR
 WHEN 'day' THEN CAST(made AS DATE) = DATE '{{1}}' WHEN 'month' THEN made >= TIMESTAMP '{{0}}' - INTERVAL 30 DAY ELSE year(made) < year(DATE '{{1}}') OR made >= TIMESTAMP '{{0}}' - INTERVAL 30 DAY END
 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY made DESC, o_orderkey DESC) = 1)
SELECT w.c_custkey, w.kind, a.o_orderkey IS NOT NULL AS reused, a.o_orderkey, a.o_orderstatus FROM wanted w LEFT JOIN alive a USING (c_custkey)""".format(f"{dims.AS_OF} 00:00:00", dims.AS_OF))
def freshness_classes(t: Tables) -> DataFrame:
    """Customers as keys of four validity classes, their orders as captures: what still holds is used again, the rest is to be fetched."""
    wanted = t.read("customer").select("c_custkey", F.element_at(F.array(*map(F.lit, KINDS)), (F.col("c_custkey") % 4 + 1).cast("int")).alias("kind"))
    at = F.col("o_orderdate") + F.expr("make_interval(0, 0, 0, 0, cast(o_orderkey % 24 as int), 0, 0)")
    captured = t.read("orders").select(F.col("o_custkey").alias("c_custkey"), at.alias("captured_at"), "o_orderkey", "o_orderstatus")
    return merge.reuse(wanted, captured, ["c_custkey"], F.lit(dims.AS_OF).cast("timestamp"), ["o_orderkey", "o_orderstatus"])


WANTED = ["ECONOMY", "SMALL"]


@query("array_predicates", f"""
WITH kinds AS (SELECT l_orderkey, list(DISTINCT p_type) AS kinds FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT 'every' AS mode, l_orderkey, CAST(len(kinds) AS BIGINT) AS n FROM kinds WHERE list_has_all(kinds, {WANTED}) UNION ALL SELECT 'any', l_orderkey, len(kinds) FROM kinds WHERE list_has_any(kinds, {WANTED})""")
def array_predicates(t: Tables) -> DataFrame:
    """Orders by the types of their parts, found over postings: all wanted types, or any of them."""
    path = _folder(t, "postings")
    lines = t.read("lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(t.read("part").select("p_partkey", "p_type"), "p_partkey")
    kinds = lines.groupBy("l_orderkey").agg(F.collect_set("p_type").alias("kinds"))
    rows = kinds.select("l_orderkey", F.size("kinds").cast("long").alias("n"))
    postings.write(kinds, "l_orderkey", "kinds", path)
    found = [postings.holding(rows, path, "l_orderkey", WANTED, every).select(F.lit(mode).alias("mode"), "l_orderkey", "n") for mode, every in (("every", True), ("any", False))]
    return found[0].unionByName(found[1])


#: For each category a primary and a fallback code and the usual reliance; other categories have none.
CODES = [("ECONOMY", "Brand#1", "Brand#2", 0.45), ("SMALL", "Brand#99", "Brand#3", 0.3), ("LARGE", "Brand#98", "Brand#97", 0.2)]
DEFAULT = 0.15
_CODES = ", ".join(f"('{c}', '{p}', '{f}', {u}::DOUBLE)" for c, p, f, u in CODES)


@query("reliance_codes", f"""
WITH mapping(category, prime, spare, usual) AS (VALUES {_CODES}), corridors AS (SELECT n_nationkey AS nation, unnest({[c for c, *_ in CODES] + ['OTHER']}) AS category FROM nation),
flows AS (SELECT c_nationkey AS country, p_brand AS code, sum(CASE WHEN s_nationkey % 5 = 0 THEN cents ELSE 0 END) AS own, sum(cents) AS world FROM (
 SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey) GROUP BY 1, 2),
held AS (SELECT nation AS country, category, usual, nation % 8 = 0 AS reused, p.own AS p_own, p.world AS p_world, f.own AS f_own, f.world AS f_world FROM corridors LEFT JOIN mapping USING (category)
 LEFT JOIN flows p ON p.country = nation AND p.code = prime LEFT JOIN flows f ON f.country = nation AND f.code = spare)
SELECT country, category, {R("CASE WHEN reused THEN 0.5::DOUBLE ELSE coalesce(CASE WHEN coalesce(p_world, f_world) > 0 THEN least(1.0, CASE WHEN p_world IS NOT NULL THEN p_own ELSE f_own END / coalesce(p_world, f_world)::DOUBLE) END, usual, " + str(DEFAULT) + "::DOUBLE) END", 6)} AS reliance,
 CASE WHEN reused THEN 'stored' WHEN p_world > 0 THEN 'primary' WHEN p_world IS NULL AND f_world > 0 THEN 'fallback' WHEN usual IS NOT NULL THEN 'category' ELSE 'default' END AS source FROM held""")
def reliance_codes(t: Tables) -> DataFrame:
    """Reliance of each nation and category by code; every eighth nation has a stored value that holds, every other fourth one that has expired."""
    spark = t.spark
    categories = F.array(*[F.lit(c) for c in [c for c, *_ in CODES] + ["OTHER"]])
    corridors = t.read("nation").select(F.col("n_nationkey").alias("country"), F.explode(categories).alias("category"))
    lines = t.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    wide = (
        lines.join(t.read("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("code")), "l_partkey")
        .join(t.read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 5 == 0).alias("near")), "l_suppkey")
        .groupBy("l_orderkey", "code").agg(F.sum(F.when(F.col("near"), F.col("cents")).otherwise(0)).alias("own"), F.sum("cents").alias("world"))
        .join(t.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
        .join(t.read("customer").select("c_custkey", F.col("c_nationkey").alias("country")), "c_custkey")
    )
    flows = wide.groupBy("country", "code").agg(F.sum("own").alias("own"), F.sum("world").alias("world"))
    age = F.when(F.col("country") % 8 == 0, 10).otherwise(40)
    stored = corridors.filter("country % 4 = 0").select("country", "category", F.date_sub(F.lit(dims.AS_OF).cast("date"), age).cast("timestamp").alias("captured_at"), F.lit(0.5).alias("reliance"))
    mapping = spark.createDataFrame(CODES, "category string, primary string, fallback string, usual double")
    return scores.reliance_by_code(corridors, mapping, flows, stored, dims.AS_OF, DEFAULT)
