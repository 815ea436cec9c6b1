"""Operator 10: benchmark decontamination by winnowing, with DataFrame functions only.

Of every WINDOW consecutive k-grams of a text winnowing keeps the smallest hash. Two texts that share
WINDOW + K - 1 = SPAN words share a whole window, so they keep the same hash there: no shared span of that
length is missed, while only about one k-gram in three is kept.

1. Fingerprints of the documents are joined with those of the benchmark. Documents without a common
   fingerprint are clean; this is one pass without a shuffle of texts while the benchmark is small.
2. Hits are extended: in the documents left, every span of SPAN words is compared with the spans of the
   benchmark as text, so hashes decide nothing.

Items of fewer than SPAN words are one span of their own length m; a document's m-grams are their fingerprints.

The benchmark side of a join is broadcast if it has at most BROADCAST_ROWS rows, which is counted; a larger one is
joined by a shuffle.

Defined cases: a null or empty text has no words; an item without words occurs nowhere; repeated rows each get
a row; repeated items count by their different ids; a null item id is left out of the list of ids; other columns of the input are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradewind.llm.common import row_key, same_row
from tradewind.sources.stages import stage

SPAN, K = 10, 4
WINDOW = SPAN - K + 1
BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case. ``lower`` is the same for ASCII texts and much faster."""
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(F.coalesce(lower, F.lit("")), _BETWEEN), lambda w: w != "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once. An array bound this way is also never copied to be sliced."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _places(n: Column) -> Column:
    """1 to n, or nothing."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def grams(ws: Column, k: int) -> Column:
    """Hash of each k-gram of an array of words."""
    return F.transform(_places(F.size(ws) - (k - 1)), lambda i: F.xxhash64(F.slice(ws, i, k)))


def winnowed(ws: Column) -> Column:
    """The hashes of K-grams that are the smallest of WINDOW consecutive ones."""
    return _let(grams(ws, K), lambda g: F.transform(_places(F.size(g) - (WINDOW - 1)), lambda i: F.array_min(F.slice(g, i, WINDOW))))


def prints(ws: Column, short: list[int]) -> Column:
    """Different fingerprints of a text: winnowed ones, and all m-grams for each short length m."""
    return F.array_distinct(F.concat(winnowed(ws), *[grams(ws, m) for m in short]))


def spans(ws: Column, lengths: list[int]) -> Column:
    """Each span of the given lengths as one text, with its length and its first word's place from 0."""

    def of(m: int) -> Column:
        return F.transform(_places(F.size(ws) - (m - 1)), lambda i: F.struct(F.lit(m).alias("m"), (i - 1).alias("at"), F.array_join(F.slice(ws, i, m), " ").alias("span")))

    return F.concat(*map(of, lengths))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, copies, n_words, n_hit, n_items, ids of rows that differ in id or text."""
    items = stage(benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws")).filter(F.size("ws") > 0), "benchmark-words")
    long, short_items = items.filter(F.size("ws") >= SPAN), items.filter(F.size("ws") < SPAN)
    short = sorted(r["m"] for r in short_items.select(F.size("ws").alias("m")).distinct().collect())  # SPAN - 1 lengths at most
    item_prints = long.select(F.explode(_let(F.col("ws"), winnowed)).alias("print"))
    item_spans = long.select("item", F.explode(_let(F.col("ws"), lambda ws: spans(ws, [SPAN]))).alias("s"))
    for m in short:
        own = short_items.filter(F.size("ws") == m)
        item_prints = item_prints.unionByName(own.select(F.explode(grams(F.col("ws"), m)).alias("print")))
        item_spans = item_spans.unionByName(own.select("item", F.explode(spans(F.col("ws"), [m])).alias("s")))
    item_prints = _small(stage(item_prints.distinct(), "benchmark-prints"))
    wanted = _small(stage(item_spans.select("item", "s.m", "s.span").distinct(), "benchmark-spans"))

    read = docs.select(*row_key(), _let(words(F.col("text")), lambda ws: F.struct(F.size(ws).alias("n"), prints(ws, short).alias("prints"))).alias("w"))
    kept = read.select("doc_id", "text_hash", F.col("w.n").alias("n"), F.posexplode_outer("w.prints").alias("pos", "print"))
    marked = kept.join(item_prints.withColumn("found", F.lit(True)), "print", "left")
    base = marked.groupBy("doc_id", "text_hash").agg(
        F.max("n").alias("n_words"), F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, 1).otherwise(0)).alias("copies"), F.coalesce(F.bool_or("found"), F.lit(False)).alias("suspect"),
    )
    base = stage(base, "document-prints")

    suspects = _small(base.filter("suspect").select("doc_id", "text_hash"))
    key = ["doc_id", "text_hash"]
    left = docs.select(*row_key(), "text")
    same = (left["doc_id"].eqNullSafe(suspects["doc_id"])) & (left["text_hash"] == suspects["text_hash"])
    left = left.join(suspects, same, "left_semi").dropDuplicates(key)
    own = left.select(*key, F.explode(_let(words(F.col("text")), lambda ws: spans(ws, [SPAN, *short]))).alias("o"))
    hits = stage(own.select(*key, "o.m", "o.at", "o.span").join(wanted, ["m", "span"]).select(*key, "m", "at", "item"), "hits")

    starts = hits.groupBy(*key, "at").agg(F.max("m").alias("m"))
    earlier = F.max(F.col("at") + F.col("m")).over(Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    hit_words = starts.withColumn("new", F.greatest(F.lit(0), F.col("at") + F.col("m") - F.greatest("at", F.coalesce(earlier, F.lit(0))))).groupBy(*key).agg(F.sum("new").cast("long").alias("n_hit"))
    found = hits.select(*key, "item").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("ids"))
    by_doc = hit_words.alias("h").join(found.alias("f"), F.col("h.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("h.text_hash") == F.col("f.text_hash"))).select("h.doc_id", "h.text_hash", "n_hit", "n_items", "ids")
    joined = base.alias("b").join(by_doc.alias("d"), F.col("b.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("b.text_hash") == F.col("d.text_hash")), "left")
    return joined.select("b.doc_id", "b.text_hash", "copies", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "n_items", "ids")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row.

    Rows equal in id and text are worked on once and given back as often as they came.
    """
    return _judged(docs, benchmark).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no span of the benchmark, unchanged; a row goes by its own id and text, with or without an id."""
    dirty = _judged(docs, benchmark).filter("n_hit > 0").select("doc_id", "text_hash")
    return docs.join(dirty, same_row(docs, dirty), "left_anti").select(*docs.columns)
