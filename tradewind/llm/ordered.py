"""Documents in ascending id order without one global sort: parts of ids, each sorted and read as a stream."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

#: Texts of one part, at most about.
PART_BYTES = 16 << 20
#: Sorts before every id: what a row without an id is ordered by.
NO_ID = -(2**63)


def bounds(ids: DataFrame, text_bytes: int, part_bytes: int = PART_BYTES) -> list[float]:
    """Ascending first ids of the parts behind the first one: quantiles of ``ids.at``, as many as the texts need."""
    n = max(1, -(-text_bytes // part_bytes))
    if n == 1:
        return []
    steps = [i / n for i in range(1, n)]
    found = ids.agg(F.percentile_approx("at", F.array(*map(F.lit, steps)) if n < 64 else F.lit(steps), F.lit(max(10_000, 20 * n)))).first()[0]
    return sorted({float(x) for x in found or []})


def with_part(rows: DataFrame, cuts: list[float]) -> DataFrame:
    """``rows`` (with column ``at``) and the number of the part that the id falls in."""
    splits = [float("-inf"), *cuts, float("inf")]
    placed = Bucketizer(splits=splits, inputCol="at_double", outputCol="part").transform(rows.withColumn("at_double", F.col("at").cast("double"))) if cuts else rows.withColumn("part", F.lit(0)).withColumn("at_double", F.lit(0.0))
    return placed.withColumn("part", F.col("part").cast("int")).drop("at_double")


def with_successor(rows: DataFrame, cuts: list[float]) -> DataFrame:
    """``rows`` with part, and each part's first rows once more as guests of the part before; the first part follows the last.

    What reaches the driver is one id a part.
    """
    placed = with_part(rows, cuts)
    firsts = {r["part"]: r["first"] for r in placed.select("part", "at").groupBy("part").agg(F.min("at").alias("first")).collect()}
    if not firsts:
        return placed.withColumn("guest", F.lit(False))
    order = sorted(firsts)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    n = max(order) + 1
    first_of = F.element_at(F.lit([firsts.get(p, 0) for p in range(n)]).cast("array<bigint>"), F.col("part") + 1)
    host_of = F.element_at(F.lit([before.get(p, 0) for p in range(n)]).cast("array<int>"), F.col("part") + 1)
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    copies = F.when(F.col("at") == first_of, F.array(own, F.struct(host_of.alias("part"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    names = [c for c in placed.columns if c != "part"]
    return placed.withColumn("copy", F.explode(copies)).select(*names, "copy.part", "copy.guest")
