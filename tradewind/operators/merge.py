"""Keyed table updates as pure functions; writing is in ``tradewind.sinks``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """New rows win on the key. ``delta`` has one row per key (see ``latest``)."""
    return base.join(delta.select(*keys), keys, "left_anti").unionByName(delta)


def insert_absent(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows win on the key."""
    return base.unionByName(delta.join(base.select(*keys).distinct(), keys, "left_anti"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key in ``order``, as an aggregate: one row per key and task is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert_by_grain(base: DataFrame, delta: DataFrame, grain: str, fine: list[str], coarse: list[str]) -> DataFrame:
    """Upsert a table of two grains: rows with ``grain`` are keyed by ``fine``, rows without by ``coarse``."""
    split = lambda df: (df.filter(F.col(grain).isNotNull()), df.filter(F.col(grain).isNull()))
    (base_fine, base_coarse), (delta_fine, delta_coarse) = split(base), split(delta)
    return upsert(base_fine, delta_fine, fine).unionByName(upsert(base_coarse, delta_coarse, coarse))


def update_where(df: DataFrame, matched: DataFrame, keys: list[str], changes: dict[str, Column]) -> DataFrame:
    """Set columns on the rows whose key is in ``matched``."""
    flag = matched.select(*keys).distinct().withColumn("_hit", F.lit(True))
    joined = df.join(flag, keys, "left")
    return joined.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_hit")


def stale_keys(wanted: DataFrame, captured: DataFrame, keys: list[str], fresh: Column) -> DataFrame:
    """Keys to fetch again: those without a capture that is still fresh."""
    return wanted.join(captured.filter(fresh).select(*keys).distinct(), keys, "left_anti")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def valid(captured_at: Column, kind: Column, as_of: Column) -> Column:
    """Whether a capture still holds: ``hours`` for 20 hours, ``day`` on its own day, ``month`` for 30 days, ``year`` for good once its year is closed, before that for 30 days."""
    month = captured_at >= as_of - F.expr("INTERVAL 30 DAYS")
    return (
        F.when(kind == "hours", captured_at >= as_of - F.expr("INTERVAL 20 HOURS"))
        .when(kind == "day", F.to_date(captured_at) == F.to_date(as_of))
        .when(kind == "month", month)
        .when(kind == "year", (F.year(captured_at) < F.year(as_of)) | month)
    )


def reuse(wanted: DataFrame, captured: DataFrame, keys: list[str], as_of: Column, values: list[str]) -> DataFrame:
    """(keys, kind, reused, values): for each wanted key the newest capture that still holds, else ``reused`` is false.

    ``captured`` has the keys, ``captured_at`` and the values; captures after ``as_of`` do not count. Captures are reduced to one a key before they meet the wanted keys.
    """
    kinds = wanted.select(*keys, "kind").distinct()
    alive = captured.filter(F.col("captured_at") <= as_of).join(kinds, keys).filter(valid(F.col("captured_at"), F.col("kind"), as_of))
    newest = alive.groupBy(*keys, "kind").agg(F.max(F.struct("captured_at", *values)).alias("c"))
    found = wanted.join(newest, [*keys, "kind"], "left")
    return found.select(*wanted.columns, F.col("c").isNotNull().alias("reused"), *[F.col(f"c.{v}").alias(v) for v in values])
