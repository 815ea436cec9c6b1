"""The input tables and the list scan over any of them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


_SCHEMAS: dict[str, StructType] = {}


@dataclass(frozen=True)
class Tables:
    """Lazy access to one directory of Parquet tables. A table's footer is read once per process."""

    spark: SparkSession
    path: str

    def read(self, name: str) -> DataFrame:
        file = f"{self.path}/{name}.parquet"
        if file not in _SCHEMAS:
            _SCHEMAS[file] = self.spark.read.parquet(file).schema
        return self.spark.read.schema(_SCHEMAS[file]).parquet(file)


def grows(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the input: it is sorted and merged, never sent through the driver.

    The planner takes a Parquet file's compressed size for a table's size; keys and repeated names make that up to
    fifty times less than the broadcast, so its threshold does not hold such a side back.
    """
    return df.hint("merge")


def hashed(df: DataFrame) -> DataFrame:
    """As ``grows``, for a side with one short row a key that is a fraction of the other side.

    Both sides are shuffled and each task hashes its share of this one, so the larger side is not sorted.
    """
    return df.hint("shuffle_hash")


def list_scan(
    df: DataFrame,
    filters: dict[str, Column | None],
    order: list[Column],
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """AND of the filters that were supplied (``None`` means not supplied), ordered and paged.

    A numeric filter of 0 is a real filter here. With a limit the plan is TakeOrderedAndProject:
    each task keeps ``offset + limit`` rows, so nothing is sorted as a whole.
    """
    supplied = [f for f in filters.values() if f is not None]
    out = df.filter(reduce(lambda a, b: a & b, supplied)) if supplied else df
    out = out.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def optional(column: str, op: str, value: object | None, scale: float = 1.0) -> Column | None:
    """One optional predicate; ``scale`` turns a percent parameter into a fraction."""
    if value is None:
        return None
    col = F.col(column)
    literal = F.lit(value * scale if scale != 1.0 else value)
    return {"=": col == literal, ">=": col >= literal, "<=": col <= literal}[op]


def year_scan(df: DataFrame, years: list[int]) -> DataFrame:
    return df.filter(F.col("year").isin(years))


def days_before(as_of: str, days: int) -> str:
    return (date.fromisoformat(as_of) - timedelta(days=days)).isoformat()


def trailing(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows of the ``days`` before ``as_of``.

    The bounds are text literals, so they take the column's own timestamp type and reach the Parquet
    scan; a cast of the column would keep them above it.
    """
    return df.filter((F.col(ts) >= F.lit(days_before(as_of, days))) & (F.col(ts) <= F.lit(as_of)))
