"""Writers: keyed tables in buckets with a commit log, an audit log, and nested JSON export.

A store is a folder. Its tables are cut into buckets by a hash of their key; each bucket is a folder of Parquet files that is
never changed once written. ``_commits/<number>.json`` names, for every table, the folder of each bucket, so a reader takes
the highest number and sees all tables of one moment. A writer reads a number, writes new folders for the buckets that it
touches, and adds the next number; creating a file that exists already fails, so of two writers one comes second. It is then
moved behind the first one if that touched other buckets, and is refused (``Conflict``) if they meet.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tradewind.operators import merge

BUCKETS = 64
TRIES = 5
_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has changed the same buckets since this one read them."""


@dataclass
class Snapshot:
    """One state of a store: its commit number and, for each table, schema, key and the folder of each bucket."""

    number: int = 0
    tables: dict[str, dict] = field(default_factory=dict)


@dataclass
class Change:
    """A table's new entry and the buckets it touches; None stands for all of them."""

    entry: dict
    touched: set[str] | None = None


# ---- commit log


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, folder: str) -> list[str]:
    system = _system(spark, folder)
    return [s.getPath().getName() for s in system.listStatus(_path(spark, folder))] if system.exists(_path(spark, folder)) else []


def _commit_file(store: str, number: int) -> str:
    return f"{store}/_commits/{number:012d}.json"


def snapshot(spark: SparkSession, store: str, number: int | None = None) -> Snapshot:
    """The newest state, or that of a commit number."""
    if number is None:
        number = max((int(n[:-5]) for n in _children(spark, f"{store}/_commits") if n.endswith(".json")), default=0)
    if not number:
        return Snapshot()
    stream = _system(spark, store).open(_path(spark, _commit_file(store, number)))
    try:
        return Snapshot(number, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def _created(spark: SparkSession, store: str, state: Snapshot) -> bool:
    """Add a commit file by a rename that never replaces; False if its number is taken."""
    jvm, target = spark._jvm, _path(spark, _commit_file(store, state.number))
    draft = _path(spark, f"{store}/_commits/.{uuid.uuid4().hex}")
    system = _system(spark, store)
    out = system.create(draft, False)
    out.write(bytearray(json.dumps(state.tables).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.makeQualified(draft).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(system.makeQualified(draft), system.makeQualified(target), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception:
        if not system.exists(target):
            raise
        system.delete(draft, False)
        return False


def _meets(change: Change, before: dict | None, now: dict | None) -> bool:
    """Whether what a change rests on has been changed by others."""
    if before is None or now is None or change.touched is None:
        return before != now
    if before["buckets"] != now["buckets"] or before["schema"] != now["schema"]:
        return True
    return any(before["files"].get(b) != now["files"].get(b) for b in change.touched)


def commit(spark: SparkSession, store: str, read: Snapshot, changes: dict[str, Change]) -> Snapshot:
    """Make all changes visible together; they rest on ``read`` and are refused if others have touched the same buckets."""
    now = read
    while True:
        tables = dict(now.tables)
        for name, change in changes.items():
            if _meets(change, read.tables.get(name), now.tables.get(name)):
                raise Conflict(f"{name} has changed since commit {read.number}")
            entry = change.entry
            if change.touched is not None and name in now.tables:
                entry = {**now.tables[name], "files": now.tables[name]["files"] | {b: entry["files"][b] for b in change.touched}}
            tables[name] = entry
        state = Snapshot(now.number + 1, tables)
        if _created(spark, store, state):
            return state
        now = snapshot(spark, store)


# ---- tables


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _stored(store: str, table: str, df: DataFrame, keys: list[str] | None, buckets: int) -> dict:
    """Write rows to a new folder and describe it; without keys the table is a single bucket of any number of files."""
    spark, folder = df.sparkSession, f"{table}/{uuid.uuid4().hex}"
    entry = {"schema": df.schema.json(), "keys": keys, "buckets": buckets if keys else 1, "files": {"0": folder}}
    if not keys:
        df.write.mode("error").parquet(f"{store}/{folder}")
        return entry
    df.withColumn(_BUCKET, bucket_of(keys, buckets)).repartition(_BUCKET).write.mode("error").partitionBy(_BUCKET).parquet(f"{store}/{folder}")
    names = [n for n in _children(spark, f"{store}/{folder}") if n.startswith(f"{_BUCKET}=")]
    return entry | {"files": {n.split("=")[1]: f"{folder}/{n}" for n in names}}


def _rows(spark: SparkSession, store: str, entry: dict, only: set[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(entry["schema"]))
    folders = [f"{store}/{path}" for bucket, path in sorted(entry["files"].items()) if only is None or bucket in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, store: str, table: str, number: int | None = None) -> DataFrame | None:
    entry = snapshot(spark, store, number).tables.get(table)
    return _rows(spark, store, entry) if entry else None


def publish(spark: SparkSession, store: str, tables: dict[str, DataFrame], read: Snapshot | None = None) -> int:
    """Replace whole tables and make them visible together. With ``read`` nobody may have changed them since that state."""
    read = read or snapshot(spark, store)
    return commit(spark, store, read, {name: Change(_stored(store, name, df, None, 1)) for name, df in tables.items()}).number


def _changed(spark: SparkSession, store: str, table: str, delta: DataFrame, keys: list[str], buckets: int, change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Rewrite the buckets that ``delta`` touches with ``change(base, delta)``; tried again on the newer state after a conflict.

    What reaches the driver is at most one number a bucket.
    """
    for _ in range(TRIES):
        read = snapshot(spark, store)
        entry = read.tables.get(table)
        if entry is None:
            made = Change(_stored(store, table, delta, keys, buckets))
        elif entry["keys"] != keys:
            raise ValueError(f"{table} is stored by {entry['keys']}, not by {keys}")
        else:
            touched = {str(r["b"]) for r in delta.select(bucket_of(keys, entry["buckets"]).alias("b")).distinct().collect()}
            if not touched:
                return read.number
            made = Change(_stored(store, table, change(_rows(spark, store, entry, touched), delta), keys, entry["buckets"]), touched)
        try:
            return commit(spark, store, read, {table: made}).number
        except Conflict:
            continue
    raise Conflict(f"{table} kept changing")


def _one_a_key(delta: DataFrame, keys: list[str], order: list[str] | None) -> DataFrame:
    """The last row a key in ``order``; without an order, the largest of the other columns."""
    return merge.latest(delta, keys, order or [c for c in delta.columns if c not in keys])


def upsert_table(spark: SparkSession, store: str, table: str, delta: DataFrame, keys: list[str], order: list[str] | None = None, buckets: int = BUCKETS) -> int:
    return _changed(spark, store, table, _one_a_key(delta, keys, order), keys, buckets, lambda base, rows: merge.upsert(base, rows.select(*base.columns), keys))


def insert_table(spark: SparkSession, store: str, table: str, delta: DataFrame, keys: list[str], order: list[str] | None = None, buckets: int = BUCKETS) -> int:
    return _changed(spark, store, table, _one_a_key(delta, keys, order), keys, buckets, lambda base, rows: merge.insert_absent(base, rows.select(*base.columns), keys))


def upsert_grain_table(spark: SparkSession, store: str, table: str, delta: DataFrame, grain: str, coarse: list[str], order: list[str] | None = None, buckets: int = BUCKETS) -> int:
    """Upsert a table of two grains: rows with ``grain`` are keyed by it and ``coarse``, rows without by ``coarse``; both lie in one bucket."""
    fine = [grain, *coarse]
    return _changed(
        spark, store, table, _one_a_key(delta, fine, order), coarse, buckets,
        lambda base, rows: merge.upsert_by_grain(base, rows.select(*base.columns), grain, fine, coarse),
    )


# ---- audit log and export


def append_audit(spark: SparkSession, path: str, kind: str, payload: dict) -> None:
    """One audit row per run; the log only grows."""
    row = spark.createDataFrame([(kind, json.dumps(payload))], "kind string, payload string")
    row.write.mode("append").parquet(path)


def append_summary(summary: DataFrame, path: str, kind: str) -> None:
    """One audit row for each row of a run's summary, made on the executors."""
    summary.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*summary.columns)).alias("payload")).write.mode("append").parquet(path)


def read_audit(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """The audit rows of one kind of run with their payload's fields."""
    log = spark.read.schema("kind string, payload string").parquet(path)
    return log.filter(F.col("kind") == kind).select(F.from_json("payload", schema).alias("p")).select("p.*")


def export_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Rows as JSON lines, nested parts as objects; with ``by`` one folder for each of its values."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def read_export(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """An export with its own schema, so that absent parts are null and numbers keep their types."""
    return spark.read.schema(schema).json(path).select(*schema.fieldNames())
