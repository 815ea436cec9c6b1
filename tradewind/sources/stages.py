"""Stage tables: a shared intermediate result is written once and read back as a small table.

A chain of scores reads its inputs many times. Writing each shared result cuts the lineage there:
it is computed once, later plans stay small, its true size decides whether a join broadcasts it,
and a lost executor costs a re-read, not a recomputation. What is staged is bounded by dimensions
(markets, categories, brands, distributors), never raw lines.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session, whose tasks share the machine's disk, may go without: it gets a temporary folder that
    is removed when the process ends. On a cluster a missing setting is an error, because executors would
    write where nobody else can read.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _LOCAL[context.applicationId]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under a fresh path and return it read back with the same schema."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/tradewind-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
