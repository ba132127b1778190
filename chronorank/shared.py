"""Helpers used across operators: written tables and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side table, in rows, that a join may replicate to every executor.
MAX_BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without the setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="chronorank-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chronorank/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once and return the stored copy.

    Cuts the lineage at a table that outlives executors, and lets later readers
    prune columns, which a row checkpoint does not.
    """
    path = new_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``max_rows`` rows; never reads further."""
    return df.limit(max_rows + 1).count() <= max_rows


def side(df: DataFrame, small: bool) -> DataFrame:
    """``df`` hinted for replication if its size was checked, else untouched.

    Unhinted, Spark plans a shuffle join and adaptive execution splits hot keys.
    """
    return F.broadcast(df) if small else df
