"""Collection statistics that follow the load: counts by batch, added up by readers.

Below a table's folder:

``counts/batch=<load>-<n>``  term counts of one batch, replaced if it runs again
``merged/set=<id>``          counts of several batches or sets, added up
``replaced/set=<id>``        the names of what a set stands for

A set counts from the moment ``replaced`` names what it stands for, which is
written last.  So readers see every batch exactly once before, during and after
a merge, and a merge that fails leaves nothing that counts.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronorank.operators.stats import collection_stats
from chronorank.shared import fits, side

COUNTS = "term string, weight double, batch string"
MERGED = "term string, weight double, set string"
REPLACED = "name string, set string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return spark.createDataFrame([], schema)


def count_batch(items: DataFrame, table: str, batch: str, text: str = "clean_visible") -> None:
    """Store the term counts of ``items`` as those of ``batch``, in place of earlier ones."""
    collection_stats(items, text).write.mode("overwrite").parquet(f"{table}/counts/batch={batch}")


def count_new_items(items: DataFrame, table: str, checkpoint: str, text: str = "clean_visible") -> StreamingQuery:
    """Count all items available now, then stop; batches are named as those of the load job."""
    load_id = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    return (
        items.writeStream.foreachBatch(lambda batch, number: count_batch(batch, table, f"{load_id}-{number}", text))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _current(spark: SparkSession, table: str) -> DataFrame:
    """Counts that stand, ``(name, term, weight)``: of batches and sets that no set stands for."""
    replaced = _read(spark, f"{table}/replaced", REPLACED)
    batches = _read(spark, f"{table}/counts", COUNTS).withColumnRenamed("batch", "name")
    known = replaced.select("set").distinct()
    sets = _read(spark, f"{table}/merged", MERGED).join(side(known, fits(known)), "set", "left_semi")
    both = batches.unionByName(sets.withColumnRenamed("set", "name"))
    gone = replaced.select("name").distinct()
    return both.join(side(gone, fits(gone)), "name", "left_anti")


def read_stats(spark: SparkSession, table: str) -> DataFrame:
    """``(term, weight)`` of all batches, as ``collection_stats`` of all items would give it."""
    return _current(spark, table).groupBy("term").agg(F.sum("weight").alias("weight"))


def merge_counts(spark: SparkSession, table: str) -> None:
    """Add everything that stands up into one set; what it stands for may be deleted later."""
    current = _current(spark, table)
    names = current.select("name").distinct()
    name = uuid.uuid4().hex
    # the names are fixed before the sums are read: a batch that arrives meanwhile is in neither
    names.write.parquet(f"{table}/pending/set={name}")
    pending = spark.read.schema("name string").parquet(f"{table}/pending/set={name}")
    kept = current.join(side(pending, fits(pending)), "name", "left_semi")
    kept.groupBy("term").agg(F.sum("weight").alias("weight")).write.parquet(f"{table}/merged/set={name}")
    pending.write.parquet(f"{table}/replaced/set={name}")
