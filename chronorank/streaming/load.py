"""Routing and loading of newly arrived items, batch by batch.

The load job needs no state: each item meets only the topics, the statistics and
the hour table.  The same operators therefore run on every micro-batch.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from chronorank.operators.loading import make_loader
from chronorank.operators.stats import CollectionStats
from chronorank.operators.topics import Topics


def read_new_items(spark: SparkSession, path: str, schema: StructType, max_files: int = 1000) -> DataFrame:
    """Stream of item files that arrive below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def load_new_items(
    items: DataFrame,
    topics: Topics,
    stats: CollectionStats,
    date_bins: DataFrame,
    table: str,
    checkpoint: str,
    rejected: str | None = None,
    **settings: int,
) -> StreamingQuery:
    """Route and store all items available now, then stop.

    ``items`` has ``stream_id``, ``stream_time``, ``source`` and ``body``.  A batch
    is written to a folder named by ``checkpoint`` and its number and replaced if
    it is run again.  So a restart after a failure leaves no duplicates, and
    loads with checkpoints of their own add to one table.  Items that are not
    stored go to ``rejected`` in the same way.
    """
    load_id = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    loader = make_loader(topics, stats, date_bins, **settings)

    def load(batch: DataFrame, number: int) -> None:
        part = f"batch={load_id}-{number}"
        routed = loader.routed(loader.judged_items(batch))
        loader.load(routed, f"{table}/{part}", f"{rejected}/{part}" if rejected else None, mode="overwrite")

    return (
        items.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
