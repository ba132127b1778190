"""The stored item table: one partition per query, sorted by hour and id within."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronorank.shared import fits, materialize, side

KEYS = ["query_id", "date_bin", "stream_id"]
SLOT = "_slot"
#: Bytes of items that a file holds, by the sizes the rows come with.
FILE_BYTES = 128 * 1024 * 1024
#: Ids are found by Bloom filters of at most so many bytes, sized by what a row group holds.
BLOOM = {
    "parquet.bloom.filter.enabled#stream_id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.bloom.filter.max.bytes": str(128 * 1024),
}
#: Keys up to this number are looked up by the filters of the files.
LOOKUP_KEYS = 100


@dataclass(frozen=True)
class Placement:
    """Slots of the (query, hour) cells of a table: ``n`` slots from ``first`` on."""

    cells: DataFrame
    slots: int
    small: bool

    def of(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their slot; they move only if the cells are many."""
        placed = rows.join(side(self.cells, self.small), KEYS[:2], "left")
        spread = F.pmod(F.xxhash64("stream_id"), F.coalesce("n", F.lit(self.slots)))
        return placed.withColumn(SLOT, (F.coalesce("first", F.lit(0)) + spread).cast("int")).drop("first", "n")


def plan_slots(keys: DataFrame, file_bytes: int = FILE_BYTES) -> Placement:
    """Slots for rows (query_id, date_bin, n_bytes), each of about ``file_bytes``.

    Cells are packed in key order, so that a slot has adjacent hours of a query;
    a cell that is larger than a file is spread over slots of its own by id.
    With less data than a file for each core, slots are as many as the cores.
    """
    cells = keys.groupBy("query_id", "date_bin").agg(F.sum("n_bytes").alias("bytes"))
    cells = materialize(cells, "item-cells")
    total = cells.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    cores = keys.sparkSession.sparkContext.defaultParallelism
    size = max(1, -(-total // max(cores, -(-total // file_bytes))))
    own = F.when(F.col("bytes") >= size, F.ceil(F.col("bytes") / size)).otherwise(0)
    cells = cells.withColumns({"own": own, "packed": F.when(F.col("bytes") >= size, 0).otherwise(F.col("bytes"))})
    hours = Window.partitionBy("query_id").orderBy("date_bin").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each query, so that this order needs no more than one task
    queries = Window.orderBy("query_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = ("own", "packed")
    ahead = cells.groupBy("query_id").agg(*(F.sum(c).alias(c) for c in sums))
    ahead = ahead.select("query_id", *(F.coalesce(F.sum(c).over(queries), F.lit(0)).alias(f"{c}_ahead") for c in sums))
    cells = cells.join(ahead, "query_id").select(
        "query_id", "date_bin", "own", "packed",
        *((F.coalesce(F.sum(c).over(hours), F.lit(0)) + F.col(f"{c}_ahead")).alias(f"{c}_before") for c in sums),
    )
    packed = 1 + total // size  # no more can be needed for cells that share slots
    first = F.when(F.col("own") > 0, packed + F.col("own_before")).otherwise(F.floor(F.col("packed_before") / size))
    placed = cells.select("query_id", "date_bin", first.cast("long").alias("first"), F.greatest("own", F.lit(1)).cast("long").alias("n"))
    placed = materialize(placed, "item-slots")
    slots = placed.agg(F.coalesce(F.max(F.col("first") + F.col("n")), F.lit(1))).first()[0]
    return Placement(placed, slots, fits(placed))


def write_items(
    rows: DataFrame,
    path: str,
    mode: str = "errorifexists",
    placement: Placement | None = None,
    finish: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> None:
    """Store routed items, in the files of ``placement`` or else by key range.

    ``finish`` adds what is derived from a row after it has moved.
    """
    if placement:
        moved = placement.of(rows).repartitionById(placement.slots, F.col(SLOT)).drop(SLOT)
    else:
        moved = rows.repartitionByRange(*KEYS)
    stored = finish(moved.sortWithinPartitions(*KEYS))
    if "body" in stored.columns:
        stored = stored.drop("clean_visible")
    writer = stored.write.mode(mode).partitionBy("query_id").options(**BLOOM)
    writer.option("compression", "snappy").parquet(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Stored items with the visible text as a column of its own.

    Readers that need only the text do not read the sentences, and the other way
    round: the scan prunes nested fields.
    """
    return spark.read.parquet(path).withColumn("clean_visible", F.col("body.clean_visible"))


def scan_query(items: DataFrame, query_id: int) -> DataFrame:
    """Items of one query: partition pruning."""
    return items.filter(F.col("query_id") == query_id)


def scan_bins(items: DataFrame, query_id: int, low: int, high: int) -> DataFrame:
    """Items of one query and the hours ``low <= bin < high``; files are sorted by hour."""
    return scan_query(items, query_id).filter((F.col("date_bin") >= low) & (F.col("date_bin") < high))


def lookup_items(items: DataFrame, keys: DataFrame, small: bool = False) -> DataFrame:
    """Items whose ``(query_id, stream_id)`` is listed; one semi-join for all keys.

    Up to ``LOOKUP_KEYS`` keys also become filters of the scan: it opens the
    folders of their queries only, and reads row groups whose Bloom filter may
    hold one of the ids.  More keys prune by the join alone.
    """
    on = ["query_id", "stream_id"]
    keys = keys.select(*on)
    few = keys.distinct().limit(LOOKUP_KEYS + 1).collect()
    if len(few) <= LOOKUP_KEYS:
        small = True
        listed = (F.col(name).isin(sorted({row[name] for row in few if row[name] is not None})) for name in on)
        for condition in listed:
            items = items.filter(condition)
    return items.join(side(keys, small), on, "left_semi")
