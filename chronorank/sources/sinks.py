"""Text and table outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronorank.functions import ids as I


def write_vocab(stats: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store ``(term, weight)``."""
    stats.write.mode(mode).parquet(path)


def _write_delimited(df: DataFrame, path: str, sep: str, mode: str) -> None:
    line = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    df.select(line.alias("value")).write.mode(mode).text(path)


def write_kv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``key<TAB>value`` lines of a two-column DataFrame."""
    key, *values = df.columns
    flat = df.select(F.col(key), F.concat_ws(",", *values).alias("value"))
    _write_delimited(flat, path, "\t", mode)


def write_scored(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated score rows without header or quoting."""
    _write_delimited(df, path, "\t", mode)


def write_run(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Ranked list ``query,stream_id,score``, each query in rank order."""
    ordered = df.repartitionByRange("query_id", "rank").sortWithinPartitions("query_id", "rank")
    _write_delimited(ordered.select("query_id", "stream_id", "score"), path, ",", mode)


def write_trec(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tagged documents, one folder per ``hourdaydir``; ranged by it, so that a task writes few folders."""
    (
        records.repartitionByRange("hourdaydir", "stream_id")
        .sortWithinPartitions("hourdaydir", "stream_id")
        .select("hourdaydir", F.rtrim(F.col("record"), F.lit("\n")).alias("value"))
        .write.mode(mode)
        .partitionBy("hourdaydir")
        .text(path)
    )


def write_sharded(items: DataFrame, path: str, depth: int = 1, mode: str = "errorifexists") -> None:
    """Items by query and leading path segments of their id.

    Folders hold many items each; depth sets how many.  Rows are ranged by the
    full key, so no folder is written by one task alone.
    """
    shard = F.array_join(F.slice(F.split(I.shard_path("stream_id"), "/"), 1, depth), "-")
    keys = ["query_id", "shard", "stream_id"]
    (
        items.withColumn("shard", shard)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode(mode)
        .partitionBy("query_id", "shard")
        .parquet(path)
    )
