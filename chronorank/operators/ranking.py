"""Ranking within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronorank.shared import fits, materialize, side

#: Digits kept when scores are compared, so that equal scores tie in spite of
#: summation order.
TIE_DIGITS = 9


def by_score(score: str = "score", tie: str = "stream_id") -> list[Column]:
    return [F.round(F.col(score), TIE_DIGITS).desc(), F.col(tie).asc()]


def top_k(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread_on: Sequence[str],
    spread: int | None = None,
    rank: str = "rank",
) -> DataFrame:
    """The first ``k`` rows of each group, ranked.

    A hot group is first cut to ``k`` rows in each of ``spread`` slices, one for
    each shuffle partition by default, so the last step sees at most
    ``spread * k`` rows of a group.  Both steps prune before their shuffle; as
    Spark does that up to a limit for ``k``, larger depths are cut from the full
    ranks, which never bring a group to one task.
    """
    conf = df.sparkSession.conf
    if k > int(conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        return rank_all(df, by, order, rank).filter(F.col(rank) <= k)
    if spread is None:
        spread = max(1, int(conf.get("spark.sql.shuffle.partitions")))
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*spread_on), F.lit(spread)))
    for keys in ([*by, "_slice"], list(by)):
        window = Window.partitionBy(*keys).orderBy(*order)
        sliced = sliced.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
    return sliced.withColumn(rank, F.col(rank).cast("long")).drop("_slice")


def rank_all(df: DataFrame, by: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Rank every row within its group, without one task per group.

    Rows are range-partitioned by group and order, numbered in place and shifted
    by the number of rows their group has in earlier partitions.  The shifts are
    one row per group and partition it touches; ranges are contiguous, so that
    is at most groups + partitions rows.
    """
    rows = materialize(df, "ranked-input")  # range bounds are sampled from the stored rows
    keys = [F.col(c) for c in by]
    placed = materialize(
        rows.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_seq", F.monotonically_increasing_id()),
        "ranked",
    ).withColumn("_part", F.shiftright("_seq", 33))
    runs = placed.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        placed.join(side(shifts, fits(runs)), [*by, "_part"])
        .withColumn(rank, (F.col("_seq") - F.col("_first") + F.col("_before") + 1).cast("long"))
        .drop("_seq", "_part", "_first", "_before")
    )
