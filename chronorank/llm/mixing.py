"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronorank.llm.common import small_side
from chronorank.shared import materialize

#: Weights of the sources in order of their names, repeated.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words that the mix takes, against all words there are.
BUDGET = 1.5
#: Times that a document may be taken.
PASSES = 2
#: Documents of one slice of a source, about.
SLICE_ROWS = 5_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in ``text``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, passes: int = PASSES) -> DataFrame:
    """source, source_size, target of a table (source, source_size).

    The budget is shared by weight.  A target ends at ``passes`` times its
    source's size; what it had beyond is shared among the others by weight
    until none is above.  That is the level x at which the sums of
    ``least(passes * size, x * weight)`` give the budget: with the sources by
    ``passes * size / weight``, the filled ones come first.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    named = sizes.withColumn("weight", F.get(cycle, F.pmod(place, F.lit(len(weights)))))
    named = named.withColumn("most", (passes * F.col("source_size")).cast("double"))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    named = named.withColumn("budget", F.lit(budget) * F.sum("source_size").over(every))
    named = named.withColumn("level", (F.col("budget") - before) / rest)
    # the first source that its share at this level doesn't fill sets the level of all after it
    named = named.withColumn("open", F.col("level") * F.col("weight") < F.col("most"))
    # (taking later ones as if it were filled gives lower levels, never higher ones)
    named = named.withColumn("level", F.max(F.when(F.col("open"), F.col("level"))).over(every))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(
        F.least(F.col("most"), F.col("level") * F.col("weight"))
    )
    return named.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    budget: float = BUDGET,
    passes: int = PASSES,
    seed: int = 11,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, finish of every row of ``docs`` (doc_id, source, text).

    Each source's documents are shuffled by a hash of id and ``seed``.  A
    document's virtual finish time is the words of its source up to its end, over
    the source's target; later passes over the source follow on.  Sources are
    served at rates that use up their targets together, so the mix in order of
    finish times reaches the budget at time 1, where it is cut: a document in
    service then gives the words up to there.  ``taken`` counts the words of all
    passes; ``finish`` is null where no word is taken.

    The words before a document are summed in two steps, over slices of its
    source's shuffled order and within the slice, so that a source of any size
    is spread over tasks.  Null texts have size 0.  A null source is one source,
    the last.  Repeated rows count as often as they occur.
    """
    # the text goes no further than its count
    rows = docs.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size"))
    turn = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"/{seed}")))
    rows = materialize(rows.withColumn("turn", turn), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sources, weights, budget, passes), "targets")
    slices = max(1, rows.count() // slice_rows)
    place = F.conv(F.substring("turn", 1, 8), 16, 10).cast("double") / 2.0**32
    rows = rows.withColumn("slice", F.floor(place * slices).cast("long"))
    totals = rows.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    ordered = Window.partitionBy("source", "slice").orderBy("turn", "doc_id", "size")
    within = F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("end", within)
    rows = _same(rows, materialize(starts, "slices"), "source", "slice")
    rows = _same(rows, targets, "source")
    end = F.col("start") + F.col("end")
    before = end - F.col("size")
    cut = F.floor("target").cast("long")
    taken = F.lit(0).cast("long")
    last = F.lit(None).cast("double")
    for i in range(passes):
        start = before + i * F.col("source_size")
        part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), cut - start))
        taken = taken + part
        last = F.when(part > 0, F.least((start + F.col("size")) / F.col("target"), F.lit(1.0))).otherwise(last)
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), last.alias("finish")
    )


def _same(rows: DataFrame, side: DataFrame, *keys: str) -> DataFrame:
    """Join on equal or both null ``keys``."""
    side = small_side(side).select([F.col(c).alias(f"_{c}" if c in keys else c) for c in side.columns])
    on = rows[keys[0]].eqNullSafe(side[f"_{keys[0]}"])
    for key in keys[1:]:
        on = on & rows[key].eqNullSafe(side[f"_{key}"])
    return rows.join(side, on).drop(*[f"_{k}" for k in keys])


def in_order(mixed: DataFrame) -> DataFrame:
    """Range-sorted by finish time; what the mix doesn't take comes last."""
    return mixed.orderBy(F.col("finish").asc_nulls_last(), F.col("source").asc_nulls_last(), "doc_id")


#: ``mix`` of ``documents`` with the default arguments.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || '/11') AS turn,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source),
w AS (
  SELECT source, source_size, (2 * source_size)::DOUBLE AS most,
    CASE place % 3 WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2::DOUBLE ELSE 1::DOUBLE END AS weight,
    1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT AS budget
  FROM s),
f AS (
  SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
    sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    AS own_level
  FROM w),
l AS (
  SELECT *, max(CASE WHEN own_level * weight < most THEN own_level END) OVER () AS level FROM f),
t AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN most ELSE least(most, level * weight) END AS target FROM l),
o AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS cut,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, greatest(0, least(size, cut - before)) AS one, greatest(0, least(size, cut - before - source_size)) AS two
  FROM o)
SELECT doc_id, source, size, source_size, target, (one + two)::BIGINT AS taken,
  CASE WHEN two > 0 THEN least((before + source_size + size) / target, 1.0)
    WHEN one > 0 THEN least((before + size) / target, 1.0) END AS finish
FROM p
"""
