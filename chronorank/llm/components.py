"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronorank.shared import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node of ``edges``; the component is its smallest id.

    Every round links each node's larger neighbours to its smallest one, then
    its smaller ones among themselves, until the edges are stars.  Minima are
    pre-aggregated; each round is a written table, so no lineage grows and a
    lost executor costs one round.  Loops and edges with a null end are ignored.
    """
    edges = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
        edges = _small_stars(_large_stars(edges))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _large_stars(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v"), F.col("u")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")), "least")
    out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return materialize(out.distinct(), "edges")


def _small_stars(edges: DataFrame) -> DataFrame:
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    out = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return materialize(out.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
