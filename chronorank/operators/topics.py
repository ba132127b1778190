"""Topics as term vectors with collection probabilities."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronorank.functions import text as T
from chronorank.functions.likelihood import model_struct
from chronorank.operators.stats import CollectionStats
from chronorank.shared import fits, side


@dataclass(frozen=True)
class Topics:
    """Query vectors.

    ``terms``  (query_id, term, w) of every query that has terms
    ``ids``    (query_id, qlen) of every query
    ``small``  True if the term rows were counted and may be replicated
    """

    terms: DataFrame
    ids: DataFrame
    small: bool


def topic_vectors(topics: DataFrame, stop: T.Stop = ()) -> Topics:
    """Vectors of ``(query_id, query)`` rows.

    The number of term rows is checked here, once; joins replicate the topics
    only if it stays below the bound.
    """
    tokens = T.words("query", stop)
    rows = topics.select("query_id", F.explode(tokens).alias("term"))
    return Topics(
        rows.groupBy("query_id", "term").agg(F.count("*").cast("double").alias("w")),
        topics.select("query_id", F.size(tokens).cast("double").alias("qlen")),
        fits(rows),
    )


def with_background(
    terms: DataFrame, stats: CollectionStats, small: bool, background: str = "default_one"
) -> DataFrame:
    """Add ``cp``, the collection probability of each row's term.

    ``default_one``  unseen terms count once
    ``add_one``      every term counts once more

    The vocabulary is filtered to the wanted terms while it is scanned; it is
    never replicated or shuffled for a small side.
    """
    wanted = terms.select("term").distinct()
    found = stats.vocab.join(side(wanted, small), "term")
    joined = terms.join(side(found, small), "term", "left")
    if background == "default_one":
        cf: Column = F.coalesce("cf", F.lit(1.0))
    elif background == "add_one":
        cf = F.coalesce("cf", F.lit(0.0)) + 1.0
    else:
        raise ValueError(f"unknown background {background!r}")
    return joined.withColumn("cp", cf / stats.total).drop("cf")


def query_models(topics: Topics, terms: DataFrame) -> DataFrame:
    """One row per topic, ``(query_id, model)``, from ``(query_id, term, w, cp)``.

    A group is one query's terms, bounded by the length of its text.  A topic
    without terms has a null model, which scores 0.
    """
    models = terms.groupBy("query_id").agg(model_struct().alias("model"))
    return topics.ids.select("query_id").join(models, "query_id", "left")
