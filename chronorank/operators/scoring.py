"""Scores of documents against topics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronorank.functions import likelihood as L
from chronorank.functions import text as T
from chronorank.operators.stats import CollectionStats
from chronorank.operators.topics import Topics, query_models, with_background
from chronorank.shared import side


def topic_models(topics: Topics, stats: CollectionStats) -> DataFrame:
    return query_models(topics, with_background(topics.terms, stats, topics.small))


def attach_model(items: DataFrame, models: DataFrame, small: bool) -> DataFrame:
    """Give every routed row the model of its own query.

    ``models`` has one row per query; the documents are not moved when it is
    small.
    """
    return items.join(side(models, small), "query_id")


def _routed(
    stored: DataFrame,
    models: DataFrame,
    small: bool,
    stop: T.Stop,
    measure: Callable[[Column, Column], Column],
    keep: Sequence[str],
    out: str,
    text: str,
) -> DataFrame:
    tokens = attach_model(stored.select("query_id", *keep, text), models, small).select(
        "query_id", *keep, T.words(text, stop).alias("_tokens"), "model"
    )
    return tokens.select(
        "query_id", *keep, F.size("_tokens").cast("long").alias("length"),
        measure(F.col("_tokens"), F.col("model")).alias(out),
    )


def score_routed(
    stored: DataFrame,
    models: DataFrame,
    small: bool,
    stop: T.Stop = (),
    measure: str = "kl",
    keep: Sequence[str] = ("stream_id",),
    text: str = "clean_visible",
) -> DataFrame:
    """Score each stored item against the query it was routed to.

    ``kl``      smoothed query likelihood
    ``cer``     likelihood ratio against the collection
    ``maxest``  likelihood if every query term occurred exactly once

    Returns ``(query_id, *keep, length, score)`` in one map-only pass.
    """
    measures: dict[str, Callable[[Column, Column], Column]] = {
        "kl": L.kl,
        "cer": L.cer,
        "maxest": lambda tokens, model: L.at_frequency(F.size(tokens), model, "at_1"),
    }
    return _routed(stored, models, small, stop, measures[measure], keep, "score", text)


def score_bounds(
    stored: DataFrame, models: DataFrame, small: bool, text: str = "clean_visible"
) -> DataFrame:
    """Lowest, highest and practical score a text of the item's length can get."""
    rows = _routed(
        stored, models, small, (), lambda tokens, model: L.bounds(F.size(tokens), model),
        ("stream_id",), "bounds", text,
    )
    return rows.select("query_id", "stream_id", "length", "bounds.*")
