"""Term counts of texts and of the collection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronorank.functions import text as T
from chronorank.shared import fits


@dataclass(frozen=True)
class CollectionStats:
    """Collection frequencies ``(term, cf)`` and the token total.

    ``total`` is a column that may be used in any DataFrame: a literal or a
    scalar subquery.
    """

    vocab: DataFrame
    total: Column


def doc_terms(
    docs: DataFrame, key: str = "doc_id", text: str = "clean_visible", stop: T.Stop = ()
) -> DataFrame:
    """Sparse term vectors ``(key, term, tf)``."""
    return (
        docs.select(key, F.explode(T.words(text, stop)).alias("term"))
        .groupBy(key, "term")
        .agg(F.count("*").alias("tf"))
    )


def doc_lengths(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "clean_visible",
    stop: T.Stop = (),
    also: T.Stop = (),
) -> DataFrame:
    """Vector lengths ``(key, length)``, counted within the row.

    With ``also``, the length without these stopwords comes along as ``stopped_length``.
    """
    tokens = docs.select(key, T.words(text, stop).alias("_tokens"))
    length = F.size("_tokens").cast("long").alias("length")
    if not T.stops(also):
        return tokens.select(key, length)
    return tokens.select(key, length, F.size(T.without(F.col("_tokens"), also)).cast("long").alias("stopped_length"))


def word_count(docs: DataFrame, text: str = "clean_visible") -> DataFrame:
    """Occurrences of blank-separated words, case kept: ``(word, n)``."""
    return docs.select(F.explode(T.space_tokens(text)).alias("word")).groupBy("word").agg(
        F.count("*").alias("n")
    )


def word_count_of(docs: DataFrame, ids: DataFrame, text: str = "clean_visible") -> DataFrame:
    """Word count over the documents whose ``stream_id`` is listed in ``ids``.

    Texts stay where they are if the list was counted small; else they meet its
    hashed ids, and no text is sorted.
    """
    ids = ids.select("stream_id")
    listed = F.broadcast(ids) if fits(ids) else ids.hint("shuffle_hash")
    return word_count(docs.select("stream_id", text).join(listed, "stream_id", "left_semi"), text)


def row_count(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("n")).select(F.lit("all").alias("key"), "n")


def collection_stats(docs: DataFrame, text: str = "clean_visible") -> DataFrame:
    """Collection term weights ``(term, weight)``.

    Partial counts are combined before the shuffle, so a frequent term sends one
    row per map task.
    """
    return (
        docs.select(F.explode(T.words(text)).alias("term"))
        .groupBy("term")
        .agg(F.count("*").cast("double").alias("weight"))
    )


def collection_total(stats: DataFrame) -> DataFrame:
    return stats.agg(F.sum("weight").alias("total"))


def as_collection(stats: DataFrame) -> CollectionStats:
    """Scoring view of a ``(term, weight)`` table."""
    vocab = stats.select("term", F.col("weight").alias("cf"))
    return CollectionStats(vocab, collection_total(stats).scalar())
