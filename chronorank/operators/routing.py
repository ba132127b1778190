"""Assign every document to the topic that explains it best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronorank.functions import ids as I
from chronorank.functions import likelihood as L
from chronorank.functions import text as T
from chronorank.operators.matching import all_topics, best_topics
from chronorank.operators.ranking import TIE_DIGITS
from chronorank.operators.stats import CollectionStats
from chronorank.operators.topics import Topics
from chronorank.shared import side

#: Serialized size, in bytes, from which an item is rejected.
SIZE_LIMIT = 64 * 1024 * 1024


def valid_items(items: DataFrame) -> DataFrame:
    """Items with a body and visible text."""
    return items.filter(F.col("body").isNotNull() & T.has_text("body.clean_visible"))


def item_times(items: DataFrame, zulu: str = "stream_time.zulu_timestamp") -> DataFrame:
    """Add ``epoch_ms`` and ``hour`` read from the item's timestamp."""
    timed = items.withColumn("epoch_ms", T.zulu_to_epoch_ms(F.col(zulu)))
    return timed.withColumn("hour", T.hour_label("epoch_ms"))


def size_filter(items: DataFrame, limit: int = SIZE_LIMIT, text: str = "clean_visible") -> DataFrame:
    """Mark items by size; rejected rows stay visible for a second output."""
    sized = items.withColumn("n_bytes", F.octet_length(text).cast("long"))
    return sized.withColumn("accepted", F.col("n_bytes") < F.lit(limit))


def route(
    docs: DataFrame,
    topics: Topics,
    stats: CollectionStats,
    key: str = "doc_id",
    text: str = "clean_visible",
    stop: T.Stop = (),
    background: str = "default_one",
    mu: float = L.MU,
) -> DataFrame:
    """Best topic of each document: ``(key, query_id, margin)``.

    The document is scored as the query and the topic as the text; ties go to
    the lowest id.  The margin is the score without the document's constant
    ``sum(tf * ln(cp))``, which all topics have.  One pass over the documents,
    without a shuffle.
    """
    best = best_topics(docs, topics, stats, 1, "route", key, text, stop, background, mu)
    return best.select(key, "query_id", F.round("score", TIE_DIGITS).alias("margin"))


def route_scores(
    docs: DataFrame,
    topics: Topics,
    stats: CollectionStats,
    key: str = "doc_id",
    text: str = "clean_visible",
    mu: float = L.MU,
    head_terms: int = 10_000,
) -> DataFrame:
    """Full routing scores of every document and topic.

    A document's constant is computed once and joins its text; pairs are made
    after that and never move.  Constants are narrow, so they are hashed and the
    texts need no sort.
    """
    constants = doc_constants(docs, stats, key, text, mu, head_terms)
    texts = docs.select(key, text).join(constants.hint("shuffle_hash"), key)
    pairs = all_topics(texts, topics, stats, "route", key, text, keep=["doc_constant"], mu=mu)
    return pairs.select(
        key,
        "query_id",
        "rank",
        "length",
        "doc_constant",
        (F.col("doc_constant") - F.col("length") * F.log(F.lit(mu)) + F.col("score")).alias("score"),
    )


def doc_constants(
    docs: DataFrame,
    stats: CollectionStats,
    key: str = "doc_id",
    text: str = "clean_visible",
    mu: float = L.MU,
    head_terms: int = 10_000,
) -> DataFrame:
    """``sum(tf * ln(mu * cp))`` per document: the join with the whole vocabulary.

    The ``head_terms`` most frequent terms are replicated (a fixed number) and
    summed up before anything moves; only rarer terms, none of them a hot key,
    go through the shuffle join.
    """
    weight = F.log(mu * F.col("cf") / stats.total)
    by_frequency = stats.vocab.orderBy(F.col("cf").desc(), "term").limit(head_terms)
    head = by_frequency.select("term", weight.alias("head_weight"))
    spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(key), F.lit(4096)))
    partial = (
        docs.select(key, F.explode_outer(T.words(text)).alias("term"))
        .join(F.broadcast(head), "term", "left")
        .withColumn("in_head", F.col("head_weight").isNotNull() | F.col("term").isNull())
        .withColumn("term", F.when(F.col("in_head"), spread).otherwise(F.col("term")))
        .groupBy(key, "term", "in_head")
        .agg(F.count("*").alias("tf"), F.coalesce(F.sum("head_weight"), F.lit(0.0)).alias("head_sum"))
    )
    tail = stats.vocab.select("term", weight.alias("tail_weight"))
    unseen = F.log(mu / stats.total)
    part = F.when(F.col("in_head"), F.col("head_sum")).otherwise(
        F.col("tf") * F.coalesce(F.col("tail_weight"), unseen)
    )
    return partial.join(tail, "term", "left").groupBy(key).agg(F.sum(part).alias("doc_constant"))


def route_assignments(routed: DataFrame, key: str = "stream_id") -> DataFrame:
    """``(key, query_id)``, sorted by key within each output partition."""
    return routed.select(key, "query_id").repartition(key).sortWithinPartitions(key)


def stored_items(
    items: DataFrame, routed: DataFrame, date_bins: DataFrame, key: str = "doc_id", small_bins: bool = False
) -> DataFrame:
    """Rows of the stored table from items, their topic and the hour table.

    An item without timestamp or with an unknown hour goes to bin -1.
    """
    return (
        items.join(routed.select(key, "query_id"), key)
        .join(side(date_bins, small_bins), "hour", "left")
        .withColumn("date_bin", F.coalesce("bin", F.lit(-1)))
        .withColumn("rowkey", I.row_key(F.col("query_id"), F.col("date_bin"), F.col("stream_id")))
        .drop("bin")
    )
