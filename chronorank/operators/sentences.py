"""Sentence extraction and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronorank.functions import ids as I
from chronorank.functions import likelihood as L
from chronorank.functions import text as T
from chronorank.operators.scoring import attach_model

# Default tagger, and the number of sentences that usually make up the top text.
TAGGER = "lingpipe"
TOP_SENTENCES = 20


def sentences(items: DataFrame, tagger: str = TAGGER, keep: Sequence[str] = ("stream_id",)) -> DataFrame:
    """``(*keep, sent_num, sentence)`` of one tagger's sentence list."""
    texts = T.sentence_texts(F.col("body.sentences")[tagger])
    rows = items.select(*keep, texts.alias("_texts"))
    exploded = rows.select(*keep, *T.numbered("_texts", "sent_num", "sentence"))
    return exploded.filter(F.col("sent_num").isNotNull())


def update_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("updateid", I.update_id("stream_id", "sent_num"))


def _scored(rows: DataFrame, keep: Sequence[str], tagger: str, top: int) -> DataFrame:
    """Scores of the sentences, the document and its beginning, as one row per item.

    ``rows`` carries the item and its ``model``.  Everything happens within the
    row: sentences are exploded only afterwards, and an item without any gives a
    null position then.  A filter here would cut the text a second time.
    """
    texts = rows.select(
        *keep, "model", T.sentence_texts(F.col("body.sentences")[tagger]).alias("_texts")
    )
    tokens = texts.select(
        *keep, "model", "_texts", F.transform("_texts", lambda s: T.words(s)).alias("_sent_tokens")
    )
    matched = tokens.select(
        *keep,
        "model",
        "_texts",
        F.transform("_sent_tokens", F.size).alias("_sizes"),
        L.sentence_gains(F.col("_sent_tokens"), F.col("model"), top).alias("_gains"),
    )
    sized = matched.select(
        "*",
        _total(F.col("_sizes")).alias("_size"),
        _total(F.slice("_sizes", 1, top)).alias("_top_size"),
    )
    model, gains = F.col("model"), F.col("_gains")
    return sized.select(
        *keep,
        "_texts",
        "model",
        F.col("_size").cast("long").alias("doc_len"),
        F.zip_with("_sizes", gains["sentences"], lambda size, gain: L.smoothed(size, model, gain)).alias("_sent_scores"),
        L.smoothed(F.col("_size"), model, gains["text"]).alias("doc_score"),
        L.smoothed(F.col("_top_size"), model, gains["top"]).alias("top_score"),
    )


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda total, size: total + size)


def sentence_scores(
    stored: DataFrame, models: DataFrame, small: bool, tagger: str = TAGGER, top: int = TOP_SENTENCES
) -> DataFrame:
    """One row per sentence of each stored item, scored against its own query.

    ``top_score`` is the score of the first ``top`` sentences as one text.
    """
    keep = ("query_id", "epoch_ms", "source", "rowkey", "stream_id")
    rows = attach_model(stored.select(*keep, "body"), models, small)
    scored = _scored(rows, keep, tagger, top).select(
        *keep,
        "doc_score",
        "top_score",
        F.size("_sent_scores").alias("n_sent"),
        "doc_len",
        L.bounds(F.col("doc_len"), F.col("model")).alias("bounds"),
        "_sent_scores",
    )
    exploded = scored.select("*", *T.numbered("_sent_scores", "sent_num", "sent_score"))
    return exploded.filter(F.col("sent_num").isNotNull()).select(
        "query_id",
        F.floor(F.col("epoch_ms") / 1000).alias("epoch"),
        "source",
        "rowkey",
        "stream_id",
        "sent_num",
        "doc_score",
        "top_score",
        "sent_score",
        "n_sent",
        "doc_len",
        "bounds.*",
    )


def sentence_dump(
    items: DataFrame, model: DataFrame, tagger: str = TAGGER, path: str = "path"
) -> DataFrame:
    """Score all items and sentences against one given query.

    ``model`` is a single row; its array is a scalar of the job, not a join side.
    """
    keep = ("path", "source", "epoch_ms", "stream_id")
    rows = items.select(
        F.coalesce(path, F.lit("")).alias("path"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("epoch_ms", F.lit(0)).alias("epoch_ms"),
        F.coalesce("stream_id", F.lit("")).alias("stream_id"),
        "body",
        model.select("model").scalar().alias("model"),
    )
    scored = _scored(rows, keep, tagger, TOP_SENTENCES).select(
        *keep, "doc_score", F.arrays_zip("_texts", "_sent_scores").alias("_both")
    )
    exploded = scored.select(*keep, "doc_score", *T.numbered("_both", "sent_num", "_s"))
    return exploded.filter(F.col("sent_num").isNotNull()).select(
        *keep, "doc_score", "sent_num", F.col("_s._sent_scores").alias("sent_score"),
        F.col("_s._texts").alias("sentence"),
    )


def latest_sentence(scores: DataFrame) -> DataFrame:
    """Last sentence row of each item within its query.

    Uses a max per item, which combines before the shuffle.
    """
    values = [c for c in scores.columns if c not in ("query_id", "stream_id", "sent_num")]
    last = scores.groupBy("query_id", "stream_id").agg(
        F.max_by(F.struct("sent_num", *values), "sent_num").alias("last")
    )
    return last.select("query_id", "stream_id", "last.*")


def by_epoch(rows: DataFrame) -> DataFrame:
    """Order the rows of each query by time; hot queries are split over tasks."""
    keys = ["query_id", "epoch", "stream_id"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


