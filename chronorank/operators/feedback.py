"""Relevance-model feedback and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronorank.functions import text as T
from chronorank.operators.ranking import by_score, rank_all, top_k
from chronorank.operators.scoring import score_routed, topic_models
from chronorank.operators.stats import CollectionStats
from chronorank.operators.topics import Topics, query_models, with_background
from chronorank.shared import MAX_BROADCAST_ROWS, fits, materialize, side
from chronorank.sources.items import scan_bins

# Feedback documents and terms, interpolation weight, rerank depth.
FEEDBACK_DOCS = 20
FEEDBACK_TERMS = 20
LAMBDA = 0.5
DEPTH = 1000

#: Digits kept when term weights are compared for the clip.
WEIGHT_DIGITS = 12


def first_pass(
    stored: DataFrame, topics: Topics, stats: CollectionStats, stop: T.Stop = ()
) -> DataFrame:
    """``(query_id, stream_id, length, score)``; documents are stopped, queries are not."""
    return score_routed(stored, topic_models(topics, stats), topics.small, stop)


def feedback_docs(scores: DataFrame, n_docs: int = FEEDBACK_DOCS) -> DataFrame:
    """Top documents of each query; fewer if the query has fewer."""
    return top_k(scores, ["query_id"], by_score(), n_docs, ["stream_id"])


def few_rows(topics: Topics, per_query: int) -> bool:
    """True if ``per_query`` rows for every query stay within the broadcast bound."""
    return fits(topics.ids, MAX_BROADCAST_ROWS // per_query)


def rm_terms(
    feedback: DataFrame,
    stored: DataFrame,
    small: bool,
    stop: T.Stop = (),
    n_terms: int = FEEDBACK_TERMS,
    text: str = "clean_visible",
) -> DataFrame:
    """Clipped and normalized relevance model ``(query_id, term, rank, weight)``.

    ``small`` says that the feedback set, a fixed number of rows per query, was
    found to be within bounds.  Empty documents carry no terms and are left out
    of the average.
    """
    by_query = Window.partitionBy("query_id")
    used = feedback.filter(F.col("length") > 0)
    # exp(score) underflows; a factor common to a query cancels when normalized
    weighted = used.select(
        "query_id",
        "stream_id",
        "length",
        F.exp(F.col("score") - F.max("score").over(by_query)).alias("doc_weight"),
        F.count("*").over(by_query).alias("n_docs"),
    )
    texts = stored.select("query_id", "stream_id", text).join(
        side(weighted, small), ["query_id", "stream_id"]
    )
    terms = (
        texts.select("query_id", "length", "doc_weight", "n_docs", F.explode(T.words(text, stop)).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.sum(F.col("doc_weight") / F.col("length") / F.col("n_docs")).alias("raw"))
    )
    order = [F.round("raw", WEIGHT_DIGITS).desc(), F.col("term").asc()]
    clipped = top_k(terms, ["query_id"], order, n_terms, ["term"])
    return clipped.select(
        "query_id", "term", "rank", (F.col("raw") / F.sum("raw").over(by_query)).alias("weight")
    )


def rm3_model(topics: Topics, relevance: DataFrame, lam: float = LAMBDA) -> DataFrame:
    """``lam * query + (1 - lam) * relevance model`` over the union of terms."""
    query = topics.terms.select("query_id", "term", (lam * F.col("w")).alias("w"))
    model = relevance.select("query_id", "term", ((1 - lam) * F.col("weight")).alias("w"))
    return query.unionByName(model).groupBy("query_id", "term").agg(F.sum("w").alias("w"))


def rm3_rerank_hours(
    stored: DataFrame,
    topics: Topics,
    stats: CollectionStats,
    query_id: int,
    low: int,
    high: int,
    stop: T.Stop = (),
    **settings: int,
) -> DataFrame:
    """Feedback and rerank of one query within the hours ``low <= bin < high``.

    Both passes read the files of that query and its hours only; feedback
    documents come from the same hours.
    """
    one = Topics(
        topics.terms.where(F.col("query_id") == query_id), topics.ids.where(F.col("query_id") == query_id), topics.small
    )
    return rm3_rerank(scan_bins(stored, query_id, low, high), one, stats, stop, **settings)


def rm3_rerank(
    stored: DataFrame,
    topics: Topics,
    stats: CollectionStats,
    stop: T.Stop = (),
    depth: int | None = None,
    n_docs: int = FEEDBACK_DOCS,
    n_terms: int = FEEDBACK_TERMS,
    lam: float = LAMBDA,
) -> DataFrame:
    """Rerank with the expanded query: ``(query_id, stream_id, rank, score)``.

    All documents of a query, or its first ``depth`` after the first pass.
    """
    scores = first_pass(stored, topics, stats, stop)
    if depth is not None:
        scores = materialize(scores, "first-pass")  # read twice, scored once
    feedback = feedback_docs(scores, n_docs)
    few = few_rows(topics, n_docs)
    # a few rows per query, read twice below: stored, so that the first pass runs once
    model = materialize(rm3_model(topics, rm_terms(feedback, stored, few, stop, n_terms), lam), "rm3-model")
    # the expanded model has terms of its own: up to n_terms for each query, whatever the queries hold
    small = fits(model)
    models = query_models(topics, with_background(model, stats, small))
    if depth is None:
        rescored = score_routed(stored, models, small, stop)
        return rank_all(rescored.drop("length"), ["query_id"], by_score())
    kept = top_k(scores, ["query_id"], by_score(), depth, ["stream_id"]).select("query_id", "stream_id")
    reranked = stored.select("query_id", "stream_id", "clean_visible").join(
        side(kept, few_rows(topics, depth)), ["query_id", "stream_id"], "left_semi"
    )
    rescored = score_routed(reranked, models, small, stop)
    return top_k(rescored.drop("length"), ["query_id"], by_score(), depth, ["stream_id"])
