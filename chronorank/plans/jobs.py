"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronorank.functions.text import has_text
from chronorank.operators import analysis as A
from chronorank.operators import export as E
from chronorank.operators import feedback as FB
from chronorank.operators import loading as LD
from chronorank.operators import matching as MT
from chronorank.operators import ranking as RK
from chronorank.operators import routing as R
from chronorank.operators import scoring as SC
from chronorank.operators import sentences as S
from chronorank.operators import stats as ST
from chronorank.plans.corpus import STOP, Corpus
from chronorank.sources.items import lookup_items, scan_bins, scan_query

# Parameters of the registered scans and filters.
SCAN_QUERY = 3
SCAN_LOW, SCAN_HIGH = 20, 50
SMALL_LIMIT = 4096
SHALLOW_DEPTH = 5
DUMP_QUERY = 1

Job = Callable[[Corpus], DataFrame]
JOBS: dict[str, Job] = {}


def job(fn: Job) -> Job:
    JOBS[fn.__name__.rstrip("_")] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Double columns rounded for comparison."""
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    changed: dict[str, Column] = {c: F.round(c, special.get(c, digits)) for c in doubles}
    return df.withColumns(changed) if changed else df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Job) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Corpus(spark, folder))

        return run

    return {name: bind(fn) for name, fn in JOBS.items()}


# scans


STORED = ["query_id", "date_bin", "rowkey", "stream_id", "epoch_ms", "source"]


@job
def scan_items(c: Corpus) -> DataFrame:
    return c.stored().select(*STORED, "clean_visible")


@job
def scan_bins_(c: Corpus) -> DataFrame:
    return scan_bins(c.placed(), SCAN_QUERY, SCAN_LOW, SCAN_HIGH).select(*STORED)


@job
def scan_query_(c: Corpus) -> DataFrame:
    return scan_query(c.placed(), SCAN_QUERY).select(*STORED)


@job
def lookup_items_(c: Corpus) -> DataFrame:
    """Stored rows of all feedback documents."""
    topics = c.topics()
    keys = FB.feedback_docs(FB.first_pass(c.stored(), topics, c.stats(), STOP))
    few = FB.few_rows(topics, FB.FEEDBACK_DOCS)
    return lookup_items(c.placed(), keys, few).select(*STORED, "clean_visible")


@job
def topics(c: Corpus) -> DataFrame:
    vectors = c.topics()
    return vectors.terms.join(vectors.ids, "query_id")


@job
def date_bins(c: Corpus) -> DataFrame:
    return c.date_bins()


# filters and scalars


@job
def valid_items(c: Corpus) -> DataFrame:
    return R.valid_items(c.all_items()).select("stream_id", "source", "body.clean_visible")


@job
def size_filter(c: Corpus) -> DataFrame:
    return R.size_filter(c.items(), SMALL_LIMIT).select("stream_id", "n_bytes", "accepted")


@job
def item_times(c: Corpus) -> DataFrame:
    return R.item_times(c.all_items()).select("stream_id", "epoch_ms", "hour")


@job
def sentences(c: Corpus) -> DataFrame:
    return S.sentences(c.items())


@job
def update_ids(c: Corpus) -> DataFrame:
    return c.sentences().select("stream_id", "sent_num", "updateid")


@job
def id_shards(c: Corpus) -> DataFrame:
    return E.id_shards(c.captures())


@job
def trec_export(c: Corpus) -> DataFrame:
    url = c.table("pages").select(F.col("page_id").alias("doc_id"), F.encode("url", "UTF-8").alias("abs_url"))
    return E.trec_records(c.items().join(url, "doc_id", "left"))


# text vectors and counts


@job
def doc_terms(c: Corpus) -> DataFrame:
    return ST.doc_terms(c.documents())


@job
def doc_terms_stopped(c: Corpus) -> DataFrame:
    return ST.doc_terms(c.documents(), stop=STOP)


@job
def doc_lengths(c: Corpus) -> DataFrame:
    return ST.doc_lengths(c.documents(), also=STOP)


@job
def word_count(c: Corpus) -> DataFrame:
    return ST.word_count(c.documents().filter(has_text("clean_visible")))


@job
def word_count_stored(c: Corpus) -> DataFrame:
    return ST.word_count(c.stored())


@job
def word_count_ids(c: Corpus) -> DataFrame:
    """Words of the labelled documents."""
    return ST.word_count_of(c.stored(), c.listed_ids())


@job
def row_count(c: Corpus) -> DataFrame:
    return ST.row_count(c.stored())


@job
def collection_stats(c: Corpus) -> DataFrame:
    return ST.collection_stats(c.documents())


@job
def collection_total(c: Corpus) -> DataFrame:
    return ST.collection_total(ST.collection_stats(c.documents()))


# scores


@job
def kl_scores(c: Corpus) -> DataFrame:
    """Every document and topic by query likelihood."""
    return rounded(MT.all_topics(c.documents(), c.topics(), c.stats()))


def _routed_scores(c: Corpus, measure: str) -> DataFrame:
    vectors = c.topics()
    return rounded(SC.score_routed(c.stored(), c.models(vectors), vectors.small, measure=measure))


@job
def kl_scores_routed(c: Corpus) -> DataFrame:
    return _routed_scores(c, "kl")


@job
def cer_scores(c: Corpus) -> DataFrame:
    return _routed_scores(c, "cer")


@job
def maxest_scores(c: Corpus) -> DataFrame:
    return _routed_scores(c, "maxest")


@job
def score_bounds(c: Corpus) -> DataFrame:
    vectors = c.topics()
    return rounded(SC.score_bounds(c.stored(), c.models(vectors), vectors.small))


@job
def rank_docs(c: Corpus) -> DataFrame:
    vectors = c.topics()
    scores = SC.score_routed(c.stored(), c.models(vectors), vectors.small).drop("length")
    return rounded(RK.rank_all(scores, ["query_id"], RK.by_score()))


# routing


@job
def route_scores(c: Corpus) -> DataFrame:
    """Every document and topic by routing score."""
    return rounded(R.route_scores(c.documents(), c.topics(), c.stats()), 3)


def _with_stream_ids(c: Corpus, routed: DataFrame) -> DataFrame:
    return routed.join(c.captures().select("doc_id", "stream_id"), "doc_id")


@job
def route(c: Corpus) -> DataFrame:
    return rounded(_with_stream_ids(c, c.routed()).select("stream_id", "query_id", "margin"))


@job
def route_add_one(c: Corpus) -> DataFrame:
    """Local variant: stopped documents and topics, add-one background."""
    routed = R.route(c.documents(), c.topics(STOP), c.stats(), stop=STOP, background="add_one")
    return rounded(_with_stream_ids(c, routed).select("stream_id", "query_id", "margin"))


@job
def route_assignments(c: Corpus) -> DataFrame:
    return R.route_assignments(_with_stream_ids(c, c.routed()))


@job
def route_load(c: Corpus) -> DataFrame:
    """Rows of the stored table, as the load job makes them."""
    return c.routed_items(c.loader()).where("reason is null").select(*STORED, "hour", "clean_visible")


@job
def rejected_items(c: Corpus) -> DataFrame:
    """Captures that the load job does not store, and why."""
    return c.routed_items(c.loader()).where("reason is not null").select(*LD.REJECTED)


# feedback


@job
def feedback_docs(c: Corpus) -> DataFrame:
    return rounded(FB.feedback_docs(FB.first_pass(c.stored(), c.topics(), c.stats(), STOP)))


def _relevance(c: Corpus) -> DataFrame:
    vectors = c.topics()
    feedback = FB.feedback_docs(FB.first_pass(c.stored(), vectors, c.stats(), STOP))
    return FB.rm_terms(feedback, c.stored(), FB.few_rows(vectors, FB.FEEDBACK_DOCS), STOP)


@job
def rm_terms(c: Corpus) -> DataFrame:
    return rounded(_relevance(c), 8)


@job
def rm3_model(c: Corpus) -> DataFrame:
    return rounded(FB.rm3_model(c.topics(), _relevance(c)), 8)


@job
def rm3_rerank(c: Corpus) -> DataFrame:
    return rounded(FB.rm3_rerank(c.stored(), c.topics(), c.stats(), STOP))


@job
def rm3_rerank_top1000(c: Corpus) -> DataFrame:
    return rounded(FB.rm3_rerank(c.stored(), c.topics(), c.stats(), STOP, depth=FB.DEPTH))


@job
def rm3_rerank_shallow(c: Corpus) -> DataFrame:
    """With a depth that most documents lie below."""
    return rounded(FB.rm3_rerank(c.stored(), c.topics(), c.stats(), STOP, depth=SHALLOW_DEPTH))


@job
def rm3_rerank_hours(c: Corpus) -> DataFrame:
    """One query over a range of hours."""
    return rounded(FB.rm3_rerank_hours(c.stored(), c.topics(), c.stats(), SCAN_QUERY, SCAN_LOW, SCAN_HIGH, STOP))


# sentences


@job
def sentence_scores(c: Corpus) -> DataFrame:
    return rounded(c.sentence_scores())


@job
def sentence_dump(c: Corpus) -> DataFrame:
    """One query against everything, with statistics of another collection."""
    vectors = c.topics()
    model = SC.topic_models(vectors, c.external_stats()).filter(F.col("query_id") == DUMP_QUERY)
    items = c.items().withColumn("path", F.lit("documents"))
    return rounded(S.sentence_dump(items, model))


@job
def latest_sentence(c: Corpus) -> DataFrame:
    return S.by_epoch(rounded(S.latest_sentence(c.sentence_scores())))


# analysis


@job
def match_scores(c: Corpus) -> DataFrame:
    return rounded(A.match_scores(c.out(), c.matches()))


@job
def doc_vs_nugget(c: Corpus) -> DataFrame:
    return rounded(A.doc_vs_nugget(c.out(), c.matches(), c.nuggets(), by=["query_id"]))


@job
def sent_vs_nugget(c: Corpus) -> DataFrame:
    return rounded(A.sent_vs_nugget(c.out(), c.matches(), c.nuggets(), by=["query_id"]))


@job
def sentence_position(c: Corpus) -> DataFrame:
    return rounded(A.sentence_position(c.out()))


@job
def sentence_position_nugget(c: Corpus) -> DataFrame:
    return rounded(A.sentence_position_nugget(c.out(), c.matches(), c.nuggets()))


@job
def doc_score_by_time(c: Corpus) -> DataFrame:
    return rounded(A.doc_score_by_time(c.out(), by=["query_id"]))


@job
def nonmatch_pooled(c: Corpus) -> DataFrame:
    return rounded(A.nonmatch_pooled(c.out(), c.matches(), c.pooled()))


@job
def nonmatch_all(c: Corpus) -> DataFrame:
    return rounded(A.nonmatch_all(c.out(), c.matches()))


@job
def match_vs_nonmatch(c: Corpus) -> DataFrame:
    return rounded(A.match_vs_nonmatch(c.out(), c.matches(), c.pooled(), c.nuggets()))


@job
def nugget_epochs(c: Corpus) -> DataFrame:
    return rounded(A.nugget_epochs(c.out(), c.matches(), c.nuggets()))


@job
def nugget_score_by_time(c: Corpus) -> DataFrame:
    return rounded(A.nugget_score_by_time(c.matches(), c.nuggets()))
