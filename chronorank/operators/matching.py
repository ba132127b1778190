"""Best topics of documents, by an inverted index over the topics.

Both scores of a document and a topic are sums over the terms they share, of a
value of the document's term times a gain of the topic's, and a straight line of
a function ``x`` of the document's length:

              value            gain                   line                        x
likelihood    ln(1 + tf / m)   w                      at_0 - w_sum * x            ln(length + mu)
routing       tf               ln(1 + w / m)          -ln(1 + qlen / mu) * x      length

with ``m = mu * cp`` of the term.  The index has one row a term: its postings,
pairs of a topic and a gain.  It is built from term rows that were counted small
and goes to all tasks; an expression looks a row's tokens up, sums gains and gives
the best topics, so that neither documents, tokens nor pairs are shuffled, and
a document has k topics at most.  More topics than that are taken in blocks.
``all_topics`` lists every pair, in steps of a bounded number of tokens and pairs.

Summing postings needs an array that is added to in place.  Built-in functions
have none: joining tokens with topics shuffles a row for each document and topic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType

from chronorank.functions import text as T
from chronorank.functions.likelihood import MU
from chronorank.operators.ranking import TIE_DIGITS
from chronorank.operators.stats import CollectionStats
from chronorank.operators.topics import Topics, with_background
from chronorank.shared import MAX_BROADCAST_ROWS

#: Sums of a document and a topic that a task holds at a time.
CELLS = 1 << 18
#: Tokens that a task looks up at a time, but for a text that has more.
TOKENS = 1 << 18
#: A term in more than this share of the topics has its gains as a row of a matrix.
COMMON = 0.125


@dataclass(frozen=True)
class TopicIndex:
    """Postings of all terms, ``heads[t]`` to ``heads[t + 1]`` for term ``t``, and lines of the topics.

    Gains of common terms are rows of ``matrix`` instead; ``row`` is a term's
    number there or -1.
    """

    likelihood: bool
    ids: np.ndarray
    level: np.ndarray
    slope: np.ndarray
    terms: pa.Array
    mass: np.ndarray
    heads: np.ndarray
    topic: np.ndarray
    gain: np.ndarray
    row: np.ndarray
    matrix: np.ndarray

    def value(self, tf: np.ndarray, term: np.ndarray) -> np.ndarray:
        return np.log1p(tf / self.mass[term]) if self.likelihood else tf.astype(float)

    def x(self, length: np.ndarray, mu: float) -> np.ndarray:
        return np.log(length + mu) if self.likelihood else length.astype(float)


def build_index(rows: list, ids: list, likelihood: bool, mu: float = MU) -> TopicIndex:
    """Index of rows (term, query_id, w, cp) and topics (query_id, qlen)."""
    ids = sorted(ids)
    number = {query_id: at for at, (query_id, _) in enumerate(ids)}
    rows = sorted(rows)
    topic = np.array([number[r[1]] for r in rows], np.int64)
    w, mass = (np.array([r[at] for r in rows], float) for at in (2, 3))
    mass *= mu
    names = [r[0] for r in rows]
    heads = np.flatnonzero([at == 0 or names[at] != names[at - 1] for at in range(len(rows))])
    if likelihood:
        gain = w
        slope = -np.bincount(topic, w, len(ids))
        level = np.bincount(topic, w * np.log(mass), len(ids))
    else:
        gain = np.log1p(w / mass)
        slope = -np.log1p(np.array([qlen for _, qlen in ids], float) / mu)
        level = np.zeros(len(ids))
    ends = np.r_[heads, len(rows)]
    common = np.diff(ends) > COMMON * len(ids)
    number_of = np.where(common, np.cumsum(common) - 1, -1)
    matrix = np.zeros((int(common.sum()), len(ids)))
    for t in np.flatnonzero(common):
        matrix[number_of[t], topic[ends[t] : ends[t + 1]]] = gain[ends[t] : ends[t + 1]]
    return TopicIndex(
        likelihood, np.array([i for i, _ in ids], np.int32), level, slope, pa.array([names[h] for h in heads], pa.string()),
        mass[heads], ends, topic, gain, number_of, matrix,
    )


def _term_counts(tokens: pa.ListArray, index: TopicIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and frequency of every term of a batch that is in the index."""
    lengths = np.diff(tokens.offsets.to_numpy())
    found = pc.index_in(tokens.flatten(), value_set=index.terms)
    term = found.fill_null(-1).to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(tokens)), lengths)[term >= 0]
    pairs, tf = np.unique(doc * len(index.terms) + term[term >= 0], return_counts=True)
    return pairs // max(1, len(index.terms)), pairs % max(1, len(index.terms)), tf


def _steps(tokens: pa.ListArray, size: int) -> Iterator[pa.ListArray]:
    """Slices of some rows of tokens, within ``TOKENS`` and ``CELLS``; a row at least."""
    ends = tokens.offsets.to_numpy()
    most = max(1, CELLS // max(1, size))
    at = 0
    while at < len(tokens):
        end = int(np.searchsorted(ends, ends[at] + TOKENS, "right")) - 1
        end = min(max(end, at + 1), at + most, len(tokens))
        yield tokens.slice(at, end - at)
        at = end


def _rare_sums(
    index: TopicIndex, doc: np.ndarray, term: np.ndarray, value: np.ndarray, x: np.ndarray
) -> tuple[np.ndarray, np.ndarray | None]:
    """Scores of all topics without common terms, and values of these terms, one column each; null if there are none."""
    n, size = len(x), len(index.ids)
    common = index.row[term] >= 0
    start, count = index.heads[term[~common]], np.diff(index.heads)[term[~common]]
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
    cell = np.repeat(doc[~common], count) * size + index.topic[at]
    sums = np.bincount(cell, np.repeat(value[~common], count) * index.gain[at], n * size).reshape(n, size)
    sums = sums + index.level + x[:, None] * index.slope
    if not common.any():
        return sums, None
    given = np.zeros((n, len(index.matrix)))
    given[doc[common], index.row[term[common]]] = value[common]
    return sums, given


def _best(
    index: TopicIndex, doc: np.ndarray, term: np.ndarray, value: np.ndarray, x: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Topics and scores of the ``k`` best of each of some documents, best first.

    Rare terms are summed from their postings.  What common terms add to a topic
    is at most the greatest gain of each, and at most the product of both
    lengths; so they are summed only where that reaches the k-th best topic.
    """
    n, size = len(x), len(index.ids)
    sums, given = _rare_sums(index, doc, term, value, x)
    if given is not None:
        lengths = np.linalg.norm(given, axis=1)[:, None] * np.linalg.norm(index.matrix, axis=0)
        reach = np.minimum((given @ index.matrix.max(axis=1))[:, None], lengths)
        least = np.partition(sums, size - k, axis=1)[:, size - k]
        d, q = np.nonzero(sums + reach >= least[:, None] - 1e-6)
        if 8 * len(d) > n * size:
            sums = sums + given @ index.matrix
        else:
            full = np.full(sums.shape, -np.inf)
            for piece in np.array_split(np.arange(len(d)), 1 + len(d) * len(index.matrix) // CELLS):
                i, j = d[piece], q[piece]
                full[i, j] = sums[i, j] + np.einsum("ih,hi->i", given[i], index.matrix[:, j])
            sums = full
    if k == 1:
        topic = np.round(sums, TIE_DIGITS).argmax(axis=1)
        return topic, sums[np.arange(n), topic]
    rounded = np.round(sums, TIE_DIGITS)
    least = np.partition(rounded, size - k, axis=1)[:, size - k]
    d, q = np.nonzero(rounded >= least[:, None])
    order = np.lexsort((q, -rounded[d, q], d))
    d, q = d[order], q[order]
    first = np.arange(len(d)) - np.searchsorted(d, d) < k
    return q[first], sums[d[first], q[first]]


ENTRIES = "array<struct<query_id: int, score: double>>"


def _matcher(index: TopicIndex, k: int, mu: float) -> Callable[[Column], Column]:
    """Expression of a token array: its ``k`` best topics of ``index``, best first."""
    size = len(index.ids)

    def match(tokens: pa.Array) -> pa.Array:
        query_id, score = [], []
        for part in _steps(tokens, size) if size else ():
            doc, term, tf = _term_counts(part, index)
            x = index.x(np.diff(part.offsets.to_numpy()).astype(np.int64), mu)
            topic, sums = _best(index, doc, term, index.value(tf, term), x, min(k, size))
            query_id.append(index.ids[topic])
            score.append(sums)
        entries = pa.StructArray.from_arrays(
            [pa.array(np.concatenate([np.zeros(0, np.int32), *query_id])), pa.array(np.concatenate([np.zeros(0), *score]))],
            ["query_id", "score"],
        )
        return pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * min(k, size)), entries)

    return F.arrow_udf(match, ENTRIES)


def _indexes(
    topics: Topics, stats: CollectionStats, measure: str, background: str, mu: float, max_rows: int
) -> list[TopicIndex]:
    """Indexes that hold all topics together, each up to about ``max_rows`` term rows."""
    terms = with_background(topics.terms, stats, topics.small, background).select("term", "query_id", "w", "cp")
    blocks = 1
    if not topics.small:
        # blocks of about half the size, as topics are dealt by hash
        blocks = max(1, -(-2 * topics.terms.count() // max_rows))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = []
    for number in range(blocks):
        rows, ids = (
            [tuple(row) for row in (df.where(block == number) if blocks > 1 else df).collect()]
            for df in (terms, topics.ids.select("query_id", "qlen"))
        )
        found.append(build_index(rows, ids, measure == "kl", mu))
    return found


def topic_matcher(
    topics: Topics,
    stats: CollectionStats,
    k: int,
    measure: str = "kl",
    background: str = "default_one",
    mu: float = MU,
    max_rows: int = MAX_BROADCAST_ROWS,
) -> Callable[[Column], Column]:
    """Expression that gives a token array its ``k`` best topics, as (query_id, score), best first.

    ``kl``     the topic's likelihood under the document
    ``route``  the document's under the topic, without its own constant

    Topics that share no term take part like all others; ties go to the lowest
    id.  Fewer than ``k`` topics are all listed.

    An index has up to ``max_rows`` term rows.  If there are more, topics are
    dealt to blocks with an index each, and the best of all blocks are ranked
    again within the row.
    """
    matchers = [_matcher(index, k, mu) for index in _indexes(topics, stats, measure, background, mu, max_rows)]
    if len(matchers) == 1:
        return matchers[0]

    def match(tokens: Column) -> Column:
        entries = F.transform(
            F.concat(*(one(tokens) for one in matchers)),
            lambda e: F.struct((-F.round(e["score"], TIE_DIGITS)).alias("order"), e["query_id"].alias("query_id"), e["score"].alias("score")),
        )
        return F.transform(
            F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(e["query_id"].alias("query_id"), e["score"].alias("score"))
        )

    return match


def tokens_of(text: str, stop: T.Stop = ()) -> Column:
    """Tokens of a text; none of a null one."""
    return F.coalesce(T.words(text, stop), F.array().cast("array<string>"))


def best_topics(
    docs: DataFrame,
    topics: Topics,
    stats: CollectionStats,
    k: int,
    measure: str = "kl",
    key: str = "doc_id",
    text: str = "clean_visible",
    stop: T.Stop = (),
    background: str = "default_one",
    mu: float = MU,
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``(key, query_id, rank, length, score)`` of the ``k`` best topics of each row of ``docs`` (``topic_matcher``)."""
    match = topic_matcher(topics, stats, k, measure, background, mu, max_rows)
    tokens = docs.select(key, tokens_of(text, stop).alias("_tokens"))
    found = tokens.select(key, F.size("_tokens").cast("long").alias("length"), match(F.col("_tokens")).alias("_best"))
    rows = found.select(key, "length", F.posexplode("_best").alias("_at", "_topic"))
    return rows.select(key, "_topic.query_id", (F.col("_at") + 1).cast("long").alias("rank"), "length", "_topic.score")


def all_topics(
    docs: DataFrame,
    topics: Topics,
    stats: CollectionStats,
    measure: str = "kl",
    key: str = "doc_id",
    text: str = "clean_visible",
    keep: Sequence[str] = (),
    stop: T.Stop = (),
    background: str = "default_one",
    mu: float = MU,
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``(key, *keep, query_id, rank, length, score)`` of every row of ``docs`` and every topic (``topic_matcher``).

    Pairs are made and handed on in steps, so that a task holds a bounded number
    of them, whatever documents and topics there are.  No shuffle.
    """
    indexes = _indexes(topics, stats, measure, background, mu, max_rows)
    ids = np.concatenate([index.ids for index in indexes])
    by_id = np.argsort(ids)
    size = len(ids)
    ids = ids[by_id]
    given = docs.select(key, *keep, tokens_of(text, stop).alias("_tokens"))
    held = [key, *keep]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            tokens = batch.column("_tokens")
            for part in _steps(tokens, size) if size else ():
                length = np.diff(part.offsets.to_numpy()).astype(np.int64)
                sums = []
                for index in indexes:
                    doc, term, tf = _term_counts(part, index)
                    own, common = _rare_sums(index, doc, term, index.value(tf, term), index.x(length, mu))
                    sums.append(own if common is None else own + common @ index.matrix)
                score = np.concatenate(sums, axis=1)[:, by_id]
                order = np.argsort(-np.round(score, TIE_DIGITS), axis=1, kind="stable")
                rows = pa.array(np.repeat(np.arange(at, at + len(part)), size))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(name).take(rows) for name in held),
                        pa.array(ids[order].ravel()),
                        pa.array(np.tile(np.arange(1, size + 1), len(part))),
                        pa.array(np.repeat(length, size)),
                        pa.array(np.take_along_axis(score, order, axis=1).ravel()),
                    ],
                    [*held, "query_id", "rank", "length", "score"],
                )
                at += len(part)

    schema = docs.select(*held).schema
    for name, kind in (("query_id", IntegerType()), ("rank", LongType()), ("length", LongType()), ("score", DoubleType())):
        schema = schema.add(name, kind)
    return given.mapInArrow(pairs, schema)
