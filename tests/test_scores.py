"""Scores, routing and feedback on tiny collections, against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronorank.operators import feedback as FB
from chronorank.operators import matching as MT
from chronorank.operators import ranking as RK
from chronorank.operators import routing as R
from chronorank.operators import scoring as SC
from chronorank.operators import stats as ST
from chronorank.operators.topics import topic_vectors

MU = 2500.0
DOCS = {
    1: "storm hits the coast storm",
    2: "fire in the hills",
    3: "... !!!",
    4: "storm fire coast hills unseen words here",
}
TOPICS = {1: "storm coast", 2: "fire fire hills", 5: "nowhere else"}


def kl(query, text, cf, total):
    score = 0.0
    length = sum(text.values())
    for term, weight in query.items():
        cp = cf.get(term, 1) / total
        score += weight * math.log((text.get(term, 0) + MU * cp) / (length + MU))
    return score


@pytest.fixture(scope="module")
def data(spark):
    docs = spark.createDataFrame(
        [(k, f"{k}-x", v) for k, v in DOCS.items()], "doc_id long, stream_id string, clean_visible string"
    )
    topics = topic_vectors(spark.createDataFrame(list(TOPICS.items()), "query_id int, query string"))
    bags = {k: Counter(w for w in v.split() if w.isalpha()) for k, v in DOCS.items()}
    queries = {k: Counter(v.split()) for k, v in TOPICS.items()}
    cf = sum(bags.values(), Counter())
    return docs, topics, ST.as_collection(ST.collection_stats(docs)), bags, queries, cf, sum(cf.values())


def test_best_topics_are_all_topics_in_order(data):
    docs, topics, stats, bags, queries, cf, total = data
    for k in (1, 2, 9):
        rows = MT.best_topics(docs, topics, stats, k).collect()
        found = {(r.doc_id, r.rank): (r.query_id, r.length, r.score) for r in rows}
        assert len(found) == len(rows) == min(k, len(queries)) * len(bags)
        for doc, bag in bags.items():
            scores = {q: kl(queries[q], bag, cf, total) for q in queries}
            order = sorted(queries, key=lambda q: (-round(scores[q], 9), q))[:k]
            for rank, query in enumerate(order, 1):
                assert found[doc, rank] == (query, sum(bag.values()), pytest.approx(scores[query], abs=1e-9))


def test_best_topics_with_common_terms_and_bounds(spark):
    """Many topics, of which common terms decide few: bounds, the matrix and blocks of topics."""
    draw = random.Random(5)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(300)]
    texts = {i: " ".join(draw.choices(common, k=20) + draw.choices(rare, k=draw.randrange(6))) for i in range(30)}
    texts[30], texts[31] = "", "nothing known"
    queries = {q: " ".join(draw.choices(common, k=3) + draw.choices(rare, k=4)) for q in range(1, 120)}
    queries[120] = queries[7]  # a tie
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, clean_visible string")
    topics = topic_vectors(spark.createDataFrame(list(queries.items()), "query_id int, query string"))
    stats = ST.as_collection(ST.collection_stats(docs))
    bags = {k: Counter(v.split()) for k, v in texts.items()}
    vectors = {q: Counter(v.split()) for q, v in queries.items()}
    cf = sum(bags.values(), Counter())
    total = sum(cf.values())
    for measure in ("kl", "route"):
        rows = MT.best_topics(docs, topics, stats, 5, measure).collect()
        found = {(r.doc_id, r.rank): r.query_id for r in rows}
        for doc, bag in bags.items():
            scores = {q: kl(v, bag, cf, total) if measure == "kl" else kl(bag, v, cf, total) for q, v in vectors.items()}
            order = sorted(vectors, key=lambda q: (-round(scores[q], 9), q))[:5]
            assert [found[doc, rank] for rank in range(1, 6)] == order
        large = type(topics)(topics.terms, topics.ids, False)
        dealt = MT.best_topics(docs, large, stats, 5, measure, max_rows=300).collect()
        assert {(r.doc_id, r.rank): r.query_id for r in dealt} == found


def test_matching_moves_nothing(data):
    docs, topics, stats, *_ = data
    text = MT.best_topics(docs, topics, stats, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text


def test_null_texts_and_no_topics(spark, data):
    _, topics, stats, *_ = data
    docs = spark.createDataFrame([(1, None), (None, "storm")], "doc_id long, clean_visible string")
    assert {(r.doc_id, r.query_id) for r in MT.best_topics(docs, topics, stats, 1, "route").collect()} == {(1, 1), (None, 1)}
    none = topic_vectors(spark.createDataFrame([], "query_id int, query string"))
    assert MT.best_topics(docs, none, stats, 3).collect() == []


def test_route_takes_best_topic_and_lowest_id_on_ties(data):
    docs, topics, stats, bags, queries, cf, total = data
    found = {r.doc_id: r.query_id for r in R.route(docs, topics, stats).collect()}
    for doc, bag in bags.items():
        scores = {q: round(kl(bag, queries[q], cf, total), 9) for q in queries}
        best = min(q for q in scores if scores[q] == max(scores.values()))
        assert found[doc] == best
    assert found[3] == 1  # no words: all topics score 0


def test_route_without_overlap_prefers_short_topics(spark, data):
    _, _, stats, *_ = data
    docs = spark.createDataFrame([(1, "alien words only")], "doc_id long, clean_visible string")
    topics = topic_vectors(
        spark.createDataFrame([(1, "a b c"), (3, "d"), (2, "e")], "query_id int, query string")
    )
    assert [r.query_id for r in R.route(docs, topics, stats).collect()] == [2]


def test_route_without_broadcast_is_the_same(data):
    docs, topics, stats, *_ = data
    large = type(topics)(topics.terms, topics.ids, False)
    assert R.route(docs, large, stats).exceptAll(R.route(docs, topics, stats)).count() == 0


def test_routed_measures(spark, data):
    docs, topics, stats, bags, queries, cf, total = data
    stored = docs.withColumn("query_id", F.when(F.col("doc_id") == 3, 5).otherwise(F.lit(2)))
    models = SC.topic_models(topics, stats)
    query_of = {d: (5 if d == 3 else 2) for d in bags}

    def by_doc(df):
        return {int(r.stream_id.split("-")[0]): r for r in df.collect()}

    kls = by_doc(SC.score_routed(stored, models, True))
    cers = by_doc(SC.score_routed(stored, models, True, measure="cer"))
    ones = by_doc(SC.score_routed(stored, models, True, measure="maxest"))
    limits = by_doc(SC.score_bounds(stored, models, True))
    for doc, bag in bags.items():
        query, length = queries[query_of[doc]], sum(bag.values())
        cps = {t: cf.get(t, 1) / total for t in query}
        qlen = sum(query.values())
        assert kls[doc].score == pytest.approx(kl(query, bag, cf, total), abs=1e-9)
        cer = sum(
            w / qlen * math.log((bag.get(t, 0) + MU * cps[t]) / (length + MU) / cps[t])
            for t, w in query.items()
        )
        assert cers[doc].score == pytest.approx(cer, abs=1e-9)

        def at(tf, query=query, cps=cps, length=length):
            return sum(w * math.log((tf + MU * cps[t]) / (length + MU)) for t, w in query.items())

        assert ones[doc].score == pytest.approx(at(1), abs=1e-9)
        assert limits[doc].min_score == pytest.approx(at(0), abs=1e-9)
        assert limits[doc].practical_score == pytest.approx(at(10), abs=1e-9)
        best = qlen * math.log((length + MU * max(cps.values())) / (length + MU))
        assert limits[doc].max_score == pytest.approx(best, abs=1e-9)


def test_topic_without_terms_scores_zero(spark, data):
    docs, _, stats, *_ = data
    topics = topic_vectors(spark.createDataFrame([(1, "!!!")], "query_id int, query string"))
    stored = docs.withColumn("query_id", F.lit(1))
    scores = SC.score_routed(stored, SC.topic_models(topics, stats), True).collect()
    assert [r.score for r in scores] == [0.0] * len(DOCS)


def test_feedback_model(data):
    docs, topics, stats, bags, queries, cf, total = data
    stored = docs.withColumn("query_id", F.lit(2))
    feedback = FB.feedback_docs(FB.first_pass(stored, topics, stats), 2)
    model = FB.rm_terms(feedback, stored, True, n_terms=3).collect()
    scores = sorted(((kl(queries[2], b, cf, total), d) for d, b in bags.items()), reverse=True)[:2]
    raw = Counter()
    used = [(s, d) for s, d in scores if bags[d]]
    for score, d in used:
        for term, tf in bags[d].items():
            raw[term] += math.exp(score) * tf / sum(bags[d].values()) / len(used)
    top = sorted(raw.items(), key=lambda kv: (-round(kv[1] * 1e12), kv[0]))[:3]
    norm = sum(v for _, v in top)
    assert sorted(r.weight for r in model) == pytest.approx(sorted(v / norm for _, v in top))
    assert sum(r.weight for r in model) == pytest.approx(1.0)


def test_rerank_with_query_only_keeps_the_order(data):
    docs, topics, stats, *_ = data
    stored = docs.withColumn("query_id", F.lit(2))
    first = RK.rank_all(FB.first_pass(stored, topics, stats).drop("length"), ["query_id"], RK.by_score())
    again = FB.rm3_rerank(stored, topics, stats, lam=1.0)
    assert {(r.stream_id, r.rank) for r in first.collect()} == {(r.stream_id, r.rank) for r in again.collect()}


def test_rerank_depth_above_number_of_documents(data):
    docs, topics, stats, *_ = data
    stored = docs.withColumn("query_id", F.lit(1))
    assert FB.rm3_rerank(stored, topics, stats, depth=1000).count() == len(DOCS)


def test_rank_of_a_hot_group(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 10 < 9, 1).otherwise(2).alias("query_id"),
        F.format_string("s%05d", "id").alias("stream_id"),
        (F.col("id") % 7 / 3).alias("score"),
    )
    ranked = RK.rank_all(rows, ["query_id"], RK.by_score()).collect()
    for query in (1, 2):
        group = sorted((-round(r.score, 9), r.stream_id, r.rank) for r in ranked if r.query_id == query)
        assert [g[2] for g in group] == list(range(1, len(group) + 1))
    top = RK.top_k(rows, ["query_id"], RK.by_score(), 50, ["stream_id"])
    expected = {(r.query_id, r.stream_id, r.rank) for r in ranked if r.rank <= 50}
    assert {(r.query_id, r.stream_id, r.rank) for r in top.collect()} == expected


def test_top_k_of_any_depth(spark):
    rows = spark.range(3000).selectExpr("1 AS query_id", "cast(id AS string) AS stream_id", "cast(id % 700 AS double) AS score")
    order = RK.by_score()
    want = {(r.stream_id, r.rank) for r in RK.rank_all(rows, ["query_id"], order).collect()}
    for k in (10, 1000, 1001, 2_000_000):
        top = RK.top_k(rows, ["query_id"], order, k, ["stream_id"])
        assert dict(top.dtypes)["rank"] == "bigint"
        assert {(r.stream_id, r.rank) for r in top.collect()} == {w for w in want if w[1] <= k}
        plan = top._jdf.queryExecution().executedPlan().toString()
        # either groups are cut before they move, or no group is in one task at all
        assert ("WindowGroupLimit" in plan) == (k <= 1000)


def test_many_short_queries_expand_beyond_the_bound(spark, monkeypatch):
    """One-term queries are small; what feedback makes of them need not be."""
    queries = {q: f"t{q}" for q in range(30)}
    texts = [(f"s{q}-{i}", q, f"t{q} " + " ".join(f"w{q}x{j}" for j in range(i, i + 12))) for q in queries for i in range(3)]
    stored = spark.createDataFrame(texts, "stream_id string, query_id int, clean_visible string")
    topics = topic_vectors(spark.createDataFrame(list(queries.items()), "query_id int, query string"))
    stats = ST.as_collection(ST.collection_stats(stored))
    want = {(r.stream_id, r.rank, round(r.score, 9)) for r in FB.rm3_rerank(stored, topics, stats).collect()}
    hints = []

    def fits(df, max_rows=100):
        hints.append(df.limit(max_rows + 1).count() <= max_rows)
        return hints[-1]

    # with a bound between the terms of the queries and those of the expanded models
    monkeypatch.setattr(FB, "fits", fits)
    assert {(r.stream_id, r.rank, round(r.score, 9)) for r in FB.rm3_rerank(stored, topics, stats).collect()} == want
    assert topics.small and hints[-1] is False
