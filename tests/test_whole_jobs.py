"""Jobs over every pair, and the tables that queries share."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronorank.functions import likelihood as L
from chronorank.functions import text as T
from chronorank.operators import analysis as A
from chronorank.operators import matching as MT
from chronorank.operators import stats as ST
from chronorank.operators.topics import Topics, topic_vectors
from chronorank.plans.corpus import Corpus, forget
from chronorank.shared import shared_dir


def test_pairs_of_all_documents_and_topics(spark):
    texts = {1: "a b b r1", 2: "r2 r2 a", 3: "", 4: None, 5: "nothing known"}
    queries = {q: f"a r{q % 4} r{q % 7}" for q in range(1, 40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, clean_visible string")
    topics = topic_vectors(spark.createDataFrame(list(queries.items()), "query_id int, query string"))
    stats = ST.as_collection(ST.collection_stats(docs))
    for measure in ("kl", "route"):
        best = MT.best_topics(docs, topics, stats, len(queries), measure).collect()
        for some in (topics, Topics(topics.terms, topics.ids, False)):
            rows = MT.all_topics(docs, some, stats, measure, max_rows=30).collect()
            assert len(rows) == len(texts) * len(queries)
            assert [(r.doc_id, r.rank, r.query_id, r.length) for r in sorted(rows, key=lambda r: (r.doc_id, r.rank))] == [
                (r.doc_id, r.rank, r.query_id, r.length) for r in sorted(best, key=lambda r: (r.doc_id, r.rank))
            ]
            scores = {(r.doc_id, r.query_id): r.score for r in best}
            assert all(r.score == pytest.approx(scores[r.doc_id, r.query_id], abs=1e-9) for r in rows)
    none = topic_vectors(spark.createDataFrame([], "query_id int, query string"))
    assert MT.all_topics(docs, none, stats).collect() == []


def test_steps_are_bounded_and_lose_no_row():
    draw = np.random.default_rng(3)
    lengths = [int(n) for n in draw.integers(0, 60_000, 90)] + [MT.TOKENS + 5, 0, 0, 7]
    tokens = pa.array([["x"] * n for n in lengths], pa.list_(pa.string()))
    for rows in (tokens, tokens.slice(3)):
        parts = list(MT._steps(rows, 1 << 16))
        assert pa.concat_arrays(parts).equals(rows) and len(parts) > 6
        for part in parts:
            assert len(part) * (1 << 16) <= MT.CELLS
            assert len(part) == 1 or len(part.flatten()) <= MT.TOKENS


@pytest.mark.parametrize("name", ["kl_scores", "route_scores"])
def test_scores_hold_every_document_and_topic(spark, folder, name):
    corpus = Corpus(spark, folder)
    rows = entry.queries()[name](spark, folder)
    pairs = corpus.table("documents").count() * corpus.table("benchmark").count()
    assert rows.count() == pairs == rows.select("doc_id", "query_id").distinct().count()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_readers_of_all_stored_rows_need_one_write_of_the_texts(spark, folder):
    """Texts are neither sorted nor moved to places, and no sentences are written."""
    forget()
    own = Path(shared_dir(spark)) / "chronorank" / spark.sparkContext.applicationId
    before = set(own.glob("*")) if own.exists() else set()
    corpus = Corpus(spark, folder)
    stored = corpus.stored()
    new = sorted(p.name.rpartition("-")[0] for p in set(own.glob("*")) - before)
    assert new == ["collection-stats", "date-bins", "routed-items"]
    assert "body" not in corpus.routed_table().columns and "body" in stored.columns
    names = ["query_id", "date_bin", "rowkey", "stream_id", "epoch_ms", "source", "clean_visible"]
    assert stored.select(names).exceptAll(corpus.placed().select(names)).isEmpty()
    assert stored.count() == corpus.placed().count()
    _, physical = plan(corpus.captured(corpus.documents()))
    assert "ShuffledHashJoin" in physical and "Sort " not in physical


def test_sentences_are_cut_once(spark, folder):
    corpus = Corpus(spark, folder)
    for df in (corpus.sentences(), corpus.sentence_scores()):
        logical, _ = plan(df)
        assert logical.count("[^.!?") == 1


def test_scored_sentences_meet_judgments_without_a_sort(spark, folder):
    corpus = Corpus(spark, folder)
    assert "sentence" not in corpus.pooled().columns
    out, matches, pooled, nuggets = corpus.out(), corpus.matches(), corpus.pooled(), corpus.nuggets()
    for df in (
        A.match_scores(out, matches),
        A.sentence_position_nugget(out, matches, nuggets),
        A.nonmatch_all(out, matches),
        A.nonmatch_pooled(out, matches, pooled),
        A.match_vs_nonmatch(out, matches, pooled, nuggets),
    ):
        _, physical = plan(df)
        assert "SortMergeJoin" not in physical


def test_listed_ids_meet_texts_without_a_sort(spark, folder, monkeypatch):
    """a long list of ids is hashed; a short one leaves the texts where they are."""
    texts = {"a": "x y y", "b": "x", "c": None, "d": "z"}
    docs = spark.createDataFrame(list(texts.items()), "stream_id string, clean_visible string")
    ids = spark.createDataFrame([("a",), ("a",), ("c",), ("d",), ("e",), (None,)], "stream_id string")
    short = ST.word_count_of(docs, ids)
    monkeypatch.setattr(ST, "fits", lambda df: False)
    long = ST.word_count_of(docs, ids)
    for df in (short, long):
        assert sorted(map(tuple, df.collect())) == [("x", 1), ("y", 2), ("z", 1)]
    assert "ShuffledHashJoin" in plan(long)[1] and "SortMergeJoin" not in plan(long)[1]
    _, physical = plan(entry.queries()["word_count_ids"](spark, folder))
    assert "SortMergeJoin" not in physical


def test_gains_of_matches_in_one_pass(spark, folder, monkeypatch):
    """texts are passed over once, in bounded steps, not once for every term of their topic."""
    draw = random.Random(4)
    terms = [f"t{n}" for n in range(30)]
    tokens = [None if n % 9 == 1 else draw.choices(terms, k=draw.randint(0, 9)) for n in range(70)]
    models = [None if n % 8 == 3 else {t: (draw.random(), draw.random() + 0.1) for t in draw.sample(terms, n % 7)} for n in range(70)]
    given = [
        pa.array(tokens, pa.list_(pa.string())),
        pa.array([None if m is None else list(m) for m in models], pa.list_(pa.string())),
        *(pa.array([None if m is None else [v[i] for v in m.values()] for m in models], pa.list_(pa.float64())) for i in (0, 1)),
    ]

    def gain(text, model):
        return sum(w * np.log1p((text or []).count(t) / mass) for t, (w, mass) in (model or {}).items())

    for size in (5, 1 << 18):
        monkeypatch.setattr(L, "TOKENS", size)
        for part in (slice(None), slice(11, 64)):
            got = L._text_gains(*(column[part] for column in given)).to_pylist()
            assert got == pytest.approx([gain(t, m) for t, m in zip(tokens[part], models[part], strict=True)])
    assert [end - start for start, end in L._steps(np.array([9, 3, 4]))] == [3]
    monkeypatch.setattr(L, "TOKENS", 5)
    assert [end - start for start, end in L._steps(np.array([9, 3, 2, 4, 0]))] == [1, 2, 2]
    for name in ("cer_scores", "kl_scores_routed", "rank_docs"):
        logical, _ = plan(entry.queries()[name](spark, folder))
        assert "array_remove" not in logical
    assert L._text_gains(*(column[:0] for column in given)).to_pylist() == []


def test_gains_of_sentences_in_one_pass(spark, folder, monkeypatch):
    """the same for the sentences of a text, its beginning and the whole."""
    draw = random.Random(5)
    terms = [f"t{n}" for n in range(12)]
    texts = [None if n % 9 == 1 else [draw.choices(terms, k=draw.randint(0, 6)) for _ in range(n % 5)] for n in range(60)]
    model = {t: (draw.random(), draw.random() + 0.1) for t in terms[:5]}
    lists = [[list(model)] * len(texts), *([[v[i] for v in model.values()]] * len(texts) for i in (0, 1))]
    given = [pa.array(texts, pa.list_(pa.list_(pa.string()))), *map(pa.array, lists)]

    def gain(text):
        return sum(w * np.log1p(text.count(t) / mass) for t, (w, mass) in model.items())

    for size in (7, 1 << 18):
        monkeypatch.setattr(L, "TOKENS", size)
        for part in (slice(None), slice(11, 50)):
            rows = L._sentence_gains(2)(*(column[part] for column in given)).to_pylist()
            for text, row in zip(texts[part], rows, strict=True):
                text = text or []
                assert row["sentences"] == pytest.approx([gain(s) for s in text])
                assert row["text"] == pytest.approx(gain(sum(text, [])))
                assert row["top"] == pytest.approx(gain(sum(text[:2], [])))
    for name in ("sentence_dump", "sentence_scores"):
        logical, _ = plan(entry.queries()[name](spark, folder))
        assert "array_remove" not in logical and logical.count("[^.!?") == 1


def test_sentences_are_joined_without_a_step_for_each_token(spark, folder):
    """each token is followed by a blank; missing ones are left out."""
    rows = [([([("a",), ("b",)],), ([],), (None,), ([(None,), ("c",), (None,)],), ([(None,)],)],), (None,), ([],)]
    given = spark.createDataFrame(rows, "s array<struct<tokens: array<struct<token: string>>>>")
    assert [r[0] for r in given.select(T.sentence_texts(F.col("s"))).collect()] == [["a b ", "", "c ", ""], None, []]
    logical, _ = plan(Corpus(spark, folder).sentences())
    assert "array_append" in logical or "array_insert" in logical
