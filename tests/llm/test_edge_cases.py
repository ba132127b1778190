"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import pytest

from chronorank.llm import (
    extraction,
    fingerprints,
    licenses,
    mixing,
    near_dup,
    pieces,
    quality,
    toxicity,
    urls,
    vectors,
)

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG = "lorem ipsum dolor sit amet " * 20_000
DOCS = [
    (1, "a b c d e f g", "en", "s1"),
    (2, "a b c d e f g", "en", "s1"),
    (2, "a b c d e f g", "en", "s1"),
    (3, None, None, None),
    (4, "", "en", "s2"),
    (5, " \t\n", None, "s2"),
    (6, LONG, "de", None),
    (7, "one", "en", "s1"),
    (None, "no id here at all", "en", "s3"),
    (None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    kind = "doc_id long, text string, lang string, source string"
    return spark.createDataFrame(DOCS, kind)


@pytest.fixture(scope="module")
def crowded(docs):
    """With extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = "id component n u v key meet part block anchors next_text edited slice turn target finish size words best"
    return docs.withColumns({name: F.lit("x") for name in [*names.split(), "kept", "score", "signature", "packed"]})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (3, 1, 0), (6, 1, 0), (7, 0, 1), (7, 0, 1), (None, 1, 1), (4, None, None), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def run_near(d, labels):
    return near_dup.near_duplicates(d)


def run_mix(d, labels):
    return mixing.mix(d)


def run_quality(d, labels):
    return quality.judge_quality(d, labels)


def run_toxicity(d, labels):
    return toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels))


def run_fingerprints(d, labels):
    return fingerprints.compare_with_next(d)


def run_licenses(d, labels):
    return licenses.scan_licenses(d)


RUNS = [run_near, run_mix, run_quality, run_toxicity, run_fingerprints, run_licenses]


@pytest.mark.parametrize("run", RUNS)
def test_documents(run, docs, crowded, labels):
    plain, extra = run(docs, labels), run(crowded, labels)
    assert plain.columns == extra.columns
    found = rows_of(plain)
    assert found == rows_of(extra)
    assert len(found) == len(DOCS)
    empty = docs.limit(0)
    assert run(empty, labels.limit(0)).collect() == []
    assert run(empty, labels).collect() == []


def test_without_labels_all_stays(docs, labels):
    assert not quality.judge_quality(docs, labels.limit(0)).where("rejected").count()
    scores = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels.limit(0)))
    assert scores.where("score >= 0.3").count() == 0


def test_near_duplicate_edges(docs):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    assert got[(1, 5)] == (1, True) and got[(2, 5)] == (1, False)
    assert got[(3, 0)] == (3, True) and got[(4, 0)] == (4, True) and got[(5, 0)] == (5, True)
    assert got[(7, 1)] == (7, True) and got[(None, 3)] == (None, True)


def test_pieces_edges(spark, docs):
    model = pieces.read_model(spark, MODEL)
    named = docs.withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    got = pieces.decode(pieces.encode(named, model), model)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    assert all(r.decoded == (r.text or "") for r in got.collect())
    assert rows_of(pieces.encode(named, model, decoded="decoded")) == rows_of(got)
    assert pieces.encode(docs.limit(0), model).collect() == []


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1),
        (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 1),
        (11, [1.0, 0.0], 2), (None, [1.0, 0.0], 2), (12, [0.0, 1.0], 1), (13, [1e30, 0.0], 2),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    extra = table.selectExpr("*", "1 as id", "2 as component", "3 as links", "4 as times", "5 as sound")
    want = {
        1: (2, 1, True), 2: (2, 1, False), 11: (2, 11, True), None: (2, 11, False), 13: (2, 11, False),
    }
    for t in (table, extra):
        for r in vectors.near_vectors(t).collect():
            assert (r.n_links, r.component_id, r.kept) == want.get(r.vec_id, (0, r.vec_id, True)), r
    assert vectors.near_vectors(table.limit(0)).collect() == []


def test_vectors_of_doubles(spark):
    tiny, angle = 5e-324, 0.93
    rows = [
        (1, [1e300, 0.0], 1), (2, [1e300, 0.0], 1), (3, [1.7e308, 1.7e308], 2), (4, [1e-300, 1e-300], 2), (5, [tiny, tiny], 2),
        (6, [1.0, 0.0], 3), (7, [angle - 1e-12, (1 - (angle - 1e-12) ** 2) ** 0.5], 3),
        (8, [angle + 1e-12, -((1 - (angle + 1e-12) ** 2) ** 0.5)], 3),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(table).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (1, 6), 7: (0, 7), 8: (1, 6)}


def test_page_edges(spark):
    page = "<html><body><nav><a>menu</a></nav><article><h1>Head</h1><p>One &amp;\n two<br>three</article></body></html>"
    rows = [
        (1, "http://a.org/x/1", page), (2, "http://a.org/x/2", page), (2, "http://a.org/x/2", page), (3, None, page),
        (4, "no scheme", None), (None, "HTTP://B.Com?q", "<p>open</p>"), (5, "x://c.com", "a < b <c"), (6, "x://c.com/#", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    extra = pages.selectExpr("*", "1 as host", "2 as path", "3 as place", "4 as template", "5 as lines", "6 as rule", "7 as l")
    for t in (pages, extra):
        got = {(r.page_id, r.url): r.text for r in extraction.extract_text(t).collect()}
        assert got[(1, "http://a.org/x/1")] == got[(2, "http://a.org/x/2")] == "Head\nOne & two three"
        assert got[(3, None)] == "Head\nOne & two three" and got[(4, "no scheme")] == ""
        assert got[(None, "HTTP://B.Com?q")] == "open" and got[(6, "x://c.com/#")] == ""
        judged = urls.judge_urls(t).collect()
        assert len(judged) == len(rows)
        by_id = {r.page_id: r for r in judged}
        assert (by_id[1].host, by_id[1].path, by_id[1].rule, by_id[1].verdict) == ("a.org", "/x/1", "org/", "allow")
        assert (by_id[3].host, by_id[3].path, by_id[3].rule) == ("", "", None)
        assert (by_id[None].host, by_id[None].path) == ("b.com", "")
    assert extraction.extract_text(pages.limit(0)).collect() == []
    assert urls.judge_urls(pages.limit(0)).collect() == []
