"""The pipeline's stages: columns, decisions and agreement with their operators."""

import corpus_pipeline
from chronorank.llm import queries


def test_stages_keep_columns_and_act(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        if name in ("quality_classifier", "toxicity", "minhash_near_dedup"):
            before = {r.doc_id for r in docs.select("doc_id").collect()}
            assert {r.doc_id for r in after.select("doc_id").collect()} < before
        sizes.append(after.count())
        docs = after
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] < sizes[2]
    assert docs.where("not round_trip").count() == 0


def test_registered():
    assert [f"op{n}" for n in range(1, 14)] == [name.split("_")[0] for name in queries.queries()]
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_sql(spark, folder):
    import compare

    con = compare.connect(folder)
    for name, sql in queries.oracle_sql().items():
        assert compare.compare(spark, con, folder, name, queries.queries()[name], sql)[1] == ""


def test_mix_keeps_rows_without_ids_apart_and_single_long_documents(spark):
    rows = [(None, "one two three", "en", "a", 0), (None, None, "en", "a", 0), (None, " ", "en", "a", 0)]
    rows += [(1, "word " * 900, "en", "b", 0), (2, "x y", "en", None, 0)] + [(10 + i, "w " * 40, "en", "a", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mixing(spark, docs, "").collect()
    # blank rows have no words to take, and a row isn't taken for another one
    assert all((r.text or "").strip() for r in mixed)
    assert 1 <= sum(r.doc_id is None for r in mixed) <= 2
    assert 1 <= sum(r.doc_id == 1 for r in mixed) <= 2
    assert corpus_pipeline.mixing(spark, docs.limit(0), "").collect() == []


def test_stages_on_nulls_blanks_repeats_and_clashing_columns(spark, tmp_path):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (5, " \t\n"), (7, "one")]
    rows += [(6, " ".join(f"word{n % 9_000}" for n in range(100_000))), (None, "no id here at all"), (None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    plain = spark.createDataFrame([(i, t, None if i == 3 else "en", "s" if i != 5 else None, 0) for i, t in rows], kind)
    labels = [(1, 1, 0), (2, 1, 0), (6, 1, 0), (7, 0, 1), (7, 0, 1), (None, 1, 1), (4, None, None), (99, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    crowded = plain.selectExpr("*", "1 AS ids", "2 AS size", "3 AS taken", "4 AS n", "5 AS component", "6 AS score", "7 AS decoded")
    ends = []
    for docs in (plain, crowded):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
            left = {r.doc_id for r in docs.select("doc_id").collect()}
            if name in ("quality_classifier", "toxicity"):
                assert left >= {1, 2, 3, 4, 5, 6, None}
            elif name == "minhash_near_dedup":
                # one of the copies stays; null and blank texts are no copies of one another
                assert left >= {1, 3, 4, 5, 6, None} and 2 not in left
            elif name == "source_mixing":
                assert {1, 6} <= left and not left & {3, 4, 5}
        ends.append(sorted((repr(r) for r in docs.collect())))
        assert docs.where("not round_trip").count() == 0
    assert ends[0] == ends[1]
    empty = plain.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []
