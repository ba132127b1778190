"""Incremental load gives what the batch job gives."""

from pyspark.sql import functions as F

from chronorank.operators.stats import collection_stats
from chronorank.plans.corpus import Corpus
from chronorank.streaming import stats as SS
from chronorank.streaming.load import load_new_items, read_new_items


def test_incremental_load(spark, folder, tmp_path):
    corpus = Corpus(spark, folder)
    items = corpus.all_items().drop("doc_id")
    arrived, table = str(tmp_path / "arrived"), str(tmp_path / "table")
    items.repartition(2).write.parquet(arrived)
    stream = read_new_items(spark, arrived, spark.read.parquet(arrived).schema, max_files=1)
    topics, bins = corpus.topics(), corpus.date_bins()
    for _ in range(2):  # the second run finds nothing new
        rejected = str(tmp_path / "rejected")
        query = load_new_items(stream, topics, corpus.stats(), bins, table, str(tmp_path / "state"), rejected)
        query.awaitTermination()
    loaded = spark.read.parquet(table)
    assert loaded.select("batch").distinct().count() == 2
    keys = ["query_id", "date_bin", "rowkey", "stream_id", "epoch_ms"]
    stored = corpus.stored()
    assert loaded.count() == stored.count()
    assert loaded.select(*keys).exceptAll(stored.select(*keys)).count() == 0
    assert loaded.filter(F.col("body").isNull()).count() == 0
    # every item that arrived is in one of both outputs
    gone = spark.read.parquet(rejected)
    assert gone.count() + loaded.count() == items.count()
    assert {r.reason for r in gone.select("reason").distinct().collect()} == {"no body"}
    assert gone.join(loaded, "stream_id").count() == 0


def test_two_loads_into_one_table(spark, folder, tmp_path):
    corpus = Corpus(spark, folder)
    items = corpus.all_items().drop("doc_id")
    parts = items.randomSplit([0.5, 0.5], 1)
    topics, bins, table = corpus.topics(), corpus.date_bins(), str(tmp_path / "table")
    for number, part in enumerate(parts):
        arrived = str(tmp_path / f"arrived-{number}")
        part.write.parquet(arrived)
        stream = read_new_items(spark, arrived, spark.read.parquet(arrived).schema)
        load_new_items(stream, topics, corpus.stats(), bins, table, str(tmp_path / f"state-{number}")).awaitTermination()
    ids = spark.read.parquet(table).select("stream_id")
    assert ids.count() == ids.distinct().count() == corpus.stored().count()


def as_dict(df):
    return {r.term: r.weight for r in df.collect()}


def test_statistics_follow_the_load(spark, folder, tmp_path):
    docs = Corpus(spark, folder).documents()
    arrived, table = str(tmp_path / "arrived"), str(tmp_path / "stats")
    docs.repartition(3).write.parquet(arrived)
    stream = read_new_items(spark, arrived, spark.read.parquet(arrived).schema, max_files=1)
    for _ in range(2):
        SS.count_new_items(stream, table, str(tmp_path / "state")).awaitTermination()
    whole = as_dict(collection_stats(docs))
    assert spark.read.parquet(f"{table}/counts").select("batch").distinct().count() == 3
    assert as_dict(SS.read_stats(spark, table)) == whole


def test_repeated_batches_and_merges_count_once(spark, tmp_path):
    table = str(tmp_path / "stats")
    parts = {
        name: spark.createDataFrame([(text,)], "clean_visible string")
        for name, text in {"a-0": "storm fire storm", "a-1": "fire hills", "b-0": "storm coast"}.items()
    }
    assert as_dict(SS.read_stats(spark, table)) == {}
    SS.count_batch(parts["a-0"], table, "a-0")
    SS.count_batch(parts["a-1"], table, "a-1")
    SS.count_batch(parts["a-1"], table, "a-1")  # the same batch again
    two = {"storm": 2.0, "fire": 2.0, "hills": 1.0}
    assert as_dict(SS.read_stats(spark, table)) == two
    SS.merge_counts(spark, table)
    assert as_dict(SS.read_stats(spark, table)) == two
    SS.count_batch(parts["b-0"], table, "b-0")
    three = {"storm": 3.0, "fire": 2.0, "hills": 1.0, "coast": 1.0}
    for _ in range(2):
        assert as_dict(SS.read_stats(spark, table)) == three
        SS.merge_counts(spark, table)
    assert as_dict(SS.read_stats(spark, table)) == three


def test_a_merge_that_fails_counts_nothing(spark, tmp_path):
    table = str(tmp_path / "stats")
    SS.count_batch(spark.createDataFrame([("storm",)], "clean_visible string"), table, "a-0")
    # sums were written, what they stand for was not
    spark.createDataFrame([("storm", 1.0)], "term string, weight double").write.parquet(f"{table}/merged/set=lost")
    assert as_dict(SS.read_stats(spark, table)) == {"storm": 1.0}
