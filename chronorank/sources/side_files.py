"""Small side files: topics, vocabulary, stoplist, hours, ids, score files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronorank.functions import text as T
from chronorank.operators.stats import CollectionStats

# Fixed value: vocabulary row that holds the number of tokens.
TOTAL_TERM = "TOTAL"
#: Bytes of a stoplist that is sent to every task, at most, and terms of a bucket, about.
STOP_BYTES, BUCKET_TERMS = 64 * 1024 * 1024, 4


def read_topics(spark: SparkSession, path: str, stop: T.Stop = ()) -> DataFrame:
    """``(query_id, query)`` from ``<event><id/><query/></event>`` elements.

    The last element of an id wins.  Stopwords, if given, leave the query text.
    """
    events = (
        spark.read.format("xml").option("rowTag", "event").schema("id int, query string").load(path)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    topics = events.groupBy(F.coalesce("id", F.lit(-1)).alias("query_id")).agg(
        F.coalesce(F.max_by("query", "_at"), F.lit("")).alias("query")
    )
    if T.stops(stop):
        topics = topics.withColumn("query", F.array_join(T.words("query", stop), " "))
    return topics


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """Fields of blank-separated lines, as written; no quoting."""
    return spark.read.text(path).select(F.split("value", " ").alias("f"))


def read_vocab(spark: SparkSession, path: str) -> CollectionStats:
    """``term tf [df]`` lines, one of which is the total."""
    rows = _fields(spark, path).select(F.col("f")[0].alias("term"), F.col("f")[1].cast("double").alias("cf"))
    total = rows.filter(F.col("term") == TOTAL_TERM).agg(F.max("cf").alias("total"))
    return CollectionStats(rows.filter(F.col("term") != TOTAL_TERM), total.scalar())


def read_stoplist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("term"))


def stop_terms(stoplist: DataFrame) -> list[str]:
    """Distinct terms of a short stoplist file, as literals for column expressions."""
    rows = stoplist.select("term").where(F.col("term") != "").distinct().collect()
    return sorted(row["term"] for row in rows)


def without_stopwords(
    rows: DataFrame, stoplist: DataFrame, text: str = "clean_visible", max_bytes: int = STOP_BYTES
) -> DataFrame:
    """``rows`` whose ``text`` holds its words alone, lower-case, minus those of a stoplist of any length.

    Operators that tokenize ``text`` then need no stopwords.  Terms are dealt into
    buckets by a hash, so that a word is looked up among a few.  The buckets are
    one value that Spark computes when the query runs and sends to its tasks;
    rows neither move nor meet a join.  A null text stays null.  A list of more
    than ``max_bytes`` is refused: by a semi-join keep those of its terms that
    occur in the vocabulary.
    """
    terms = stoplist.select("term").where(F.col("term") != "").distinct()
    size = terms.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    if size["bytes"] > max_bytes:
        raise ValueError(f"stoplist of {size['bytes']} bytes; keep those of its terms that occur in the vocabulary")
    count = max(1, size["n"] // BUCKET_TERMS)

    def bucket(term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(count)).cast("int")

    filled = terms.groupBy(bucket(F.col("term")).alias("at")).agg(F.collect_list("term").alias("terms"))
    every = stoplist.sparkSession.range(count).select(F.col("id").cast("int").alias("at"))
    every = every.join(filled, "at", "left").select("at", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    dealt = every.agg(F.sort_array(F.collect_list(F.struct("at", "terms"))).alias("dealt"))
    buckets = dealt.select(F.col("dealt.terms")).scalar()
    left = F.filter(T.words(text), lambda t: ~F.array_contains(F.get(F.col("_stop"), bucket(t)), t))
    return rows.withColumn("_stop", buckets).withColumn(text, F.array_join(left, " ")).select(*rows.columns)


def read_date_bins(spark: SparkSession, path: str) -> DataFrame:
    """``(hour, bin)`` from ``yyyy-MM-dd-HH bin`` lines."""
    return _fields(spark, path).select(F.col("f")[0].alias("hour"), F.col("f")[1].cast("int").alias("bin"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("stream_id"))


def read_scored(
    spark: SparkSession, paths: Sequence[str], schema: str, skip: Sequence[int] = ()
) -> DataFrame:
    """Headerless tab-separated score files named ``*.<query>``, quotes kept."""
    rows = (
        spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", False)
        .csv(list(paths))
        .withColumn("query_id", F.regexp_extract(F.input_file_name(), r"\.(\d+)(?:/[^/]*)?$", 1).cast("int"))
    )
    return rows.filter(~F.col("query_id").isin(list(skip))) if skip else rows
