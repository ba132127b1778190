"""Training-data pipeline over ``documents``: stages, and a run of all of them.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given.  Null
and blank texts pass all filters and end at the mix, which takes no words of
them.  Rows with a null id are judged like others, but only an id can be
rejected or marked a duplicate, so they stay.  Rows of one id are one document:
they stay or go together.  Columns beyond those of ``documents`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronorank.llm import pieces
from chronorank.llm.common import small_side
from chronorank.llm.mixing import mix, word_count
from chronorank.llm.near_dup import near_duplicates
from chronorank.llm.quality import judge_quality
from chronorank.llm.toxicity import fit_toxicity, score_toxicity
from chronorank.shared import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Probability of label 1 from which a document is rejected as toxic.
TOXIC = 0.3
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    gone = materialize(gone.select("doc_id").where("doc_id is not null").distinct(), name)
    return docs.join(small_side(gone), "doc_id", "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity the thresholds of their languages reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, judge_quality(docs, labels).where("rejected"), "poor")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxic passage go; the model is learnt from all labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = score_toxicity(docs, fit_toxicity(docs, labels))
    return _without(docs, scores.where(F.col("score") >= TOXIC), "toxic")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group stays: five-word shingles, similarity 0.8."""
    return _without(docs, near_duplicates(docs, k=5, percent=80).where("not kept"), "duplicates")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole documents, at least one of each it takes words of.

    Sources weigh 5, 2, 1 by name, and take 150 % of all words with at most two
    passes.  Rows of the same id, source and size are taken alike, null ids included.
    """
    times = F.greatest(F.lit(1), F.round(F.col("taken") / F.col("size")).cast("int"))
    keys = ["doc_id", "source", "size"]
    copies = mix(docs).where("taken > 0").groupBy(*keys).agg(F.max(times).alias("n"))
    copies = materialize(copies.select(*(F.col(c).alias(f"taken_{c}") for c in keys), "n"), "copies")
    rows = docs.select(*COLUMNS, word_count(F.col("text")).alias("size"))
    same = [F.col(c).eqNullSafe(F.col(f"taken_{c}")) for c in keys]
    rows = rows.join(small_side(copies), same[0] & same[1] & same[2])
    return rows.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of every document, and whether decoding them gives its text back."""
    model = pieces.read_model(spark, TOKENIZER)
    both = pieces.encode(docs.select(*COLUMNS), model, decoded="decoded")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.BLANK), F.lit(" "))
    return both.select(
        "doc_id", "lang", "source", "ids", F.size("ids").alias("n_ids"), (F.col("decoded") == text).alias("round_trip")
    )


STAGES = [
    ("quality_classifier", quality),
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_dedup),
    ("source_mixing", mixing),
    ("sentencepiece", tokens),
]

#: A language model, a segment search and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; every stage's result is a written table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
