"""The registered queries of the operators, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronorank.llm import exact_dedup, pieces
from chronorank.llm.conversations import repair_conversations
from chronorank.llm.extraction import extract_text
from chronorank.llm.fingerprints import compare_with_next
from chronorank.llm.licenses import scan_licenses
from chronorank.llm.mixing import MIX_SQL, in_order, mix
from chronorank.llm.near_dup import near_duplicates
from chronorank.llm.quality import judge_quality
from chronorank.llm.toxicity import fit_toxicity, score_toxicity
from chronorank.llm.urls import URLS_SQL, judge_urls
from chronorank.llm.vectors import VECTORS_SQL, near_vectors
from chronorank.llm.whitening import whiten


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses."""
    return compare_with_next(_table(spark, folder, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents that share 85 % of their three-word shingles."""
    return near_duplicates(_table(spark, folder, "documents"))


def op3_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """What a mix of all documents takes of each, in the order of the mix."""
    return in_order(mix(_table(spark, folder, "documents")))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Perplexity of every document under the model of trusted text, and what that rejects."""
    return judge_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are for testing only."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that aren't held out."""
    docs = _table(spark, folder, "documents")
    model = fit_toxicity(docs, _table(spark, folder, "labels").where(~held_out()))
    return score_toxicity(docs, model).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )


def op6_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's url."""
    return judge_urls(_table(spark, folder, "pages"))


def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = extract_text(_table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "lines", "shared")


def op8_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of vectors of equal label with a cosine of 0.93 or more."""
    return near_vectors(_table(spark, folder, "embeddings"))


def op9_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices in every document."""
    found = scan_licenses(_table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda m: m["license"]), ",").alias("licenses"),
        F.array_max(F.transform("licenses", lambda m: m["containment"])).alias("best_containment"),
    )


TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every document, and whether they decode to its text."""
    model = pieces.read_model(spark, TOKENIZER)
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    both = pieces.encode(docs, model, decoded="decoded")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.BLANK), F.lit(" "))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == text).alias("round_trip"),
    )


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Eight whitened components of every vector."""
    return whiten(_table(spark, folder, "embeddings"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Cheapest repair of every conversation, after damage."""
    return repair_conversations(_table(spark, folder, "conversations"))


def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents with the same text but for white space."""
    return exact_dedup.exact_duplicates(_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_source_mixing": op3_source_mixing,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_toxicity": op5_toxicity,
        "op6_url_filters": op6_url_filters,
        "op7_html_extraction": op7_html_extraction,
        "op8_embedding_near_dedup": op8_embedding_near_dedup,
        "op9_license_scans": op9_license_scans,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_exact_dedup": op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_source_mixing": MIX_SQL,
        "op6_url_filters": URLS_SQL,
        "op8_embedding_near_dedup": VECTORS_SQL,
        "op13_exact_dedup": exact_dedup.SQL,
    }
