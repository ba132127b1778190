"""Export records and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronorank.functions import ids as I
from chronorank.functions import text as T
from chronorank.operators.sentences import TAGGER


def numbered_sentences(sentences: Column) -> Column:
    """Lines ``n sentence``; empty without sentences."""
    lines = F.transform(
        T.sentence_texts(sentences),
        lambda s, i: F.concat(i.cast("string"), F.lit(" "), s, F.lit("\n")),
    )
    return F.coalesce(F.array_join(lines, ""), F.lit(""))


def trec_records(items: DataFrame, tagger: str = TAGGER) -> DataFrame:
    """``(stream_id, hourdaydir, record)``: each item as a tagged text document.

    Items without visible text have been dropped by the caller's filter or are
    dropped here; other missing values become empty strings or 0.
    """
    zulu = F.coalesce("stream_time.zulu_timestamp", F.lit(""))
    epoch = F.coalesce(T.zulu_to_epoch_ms("stream_time.zulu_timestamp"), F.lit(0))
    url = F.coalesce(F.decode("abs_url", "UTF-8"), F.lit(""))

    def tag(name: str, value: Column) -> list[Column]:
        return [F.lit(f"<{name}>"), value, F.lit(f"</{name}>\n")]

    stream_id = F.coalesce("stream_id", F.lit(""))
    day = F.coalesce("hour", F.lit(""))
    parts = [
        F.lit("<DOC>\n"),
        *tag("DOCNO", stream_id),
        *tag("SOURCE", F.coalesce("source", F.lit(""))),
        *tag("URL", url),
        *tag("DATETIME", zulu),
        *tag("HOURDAYDIR", day),
        *tag("EPOCH", epoch.cast("string")),
        F.lit("<TEXT>\n"),
        numbered_sentences(F.col("body.sentences")[tagger]),
        F.lit("\n</TEXT>\n</DOC>\n"),
    ]
    return items.filter(F.col("body.clean_visible").isNotNull()).select(
        stream_id.alias("stream_id"), day.alias("hourdaydir"), F.concat(*parts).alias("record")
    )


def id_shards(ids: DataFrame) -> DataFrame:
    """Storage path of each stream id, and the id read back from the path."""
    path = I.shard_path("stream_id")
    return ids.select("stream_id", path.alias("path")).withColumn("bare_id", I.path_to_id(F.col("path")))
