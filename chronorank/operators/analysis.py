"""Sentence scores against human judgments.

``out``      sentence scores: docid, sentenceid, docscore, sentencescore, epoch, query_id
``matches``  judged sentences: updateid, nuggetid, query, start, end
``nuggets``  judged facts: nuggetid, query, score, epoch
``pooled``   sentences shown to the judges: updateid

All means are partial aggregates.  Scored sentences meet judgments in hash joins
with the narrow side hashed, so that they are never sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronorank.functions import ids as I


def out_frame(scores: DataFrame) -> DataFrame:
    """Analysis columns of sentence scores."""
    return scores.select(
        "query_id",
        F.col("stream_id").alias("docid"),
        F.col("sent_num").alias("sentenceid"),
        F.col("doc_score").alias("docscore"),
        F.col("sent_score").alias("sentencescore"),
        "epoch",
    )


def add_update_id(out: DataFrame) -> DataFrame:
    return out.withColumn("updateid", I.update_id("docid", "sentenceid"))


def match_scores(out: DataFrame, matches: DataFrame) -> DataFrame:
    """Scores of judged sentences."""
    return add_update_id(out).join(matches.hint("shuffle_hash"), "updateid")


def _judged(out: DataFrame, matches: DataFrame, nuggets: DataFrame) -> DataFrame:
    facts = matches.select("updateid", "nuggetid").join(nuggets.select("nuggetid", "score"), "nuggetid")
    return match_scores(out, facts.select("updateid", "score"))


def doc_vs_nugget(
    out: DataFrame, matches: DataFrame, nuggets: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Mean document score by nugget score."""
    return _judged(out, matches, nuggets).groupBy(*by, "score").agg(F.avg("docscore").alias("meandoc"))


def sent_vs_nugget(
    out: DataFrame, matches: DataFrame, nuggets: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Mean sentence score by nugget score."""
    return _judged(out, matches, nuggets).groupBy(*by, "score").agg(
        F.avg("sentencescore").alias("meansent")
    )


def _shown(out: DataFrame, skip: Sequence[int], positions: int | None) -> DataFrame:
    rows = out if positions is None else out.filter(F.col("sentenceid") < positions)
    return rows.filter(~F.col("query_id").isin(list(skip))) if skip else rows


def sentence_position(out: DataFrame, skip: Sequence[int] = (), positions: int | None = None) -> DataFrame:
    """Mean sentence score by position, per query; of the first ``positions`` if given."""
    return _shown(out, skip, positions).groupBy("query_id", "sentenceid").agg(F.avg("sentencescore").alias("mean"))


def sentence_position_nugget(
    out: DataFrame,
    matches: DataFrame,
    nuggets: DataFrame,
    skip: Sequence[int] = (),
    positions: int | None = None,
) -> DataFrame:
    """Mean nugget score by sentence position, per query; of the first ``positions`` if given."""
    return (
        _judged(_shown(out, skip, positions), matches, nuggets)
        .groupBy("query_id", "sentenceid")
        .agg(F.avg("score").alias("mean"))
    )


def doc_score_by_time(out: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean document score by epoch, and its magnitude."""
    means = out.groupBy(*by, "epoch").agg(F.avg("docscore").alias("mean"))
    return means.withColumn("magnitude", F.abs("mean"))


def nonmatch_all(out: DataFrame, matches: DataFrame) -> DataFrame:
    """Scored sentences that no judgment matches."""
    return add_update_id(out).join(matches.select("updateid").hint("shuffle_hash"), "updateid", "left_anti")


def nonmatch_pooled(out: DataFrame, matches: DataFrame, pooled: DataFrame) -> DataFrame:
    """Pooled sentences that no judgment matches."""
    shown = add_update_id(out).join(pooled.select("updateid").hint("shuffle_hash"), "updateid", "left_semi")
    return shown.join(matches.select("updateid").hint("shuffle_hash"), "updateid", "left_anti")


def nugget_epochs(out: DataFrame, matches: DataFrame, nuggets: DataFrame) -> DataFrame:
    """Judged sentences with the time of the sentence and of its nugget."""
    facts = nuggets.select("nuggetid", "query", "score", F.col("epoch").alias("nugget_epoch"))
    return match_scores(out, matches).join(facts, ["nuggetid", "query"]).select(
        "nuggetid", "query", "docid", "sentenceid", "start", "end",
        F.col("epoch").alias("sentence_epoch"), "docscore", "sentencescore", "nugget_epoch", "score",
    )


def match_vs_nonmatch(
    out: DataFrame, matches: DataFrame, pooled: DataFrame, nuggets: DataFrame
) -> DataFrame:
    """Mean scores of matches, pooled non-matches and all non-matches, in one pass over ``out``.

    A sentence counts as a match once for each of its nuggets with a score of
    0 or more.
    """
    facts = nuggets.select("nuggetid", "query", "score")
    judged = matches.select("updateid", "nuggetid", "query").join(facts, ["nuggetid", "query"], "left")
    judged = judged.groupBy("updateid").agg(
        F.sum((F.coalesce("score", F.lit(-1)) >= 0).cast("long")).alias("n_matches")
    )
    shown = pooled.select("updateid").distinct().withColumn("pooled", F.lit(True))
    rows = add_update_id(out).join(judged.hint("shuffle_hash"), "updateid", "left")
    rows = rows.join(shown.hint("shuffle_hash"), "updateid", "left")
    none = F.col("n_matches").isNull()
    weights = {
        "matches": F.coalesce("n_matches", F.lit(0)),
        "nonmatches_pooled": (none & F.coalesce("pooled", F.lit(False))).cast("long"),
        "nonmatches_all": none.cast("long"),
    }
    # a row without weight doesn't count, so a mean of no rows is null
    sums = rows.agg(
        *[
            (F.sum(F.when(w > 0, w * F.col(c))) / F.sum(F.when(w > 0, w))).alias(f"{name}_{c}")
            for name, w in weights.items()
            for c in ("docscore", "sentencescore")
        ]
    )
    named = [
        F.struct(
            F.lit(name).alias("rows"),
            F.col(f"{name}_docscore").alias("mean_doc_score"),
            F.col(f"{name}_sentencescore").alias("mean_sent_score"),
        )
        for name in weights
    ]
    return sums.select(F.inline(F.array(*named)))


def nugget_score_by_time(matches: DataFrame, nuggets: DataFrame, query: int | None = None) -> DataFrame:
    """Mean nugget score by nugget time; one query, or all when none is given."""
    keep: Column = F.col("score") >= 0
    if query is not None:
        keep = keep & (F.col("query") == query)
    judged = matches.select("query", "nuggetid").join(nuggets, ["query", "nuggetid"])
    return judged.filter(keep).groupBy("epoch").agg(F.avg("score").alias("meanscore"))
