"""Text quality by perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronorank.llm.common import released, small_side
from chronorank.shared import materialize

#: Characters of an n-gram; each one takes 16 bits of a 64-bit key.
ORDER = 4
#: Documents that are scored together against the n-grams they ask for.
BLOCK_DOCS = 5_000
#: Characters whose n-grams a task sorts at once.
STEP = 2_000_000
#: A document's mean is drawn to that of its language with the weight of so many characters.
STEADY = 80.0
#: Quantiles of trusted and of rejected documents that a threshold lies between.
TRUSTED_QUANTILE, REJECTED_QUANTILE = 0.999, 0.05


def character_grams(text: str | None, order: int = ORDER) -> np.ndarray:
    """Keys of all runs of ``order`` characters of the whole text, in order."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    codes = (codes ^ (codes >> np.uint64(16))) & np.uint64(0xFFFF)
    size = max(0, len(codes) - order + 1)
    keys = np.zeros(size, np.uint64)
    for i in range(order):
        keys = (keys << np.uint64(16)) | codes[i : i + size]
    return keys.view(np.int64)


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for rows in released(batches):
        for text in rows["text"]:
            held.append(character_grams(text))
            size += len(held[-1])
            if size >= STEP:
                yield _counted(held)
                held, size = [], 0
    if held:
        yield _counted(held)


def _counted(held: list[np.ndarray]) -> pd.DataFrame:
    keys, counts = np.unique(np.concatenate(held), return_counts=True)
    return pd.DataFrame({"key": keys, "count": counts})


def _history(key: Column) -> Column:
    return F.shiftrightunsigned(key, 16)


def _shorter(key: str, order: int) -> Column:
    """The last ``order`` characters of a longer n-gram."""
    return F.col(key).bitwiseAND(F.lit((1 << (16 * order)) - 1))


class KneserNey:
    """Tables of a character model: ``grams[n]`` (key, logp) and ``backoff[n]`` (key, logb), n from 1 to ORDER.

    ``backoff[n]`` has the weight left to shorter histories after each history
    of n characters; ``unseen`` is the log-probability of a new character.
    """

    def __init__(self, texts: DataFrame) -> None:
        counted = texts.mapInPandas(_count_grams, "key long, count long")
        tables = {
            ORDER: materialize(counted.groupBy("key").agg(F.sum("count").alias("a")), "grams"),
        }
        for n in range(ORDER - 1, 0, -1):
            # in how many ways a shorter n-gram continues something
            shorter = tables[n + 1].groupBy(_shorter("key", n).alias("key")).agg(F.count("*").alias("a"))
            tables[n] = materialize(shorter, "grams")
        self.grams: dict[int, DataFrame] = {}
        self.backoff: dict[int, DataFrame] = {}
        self.unseen = float(np.log(1e-6))
        for n in range(1, ORDER + 1):
            self._estimate(n, tables[n])

    def _estimate(self, n: int, table: DataFrame) -> None:
        of = [F.coalesce(F.sum((F.col("a") == i).cast("long")), F.lit(0)).alias(f"n{i}") for i in (1, 2, 3, 4)]
        seen = table.agg(F.count("*").alias("types"), F.coalesce(F.sum("a"), F.lit(0)).alias("all"), *of).first()
        d1, d2, d3 = discounts(seen["n1"], seen["n2"], seen["n3"], seen["n4"])
        a = F.col("a")
        cut = F.when(a == 1, d1).when(a == 2, d2).otherwise(d3)
        if n == 1:
            left = table.agg(F.sum(cut)).first()[0] or 0.0
            share = left / max(1, seen["all"]) / (seen["types"] + 1)
            if seen["types"]:
                self.unseen = float(np.log(max(share, 1e-9)))
            self.grams[1] = table.select("key", F.log((a - cut) / max(1, seen["all"]) + share).alias("logp"))
            return
        after = table.groupBy(_history(F.col("key")).alias("history")).agg(F.sum("a").alias("all"), F.sum(cut).alias("left"))
        after = materialize(after, "histories")
        self.backoff[n - 1] = after.select(F.col("history").alias("key"), F.log(F.col("left") / F.col("all")).alias("logb"))
        lower = self.grams[n - 1].select(F.col("key").alias("short"), F.col("logp").alias("lower"))
        joined = table.withColumn("history", _history(F.col("key"))).withColumn("short", _shorter("key", n - 1))
        joined = joined.join(after, "history").join(lower, "short", "left")
        p = (a - cut) / F.col("all") + F.col("left") / F.col("all") * F.exp(F.coalesce("lower", F.lit(self.unseen)))
        self.grams[n] = materialize(joined.select("key", F.log(p).alias("logp")), "model")

    def log_probabilities(self, keys: DataFrame) -> DataFrame:
        """(key, logp) of distinct n-grams of full order, given all but their last character."""
        out = keys.select("key")
        for n in range(ORDER, 0, -1):
            found = self.grams[n].select(F.col("key").alias(f"k{n}"), F.col("logp").alias(f"p{n}"))
            out = out.join(found, _shorter("key", n) == F.col(f"k{n}") if n < ORDER else F.col("key") == F.col(f"k{n}"), "left")
            if n > 1:
                left = self.backoff[n - 1].select(F.col("key").alias(f"h{n}"), F.col("logb").alias(f"b{n}"))
                history = _history(F.col("key")) if n == ORDER else _history(_shorter("key", n))
                out = out.join(left, history == F.col(f"h{n}"), "left")
        logp = F.coalesce("p1", F.lit(self.unseen))
        for n in range(2, ORDER + 1):
            logp = F.coalesce(F.col(f"p{n}"), F.coalesce(f"b{n}", F.lit(0.0)) + logp)
        return out.select("key", logp.alias("logp"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more; 0.5, 1, 1.5 where counts of counts are missing."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.1), i + 0.9) for i, d in enumerate(raw))


def perplexities(docs: DataFrame, model: KneserNey, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, lang, nats, grams of every row of ``docs`` (doc_id, text, lang): summed surprise of its n-grams, their number.

    Documents come in blocks of near ids.  A block asks once for each of its
    n-grams; the sharded tables of the model answer, each different n-gram once
    for all blocks, and the answers meet the block's texts.  So neither the
    model nor the n-grams of a document are ever in one place.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    rows = docs.count()
    steps = max(1, -(-rows // block_docs))
    cuts = None
    if steps > 1:
        places = [i / steps for i in range(1, steps)]
        cuts = docs.agg(F.percentile_approx("doc_id", places, 10 * max(1000, steps))).first()[0]
    block = F.lit(0)
    if cuts:
        edges = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))])
        block = F.size(F.filter(edges, lambda c: c < F.coalesce("doc_id", F.lit(0))))
    docs = docs.withColumn("block", block.cast("int"))
    asked = docs.select("block", "text").mapInPandas(_asked, "block int, key long").distinct()
    asked = materialize(asked, "asked")
    known = materialize(model.log_probabilities(asked.select("key").distinct()), "answers")
    answers = asked.join(known, "key").select("block", "key", F.col("logp").cast("float").alias("logp"))
    # texts of a few kilobytes compress better one by one than the shuffle does it
    packed = docs.mapInPandas(_pack, "block int, doc_id long, lang string, packed binary")
    return (
        packed.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInPandas(_sum_block, "doc_id long, lang string, nats double, grams long")
    )


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for rows in released(batches):
        rows["packed"] = [pack((text or "").encode("utf-8", "replace")) for text in rows["text"]]
        yield rows.astype({"doc_id": "Int64"})[["block", "doc_id", "lang", "packed"]]


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Different n-grams of each block, of up to ``STEP`` characters at a time."""

    def different(block: int, held: list[np.ndarray]) -> pd.DataFrame:
        keys = np.unique(np.concatenate(held))
        return pd.DataFrame({"block": np.full(len(keys), block, np.int32), "key": keys})

    for rows in released(batches):
        for block, texts in rows.groupby("block", sort=False)["text"]:
            held, size = [], 0
            for text in texts:
                held.append(np.unique(character_grams(text)))
                size += len(held[-1])
                if size >= STEP:
                    yield different(block, held)
                    held, size = [], 0
            if held:
                yield different(block, held)


def _sum_block(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    order = np.argsort(answers["key"].to_numpy())
    keys = answers["key"].to_numpy()[order]
    logp = answers["logp"].to_numpy()[order].astype(np.float64)
    nats, sizes = [], []
    unpack = zstandard.ZstdDecompressor().decompress
    for packed in docs["packed"]:
        own = character_grams(unpack(packed).decode())
        nats.append(-float(logp[np.searchsorted(keys, own)].sum()) if len(own) else 0.0)
        sizes.append(len(own))
    return pd.DataFrame({"doc_id": docs["doc_id"], "lang": docs["lang"], "nats": nats, "grams": sizes})


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity, threshold, rejected of every row of ``docs`` (doc_id, text, lang).

    The model counts the n-grams of all documents that ``labels`` (doc_id,
    quality) trusts.  A document's mean surprise, drawn to the mean of trusted
    ones of its language by ``STEADY`` characters so that short texts aren't
    judged by chance, gives its perplexity.  The threshold of a language lies
    between a high quantile of its trusted documents and a low one of those
    marked 0; with labels of one kind only, at the former, and for a language
    without labels at that of all.  A null language is one of its own.

    Texts that are null or shorter than an n-gram have the mean perplexity and
    stay; so does all without trusted text.  Null ids are judged but not
    trusted.  Repeated ids are one document for the labels.
    """
    labels = labels.where("doc_id is not null and quality is not null")
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    labels = materialize(labels, "quality_labels")
    trusted = labels.where("quality > 0").select("doc_id")
    docs = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    model = KneserNey(docs.join(small_side(trusted), "doc_id", "left_semi").select("text"))
    scored = materialize(perplexities(docs, model), "surprise")
    return _against_thresholds(scored, labels)


def _against_thresholds(scored: DataFrame, labels: DataFrame) -> DataFrame:
    known = materialize(
        scored.join(small_side(labels), "doc_id").where("grams > 0").select("lang", "quality", "nats", "grams"), "known"
    )
    of_all = known.where("quality > 0").agg((F.sum("nats") / F.sum("grams")).alias("mean")).first()["mean"]
    means = known.where("quality > 0").groupBy("lang").agg((F.sum("nats") / F.sum("grams")).alias("mean"))
    # one row for each language
    means = F.broadcast(materialize(means, "means"))

    def steady(df: DataFrame) -> DataFrame:
        of = means.select(F.col("lang").alias("of"), "mean")
        df = df.join(of, df["lang"].eqNullSafe(of["of"]), "left").drop("of")
        mean = F.coalesce("mean", F.lit(of_all), F.lit(0.0))
        return df.withColumn("mean_nats", (F.col("nats") + STEADY * mean) / (F.col("grams") + STEADY)).drop("mean")

    def quantiles(df: DataFrame, *by: str) -> DataFrame:
        good = F.when(F.col("quality") > 0, F.col("mean_nats"))
        poor = F.when(F.col("quality") <= 0, F.col("mean_nats"))
        return df.groupBy(*by).agg(
            F.percentile_approx(good, TRUSTED_QUANTILE, 10_000).alias("high"),
            F.percentile_approx(poor, REJECTED_QUANTILE, 10_000).alias("low"),
        )

    measured = materialize(steady(known), "measured")
    cut = F.when(F.col("low") > F.col("high"), (F.col("low") + F.col("high")) / 2).otherwise(F.col("high"))
    general = quantiles(measured).select(cut.alias("cut")).first()["cut"]
    cuts = quantiles(measured, "lang").select(F.col("lang").alias("of"), cut.alias("cut"))
    cuts = F.broadcast(materialize(cuts, "thresholds"))
    out = steady(scored)
    out = out.join(cuts, out["lang"].eqNullSafe(cuts["of"]), "left")
    threshold = F.coalesce("cut", F.lit(general).cast("double"))
    return out.select(
        "doc_id",
        "lang",
        F.exp("mean_nats").alias("perplexity"),
        F.exp(threshold).alias("threshold"),
        F.coalesce((F.col("grams") > 0) & (F.col("mean_nats") > threshold), F.lit(False)).alias("rejected"),
    )
