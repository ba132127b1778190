"""Toxic passages by maximum-scoring segments of token log-odds, calibrated as extreme values."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronorank.llm.common import released
from chronorank.shared import materialize

#: Labelled documents the model is fitted on, at most; by order of a hash of the id.
FIT_ROWS = 50_000
#: Beginnings of words, from the least to the most specific, that pass their odds on.
STEMS = (3, 4, 5, 6)
#: Weight of the prior, in documents.
PRIOR = 10.0
#: Least log-odds and least z-value of an entry, and what every token costs.
LEAST_ODDS, LEAST_Z, COST = 1.0, 3.0, 0.7
#: Nats of evidence from which more makes no difference.
CERTAIN = 12.0
#: Remembered scores of words in a task.
MEMORY = 300_000

_WORD = re.compile(r"\w+")


@dataclass
class ToxicityModel:
    """Token scores, the scale of segment scores and a logistic calibration."""

    lexicon: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0
    slope: float = 1.0
    intercept: float = -2.0

    def nats(self, best: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Evidence of the best segment beyond that of the length; certain beyond ``CERTAIN``."""
        return np.minimum(self.scale * best - np.log1p(words) / 4, CERTAIN)

    def probability(self, best: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Of label 1, for the best segment's score among ``words`` tokens.

        A best segment of score S among n tokens of background text has the
        extreme-value law exp(-n exp(-scale * S)); its log is what is calibrated.
        """
        nats = self.nats(best, words)
        return 1 / (1 + np.exp(-np.clip(self.slope * nats + self.intercept, -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), of ``fit_rows`` labelled documents.

    A token's log-odds come from the shares of toxic and other documents with
    it, under a Dirichlet prior centred on the odds of its stem, that one's on
    the next shorter stem, the shortest on all tokens.  So an unseen form takes
    the odds of its stem.  The lexicon has all entries that tell something; only
    the ``fit_rows`` bound it.  Null labels are left out; of several labels of an id
    the largest counts.  Without labels of both kinds no text is toxic.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marked.agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    total = marked.count()
    if total > fit_rows:
        share = fit_rows / total
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    # at most about fit_rows rows of two numbers, whatever the input
    sample = materialize(
        docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(marked), "doc_id").select("text", "toxic"),
        "toxicity_sample",
    )
    kinds = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not kinds.get(0) or not kinds.get(1):
        return ToxicityModel(intercept=-20.0)
    entries, rate = _odds(sample)
    model = ToxicityModel({r["token"]: r["odds"] - COST for r in entries})
    model.scale = _scale(entries, kinds[0])
    best = _best_segments(sample.select("toxic", "text"), model, "toxic int").toPandas()
    _calibrate(model, best)
    return model


def _odds(sample: DataFrame):
    """Entries (token, odds, others) of the lexicon, and the share of toxic among all tokens."""
    words = materialize(
        sample.mapInPandas(_count_words, "token string, toxic long, others long")
        .groupBy("token")
        .agg(F.sum("toxic").alias("toxic"), F.sum("others").alias("others")),
        "toxic_words",
    )
    sums = words.agg(F.sum("toxic"), F.sum("others")).first()
    rate = (sums[0] or 0) / max(1, (sums[0] or 0) + (sums[1] or 0))
    base = math.log(rate / (1 - rate)) if 0 < rate < 1 else 0.0
    parents = None
    levels = []
    for length in (*STEMS, None):
        if length is None:
            level = words
        else:
            level = words.where(F.length("token") >= length).groupBy(F.substring("token", 1, length).alias("token"))
            level = level.agg(F.sum("toxic").alias("toxic"), F.sum("others").alias("others"))
        if parents is None:
            level = level.withColumn("prior", F.lit(rate)).withColumn("above", F.lit(0.0))
        else:
            up = parents.select(F.col("token").alias("up"), F.col("share").alias("prior"), F.col("odds").alias("above"))
            # a word shorter than a stem's length has no such stem
            at = F.substring("token", 1, before) if length is not None else F.substring("token", 1, STEMS[-1])
            level = level.join(up, at == F.col("up"), "left").drop("up")
            level = level.fillna({"prior": rate, "above": 0.0})
        seen = F.col("toxic") + F.col("others")
        level = level.withColumn("share", (F.col("toxic") + PRIOR * F.col("prior")) / (seen + PRIOR))
        level = level.withColumn("odds", F.log(F.col("share") / (1 - F.col("share"))) - base)
        spread = F.sqrt(
            1 / (F.col("toxic") + PRIOR * F.col("prior")) + 1 / (F.col("others") + PRIOR * (1 - F.col("prior")))
        )
        level = level.withColumn("z", F.col("odds") / spread)
        before = length
        if length is not None:
            parents = level = materialize(level, "stems")
            levels.append(level.select(F.concat("token", F.lit("*")).alias("token"), "odds", "z", "above", "others"))
        else:
            levels.append(level.select("token", "odds", "z", "above", "others"))
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    # besides toxic entries, innocent forms of toxic stems: at most the words of the bounded sample
    kept = every.where(f"(odds >= {LEAST_ODDS} and z >= {LEAST_Z}) or (odds < {LEAST_ODDS} and above >= {LEAST_ODDS})")
    # only what the model and its scale are made of comes to the driver, in an order that reruns keep
    return kept.select("token", "odds", "others").orderBy("token").collect(), rate


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in released(batches):
        toxic, others = Counter(), Counter()
        for text, label in zip(rows["text"], rows["toxic"], strict=True):
            (toxic if label else others).update(set(_WORD.findall((text or "").lower())))
        tokens = list(toxic.keys() | others.keys())
        if tokens:
            yield pd.DataFrame(
                {"token": tokens, "toxic": [toxic[t] for t in tokens], "others": [others[t] for t in tokens]}
            )


def _scale(entries, others: int) -> float:
    """The positive root of E[exp(scale * score)] = 1 over tokens of documents that aren't toxic."""
    scores = np.array([r["odds"] - COST for r in entries if not r["token"].endswith("*")] or [1.0])
    share = np.array([(r["others"] + 0.5) / (100.0 * others) for r in entries if not r["token"].endswith("*")] or [0.01])
    share *= min(1.0, 0.5 / share.sum())
    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        mean = (share * np.exp(np.clip(mid * scores, -50, 50))).sum() + (1 - share.sum()) * math.exp(-mid * COST)
        low, high = (mid, high) if mean < 1 else (low, mid)
    return max(0.2, low)


def _token_scores(model: ToxicityModel):
    """Function from a word to its score, or None where it has only its cost."""
    lexicon, memory = model.lexicon, {}
    longest_first = STEMS[::-1]

    def score(word: str) -> float | None:
        found = memory.get(word, memory)
        if found is not memory:
            return found
        found = lexicon.get(word)
        if found is None:
            for n in longest_first:
                if len(word) >= n and (found := lexicon.get(word[:n] + "*")) is not None:
                    break
        if len(memory) >= MEMORY:
            memory.clear()
        memory[word] = found
        return found

    return score


def segments(hits: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a token sequence, in linear time.

    ``hits`` are the positions and scores of the tokens that differ from -COST.
    """
    found: list[tuple[int, int, float, float]] = []  # first, end, sum before it, sum up to its end
    total, at = 0.0, 0
    for place, score in hits:
        before = total - COST * (place - at)
        total, at = before + score, place + 1
        if score <= 0:
            continue
        first, left = place, before
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= total:
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
        found.append((first, place + 1, left, total))
    return [(first, end, right - left) for first, end, left, right in found]


def _passages(text: str | None, score) -> tuple[int, list[tuple[int, int, float]]]:
    words = _WORD.findall((text or "").lower())
    hits = [(i, s) for i, s in enumerate(map(score, words)) if s is not None]
    return len(words), segments(hits) if hits else []


def _best_segments(docs: DataFrame, model: ToxicityModel, keys: str) -> DataFrame:
    names = [k.split()[0] for k in keys.split(", ")]

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = _token_scores(model)
        for rows in released(batches):
            found = [_passages(text, score) for text in rows["text"]]
            out = rows[names].copy()
            out["best"] = [max((s for *_, s in p), default=0.0) for _, p in found]
            out["words"] = [float(n) for n, _ in found]
            yield out

    return docs.mapInPandas(best, f"{keys}, best double, words double")


def _calibrate(model: ToxicityModel, rows: pd.DataFrame) -> None:
    """Slope and intercept by penalised logistic regression: Newton steps, halved until they descend."""
    x = model.nats(rows["best"].to_numpy(), rows["words"].to_numpy())
    x = np.stack([x, np.ones(len(x))], axis=1)
    y = rows["toxic"].to_numpy(float)
    start, pull = np.array([1.0, -2.0]), np.array([1.0, 0.05])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (pull * (w - start) ** 2).sum() / 2)

    weights = start.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        down = x.T @ (p - y) + pull * (weights - start)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(pull), down)
        now, size = loss(weights), 1.0
        while size > 1e-6 and loss(weights - size * step) > now:
            size /= 2
        weights = weights - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    model.slope, model.intercept = float(max(0.05, weights[0])), float(weights[1])


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (probability of label 1) and passages of every row of ``docs`` (doc_id, text).

    ``passages`` are (first word, end, score, chance): all maximal segments whose
    chance of a better one in background text of that length is below 1 %.
    Texts that are null or without words have none, and the score of no evidence.
    """
    kind = "doc_id long, score double, passages array<struct<first:int,end:int,score:double,chance:double>>"

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = _token_scores(model)
        for rows in released(batches):
            found = [_passages(text, score) for text in rows["text"]]
            words = np.array([float(n) for n, _ in found])
            best = np.array([max((s for *_, s in p), default=0.0) for _, p in found])
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"],
                    "score": model.probability(best, words),
                    "passages": [
                        [
                            {"first": a, "end": b, "score": s, "chance": chance}
                            for a, b, s in p
                            if (chance := -math.expm1(-n * math.exp(-model.scale * s))) < 0.01
                        ]
                        for n, p in found
                    ],
                }
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(rate, kind)
