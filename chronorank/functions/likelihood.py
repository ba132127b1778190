"""Dirichlet-smoothed likelihoods over token arrays.

A query model is one struct per query:

``terms``    its distinct terms
``weights``  term -> struct<w, mass>, with ``mass = mu * collection probability``
``w_sum``    sum of the weights
``at_0``     sum of ``w * ln(mass)``, likewise ``at_1`` and ``at_10`` with 1 and 10
             added to the mass
``log_cp``   sum of ``w * ln(collection probability)``
``top_mass`` largest mass

With it, scoring a text against its own query is a projection: the part without
matches is a closed form of the text's length, and what the terms that do occur
add is summed by an Arrow expression that passes over the tokens once.  Built-in
functions would pass over them once more for every term.  No term rows, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Smoothing mass, and the term frequency of the practical bound.
MU = 2500.0
PRACTICAL_TF = 10.0

#: Tokens that a task looks up at a time, but for a text that has more.
TOKENS = 1 << 18


def model_struct(mu: float = MU) -> Column:
    """Aggregate of a query's rows ``(term, w, cp)`` into its model."""
    w, cp = F.col("w"), F.col("cp")
    mass = mu * cp
    entries = F.array_sort(F.collect_list(F.struct("term", w.alias("w"), mass.alias("mass"))))
    return F.struct(
        entries["term"].alias("terms"),
        F.map_from_entries(
            F.transform(
                entries,
                lambda e: F.struct(e["term"].alias("k"), F.struct(e["w"].alias("w"), e["mass"].alias("mass")).alias("v")),
            )
        ).alias("weights"),
        F.sum(w).alias("w_sum"),
        F.sum(w * F.log(mass)).alias("at_0"),
        F.sum(w * F.log(mass + 1)).alias("at_1"),
        F.sum(w * F.log(mass + PRACTICAL_TF)).alias("at_10"),
        F.sum(w * F.log(cp)).alias("log_cp"),
        F.max(mass).alias("top_mass"),
    )


def _or_zero(score: Column) -> Column:
    """A query without terms has no model values; its sum is 0."""
    return F.coalesce(score, F.lit(0.0))


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _steps(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of some rows with ``sizes`` tokens, within ``TOKENS``; a row at least."""
    ends = np.r_[0, np.cumsum(sizes)]
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + TOKENS, "right")) - 1)
        yield at, end
        at = end


def _term_gains(
    tokens: pa.Array, terms: pa.Array, w: pa.Array, mass: pa.Array
) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Sums of gains by unit, for the tokens of some rows with a model each.

    The function takes the unit of each token, or -1, and the row of each unit.
    """
    given = terms.flatten()
    names = given.unique()
    size = max(1, len(names))
    entry = np.repeat(np.arange(len(terms)), _lengths(terms)) * size + pc.index_in(given, value_set=names).to_numpy()
    order = np.argsort(entry)
    entry, weight, share = (values[order] for values in (entry, w.flatten().to_numpy(), mass.flatten().to_numpy()))
    found = pc.fill_null(pc.index_in(tokens, value_set=names), -1).to_numpy().astype(np.int64)

    def by_unit(unit: np.ndarray, row_of: np.ndarray) -> np.ndarray:
        if not len(entry):
            return np.zeros(len(row_of))
        cells, tf = np.unique((unit * size + found)[(found >= 0) & (unit >= 0)], return_counts=True)
        of = cells // size
        key = row_of[of] * size + cells % size
        at = np.minimum(np.searchsorted(entry, key), len(entry) - 1)
        own = entry[at] == key
        at, of, tf = at[own], of[own], tf[own]
        return np.bincount(of, weight[at] * np.log1p(tf / share[at]), len(row_of)).astype(float)

    return by_unit


def _text_gains(tokens: pa.Array, terms: pa.Array, w: pa.Array, mass: pa.Array) -> pa.Array:
    """What its own model's terms add to the score of each token list."""
    sizes, sums = _lengths(tokens), [np.zeros(0)]
    for start, end in _steps(sizes):
        part = slice(start, end)
        row = np.repeat(np.arange(end - start), sizes[part])
        gains = _term_gains(tokens[part].flatten(), terms[part], w[part], mass[part])
        sums.append(gains(row, np.arange(end - start)))
    return pa.array(np.concatenate(sums))


def _sentence_gains(top: int) -> Callable[..., pa.Array]:
    """The same for all sentences of a text together, for its first ``top``, and for each."""

    def gains_of(sentences: pa.Array, terms: pa.Array, w: pa.Array, mass: pa.Array) -> pa.Array:
        counts = _lengths(sentences)
        lists = sentences.flatten()
        sizes = _lengths(lists)
        first = np.r_[0, np.cumsum(counts)]
        ends = np.r_[0, np.cumsum(sizes)]
        whole, start_of, each = [np.zeros(0)], [np.zeros(0)], [np.zeros(0)]
        for start, end in _steps(ends[first[1:]] - ends[first[:-1]]):
            part, inner = slice(start, end), slice(first[start], first[end])
            n = int(first[end] - first[start])
            row_of = np.repeat(np.arange(end - start), counts[part])
            sentence = np.repeat(np.arange(n), sizes[inner])
            row = row_of[sentence]
            gains = _term_gains(lists[inner].flatten(), terms[part], w[part], mass[part])
            early = np.arange(n) - (first[part] - first[start])[row_of] < top
            rows = np.arange(end - start)
            whole.append(gains(row, rows))
            start_of.append(gains(np.where(early[sentence], row, -1), rows))
            each.append(gains(sentence, row_of))
        offsets = pa.array(first.astype(np.int32))
        return pa.StructArray.from_arrays(
            [
                pa.array(np.concatenate(whole)),
                pa.array(np.concatenate(start_of)),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(each))),
            ],
            ["text", "top", "sentences"],
        )

    return gains_of


def sentence_gains(sentences: Column, model: Column, top: int) -> Column:
    """What matches add to the scores of a text, of its first ``top`` sentences and of each, from lists of tokens."""
    kind = "struct<text: double, top: double, sentences: array<double>>"
    return F.arrow_udf(_sentence_gains(top), kind)(sentences, *_entries(model))


def _entries(model: Column) -> tuple[Column, Column, Column]:
    values = F.map_values(model["weights"])
    return model["terms"], values["w"], values["mass"]


def smoothed(size: Column, model: Column, gain: Column, mu: float = MU) -> Column:
    """Score of a text of ``size`` tokens to which its matches add ``gain``."""
    return _or_zero(model["at_0"] - model["w_sum"] * F.log(size + mu) + gain)


def kl(tokens: Column, model: Column, mu: float = MU) -> Column:
    """Weighted log likelihood of the model's terms under the smoothed text."""
    gain = F.arrow_udf(_text_gains, "double")(tokens, *_entries(model))
    return smoothed(F.size(tokens), model, gain, mu)


def cer(tokens: Column, model: Column, mu: float = MU) -> Column:
    """Likelihood ratio against the collection, weights normalized by query length."""
    return _or_zero((kl(tokens, model, mu=mu) - model["log_cp"]) / model["w_sum"])


def at_frequency(length: Column, model: Column, name: str, mu: float = MU) -> Column:
    """Score of a text of ``length`` in which each query term occurs equally often."""
    return _or_zero(model[name] - model["w_sum"] * F.log(length + mu))


def best_case(length: Column, model: Column, mu: float = MU) -> Column:
    """Score of a text made only of the query's most common term."""
    return _or_zero(model["w_sum"] * F.log((length + model["top_mass"]) / (length + mu)))


def bounds(length: Column, model: Column, mu: float = MU) -> Column:
    """Lowest, highest and practical score of a text of ``length``."""
    return F.struct(
        at_frequency(length, model, "at_0", mu).alias("min_score"),
        best_case(length, model, mu).alias("max_score"),
        at_frequency(length, model, "at_10", mu).alias("practical_score"),
    )
