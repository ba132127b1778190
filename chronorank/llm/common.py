"""Hashed words and shingles, and checks of side tables, for the operators here."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import TypeVar

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronorank.shared import fits, materialize

#: Side tables with at most this many narrow rows may be replicated.
MAX_SIDE_ROWS = 1_000_000

Batch = TypeVar("Batch")

_PRIME = np.uint64(0x9E3779B185EBCA87)
_SHIFT = np.uint64(29)


def small_side(df: DataFrame, max_rows: int = MAX_SIDE_ROWS) -> DataFrame:
    """``df`` hinted for replication if it was counted small, else as it is.

    For tables of a few fixed-size columns only, so that rows bound the bytes.
    """
    return F.broadcast(df) if fits(df, max_rows) else df


def in_buckets(rows: DataFrame, keys: list[str], by: str, most: int, name: str) -> DataFrame:
    """``rows`` dealt out by ``keys`` and a column ``meet``, sorted by both, so that rows that meet are neighbours.

    A bucket of more than ``most`` rows is cut in parts by a hash of ``by``.  Its
    rows are repeated so that every two parts, and every part with itself, meet
    once; ``part`` is a row's own part, and ``cross`` is true where two different
    ones meet.
    """
    hot = rows.groupBy(*keys).count().where(F.col("count") > most)
    hot = materialize(hot.select(*keys, F.ceil(F.col("count") / most).cast("int").alias("parts")), name)
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("parts"))).cast("int")
    rows = rows.join(small_side(hot), keys, "left").withColumn("part", part)
    others = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    rows = rows.withColumn("other", F.explode(others))
    meet = F.least("part", "other") * F.coalesce("parts", F.lit(1)) + F.greatest("part", "other")
    rows = rows.withColumns({"meet": meet.cast("long"), "cross": F.col("part") != F.col("other")})
    # in the meeting of two parts, each one's rows know the other; both say so
    rows = rows.drop("parts", "other")
    return rows.repartition(*keys, "meet").sortWithinPartitions(*keys, "meet")


def released(batches: Iterator[Batch]) -> Iterator[Batch]:
    """``batches``, and what they and earlier tasks of this worker have freed goes back to the system at their end.

    Workers outlive their tasks and, by their allocators, keep the most that any of them has held.
    """
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def neighbours(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The sorted rows of a task, cut only between different ``keys``."""
    held: list[pd.DataFrame] = []
    for rows in batches:
        if not len(rows):
            continue
        end = np.ones(len(rows), bool)
        for key in keys:
            end &= (rows[key] == rows[key].iat[-1]).to_numpy()
        cut = len(rows) - int(end.sum())
        if cut == 0 and held and all(held[0][k].iat[-1] == rows[k].iat[-1] for k in keys):
            held.append(rows)
            continue
        yield pd.concat([*held, rows.iloc[:cut]])
        held = [rows.iloc[cut:]]
    if held:
        yield pd.concat(held)


def ascii_words(text: str | None) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles_in_order(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of ``k`` words; of fewer words, one for the whole sequence."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(k, n)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out = (out ^ hashes[j : n - width + 1 + j]) * _PRIME
        out ^= out >> _SHIFT
    return out


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct ``k``-word shingles of the whole text."""
    return np.unique(shingles_in_order(word_hashes(ascii_words(text)), k))


class MinHash:
    """``size`` independent minima of hashed sets, each kept as a 16-bit symbol."""

    def __init__(self, size: int, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        self.flip = draw.integers(1, 1 << 63, size, dtype=np.uint64)[:, None]
        self.times = draw.integers(1, 1 << 63, size, dtype=np.uint64)[:, None] | np.uint64(1)
        self.size = size

    def __call__(self, hashes: np.ndarray, step: int = 16_384) -> np.ndarray:
        least = np.full(self.size, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), step):
            mixed = (hashes[None, at : at + step] ^ self.flip) * self.times
            least = np.minimum(least, mixed.min(axis=1))
        return ((least * _PRIME) >> np.uint64(48)).astype(np.uint16)


class Forest:
    """Components of local indices, merged edge by edge; keeps the edges that merged."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.label[a] != self.label[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            p, q = self.label[x], self.label[y]
            if p != q:
                self.label[self.label == max(p, q)] = min(p, q)
                self.edges.append((x, y))
