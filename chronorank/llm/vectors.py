"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronorank.llm.common import Forest, in_buckets, neighbours
from chronorank.llm.components import components
from chronorank.shared import materialize

#: Tables, hashes in a code, and the times that signs and a Hadamard rotation are applied.
TABLES, HASHES, ROUNDS = 8, 2, 3
#: Rows of a bucket that one task compares.
BUCKET_ROWS = 4_096
#: Vectors that a task hashes at once.
STEP = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard rotation of rows whose length is a power of two."""
    rows, size = x.shape
    width = 1
    while width < size:
        x = x.reshape(rows, -1, 2, width)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        width *= 2
    return x.reshape(rows, size) / np.sqrt(size)


class CrossPolytope:
    """Codes of unit vectors: of each rotation the nearest of the 2d signed axes, and the second nearest."""

    def __init__(self, dims: int, tables: int = TABLES, hashes: int = HASHES, seed: int = 5) -> None:
        self.size = 1 << max(1, (dims - 1).bit_length())
        draw = np.random.default_rng([seed, dims])
        self.signs = draw.choice([-1.0, 1.0], (tables, hashes, ROUNDS, self.size))

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + hashes): the own code, then with one hash at its second nearest axis."""
        padded = np.zeros((len(unit), self.size))
        padded[:, : unit.shape[1]] = unit
        tables, hashes = self.signs.shape[:2]
        codes = np.zeros((len(unit), tables, 1 + hashes), np.int64)
        rows = np.arange(len(unit))
        for t in range(tables):
            axes = []
            for h in range(hashes):
                x = padded
                for signs in self.signs[t, h]:
                    x = hadamard(x * signs)
                near = np.argpartition(-np.abs(x), 1, axis=1)[:, :2]
                first = np.abs(x[rows, near[:, 0]]) >= np.abs(x[rows, near[:, 1]])
                order = np.where(first[:, None], near, near[:, ::-1])
                axes.append([2 * order[:, i] + (x[rows, order[:, i]] < 0) for i in (0, 1)])
            base = 2 * self.size
            for p in range(1 + hashes):
                for h in range(hashes):
                    codes[:, t, p] = codes[:, t, p] * base + axes[h][int(p == h + 1)]
        return codes


def near_vectors(vectors: DataFrame, cosine: float = 0.93, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label).

    Links vectors of equal label with a cosine of at least ``cosine``, computed
    in doubles of the components as they are given, for all pairs that the index
    finds.  Equal vectors are one class
    that counts as often as it occurs.  In each of ``TABLES`` tables a vector
    lies in the bucket of its code and also visits the buckets with one hash at
    its second nearest axis; an owner of a bucket is compared with all in it.
    Buckets above ``bucket_rows`` are split in parts that meet two by two.  A
    pair counts where it meets first, so only numbers of links, and a spanning
    forest of the links, leave a task.

    Null labels, and vectors that are null, empty, zero or have null or
    non-finite components, link with nothing.  So do vectors of different
    lengths.  Repeated rows are vectors of their own; null ids take part and
    are kept only where no equal vector has an id.
    """
    given = vectors.schema["embedding"].dataType.simpleString()
    kind = given if given == "array<float>" else "array<double>"  # floats are exact in doubles, and half as long
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind), F.col("label"))
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull()
    for test in (
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))),
        F.exists("embedding", lambda x: x != 0),
    ):
        sound = sound & F.coalesce(test, F.lit(False))
    rows = rows.withColumn("sound", sound)
    classes = materialize(
        rows.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("times")),
        "vectors",
    )
    found = materialize(_bucket_links(classes.where("id is not null"), cosine, bucket_rows), "vector_links")
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    groups = components(found.where("b is not null"))
    named = classes.join(links, "id", "left").join(groups, "id", "left").select(
        F.col("label").alias("_label"),
        F.col("embedding").alias("_embedding"),
        (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component"),
    )
    named = materialize(named, "vector_groups")
    on = rows["sound"] & (rows["label"] == named["_label"]) & (rows["embedding"] == named["_embedding"])
    component = F.coalesce("component", "vec_id")
    return rows.join(named, on, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _bucket_links(classes: DataFrame, cosine: float, bucket_rows: int) -> DataFrame:
    kind = (
        "label_key binary, dims int, t int, code long, owner boolean, id long, times long, "
        "vector binary, codes binary"
    )
    # labels of any type are compared by their text
    named = classes.select(F.col("label").cast("string").cast("binary").alias("label_key"), "embedding", "id", "times")
    rows = named.mapInPandas(_code_rows, kind)
    keys = ["label_key", "dims", "t", "code"]
    rows = in_buckets(rows, keys, "id", bucket_rows, "hot_vector_buckets")

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in neighbours(batches, [*keys, "meet"]):
            for _, same in held.groupby("dims", sort=False):
                yield _links_of(same, cosine)

    return rows.mapInPandas(links, "a long, b long, links long")


def _code_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashers: dict[int, CrossPolytope] = {}
    for batch in batches:
        lengths = batch["embedding"].map(len)
        for dims in lengths.unique():
            every = batch[lengths == dims]
            hasher = hashers.setdefault(int(dims), CrossPolytope(int(dims)))
            for at in range(0, len(every), STEP):
                part = every.iloc[at : at + STEP]
                x = np.stack(part["embedding"]).astype(np.float64)
                # powers of two change no digits; beyond the doubles' range neither squares nor quotients are
                unit = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
                unit /= np.linalg.norm(unit, axis=1)[:, None]
                codes = hasher(unit)
                n, tables, probes = codes.shape
                times = tables * probes
                yield pd.DataFrame(
                    {
                        "label_key": np.repeat(part["label_key"].to_numpy(), times),
                        "dims": np.int32(dims),
                        "t": np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes), n),
                        "code": codes.reshape(-1),
                        "owner": np.tile(np.arange(probes) == 0, n * tables),
                        "id": np.repeat(part["id"].to_numpy(), times),
                        "times": np.repeat(part["times"].to_numpy(), times),
                        "vector": np.repeat(np.array([u.tobytes() for u in unit], object), times),
                        "codes": np.repeat(np.array([c.tobytes() for c in codes], object), times),
                    }
                )


def _links_of(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Numbers of links (a, null, links) and spanning forest (a, b, 0) of the pairs that meet first here."""
    bucket = rows[["label_key", "t", "code", "meet"]].ne(rows[["label_key", "t", "code", "meet"]].shift()).any(axis=1)
    bucket = bucket.cumsum().to_numpy()
    ids, index = np.unique(rows["id"].to_numpy(), return_inverse=True)
    unit = np.frombuffer(b"".join(rows["vector"])).reshape(len(rows), -1)
    codes = np.frombuffer(b"".join(rows["codes"]), np.int64).reshape(len(rows), TABLES, 1 + HASHES)
    owner, times = rows["owner"].to_numpy(), rows["times"].to_numpy()
    t, code = rows["t"].to_numpy(), rows["code"].to_numpy()
    part, own = rows["part"].to_numpy(), rows["cross"].to_numpy()
    links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
    lag, at = 1, np.arange(len(rows) - 1)
    while len(at):
        at = at[at + lag < len(rows)]
        at = at[bucket[at] == bucket[at + lag]]
        a, b = at, at + lag
        # two rows of one part meet where that part meets itself
        meet = (owner[a] | owner[b]) & ((part[a] != part[b]) == own[a])
        a, b = a[meet], b[meet]
        close = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine if len(a) else np.zeros(0, bool)
        a, b = a[close], b[close]
        if len(a):
            first = _first_meeting(codes[a], codes[b])
            here = (first[:, 0] == t[a]) & (first[:, 1] == code[a])
            np.add.at(links, index[a[here]], times[b[here]])
            np.add.at(links, index[b[here]], times[a[here]])
            forest.merge(index[a], index[b])
        lag += 1
    (some,) = np.nonzero(links)
    edges = np.array(forest.edges, np.int64).reshape(-1, 2)
    out = {
        "a": np.concatenate([ids[some], ids[edges[:, 0]]]),
        "b": pd.array([None] * len(some) + ids[edges[:, 1]].tolist(), "Int64"),
        "links": np.concatenate([links[some], np.zeros(len(edges), np.int64)]),
    }
    return pd.DataFrame(out)


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(table, code) of the first bucket that one of each pair owns and the other is in; of two in a table the lower."""
    never = np.iinfo(np.int64).max
    own_a = np.where((a[:, :, :1] == b).any(axis=2), a[:, :, 0], never)
    own_b = np.where((b[:, :, :1] == a).any(axis=2), b[:, :, 0], never)
    codes = np.minimum(own_a, own_b)
    table = (codes != never).argmax(axis=1)
    return np.stack([table, codes[np.arange(len(a)), table]], axis=1)


#: ``near_vectors`` of ``embeddings`` with all pairs compared.
VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.y, r.c FROM r JOIN l ON r.id = l.x),
n AS (SELECT x, count(*) AS links FROM l GROUP BY x)
SELECT id AS vec_id, coalesce(max(links), 0)::BIGINT AS n_links, min(c) AS component_id, id = min(c) AS kept
FROM r LEFT JOIN n ON id = x GROUP BY id
"""
