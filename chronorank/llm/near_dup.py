"""MinHash near-duplicate groups by a multi-index Hamming join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronorank.llm.common import Forest, MinHash, released, shingle_set, small_side
from chronorank.llm.components import components
from chronorank.shared import materialize

#: Signature: so many chunks of so many 16-bit symbols.
CHUNKS, WIDTH = 8, 4
#: One differing symbol is allowed in a chunk.  Two signatures that differ in at
#: most 2 * CHUNKS - 1 symbols then agree on some chunk up to one symbol.
MOST_DIFFERING = 2 * CHUNKS - 1
#: Members of a bucket, and shingles of a cluster, that one task compares.
BUCKET_ROWS = 8_192
CLUSTER_SHINGLES = 1_000_000


def near_duplicates(
    docs: DataFrame,
    k: int = 3,
    percent: int = 85,
    bucket_rows: int = BUCKET_ROWS,
    cluster_shingles: int = CLUSTER_SHINGLES,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    Links texts whose sets of distinct ``k``-word shingles have
    ``100 * intersection >= percent * union``, on the full sets.

    1. Equal sets are one class with a number of its own; the rest works on classes.
    2. A class has ``CHUNKS * WIDTH`` minima of 16 bits.  Every chunk with one
       symbol left out is a key, so any two signatures within ``MOST_DIFFERING``
       symbols share a key.  Rows with a key are compared by signature, and only
       a spanning forest of the close ones is passed on: no pairs are listed.
    3. Components of these forests are clusters.  In each one the full sets are
       compared, and again a spanning forest of the links is passed on.
    4. Groups of classes are named by their smallest doc_id.

    Buckets and clusters above the limits are split in parts that meet two by
    two.  Null and blank texts have an empty set and no links.  A null id gets
    the group of its equal set if that has an id, else none, and is kept then.
    Rows of one id are one document, so their texts, if different, are in one
    group; no text is left out.  Repeated rows have equal results; other columns
    are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    marks = materialize(
        docs.mapInPandas(_marker(k), "doc_id long, n_shingles long, set_id binary, signature binary"), "marks"
    )
    sets = marks.where("n_shingles > 0 and doc_id is not null")
    classes = sets.groupBy("set_id").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")
    )
    # numbers of the written rows: two classes may have the same smallest doc_id
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    clusters = materialize(components(_close_signatures(classes, bucket_rows)), "clusters")
    per_id = sets.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("set_id").alias("low"), F.max("set_id").alias("high"))
    repeated = materialize(per_id.where("rows > 1").drop("rows"), "repeated_ids")
    links = _confirmed_links(docs, repeated, classes, clusters, k, percent, cluster_shingles)
    groups = materialize(components(links.union(_same_document(sets, repeated, classes))), "groups")
    linked = groups.join(classes.select("id", "least"), "id")
    names = materialize(linked.groupBy("component").agg(F.min("least").alias("name")), "names")
    named = groups.join(small_side(names), "component").select("id", "name")
    named = classes.join(named, "id", "left").select("set_id", F.coalesce("name", "least").alias("of_set"))
    return marks.join(materialize(named, "named"), "set_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("of_set", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.col("doc_id").eqNullSafe(F.coalesce("of_set", "doc_id")))
        .otherwise(True)
        .alias("kept"),
    )


def _same_document(sets: DataFrame, repeated: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes of the different texts of one doc_id."""
    several = repeated.where("low <> high").select("doc_id", "low")
    pairs = sets.select("doc_id", "set_id").join(small_side(several), "doc_id").where("set_id <> low")
    pairs = materialize(pairs.select("low", "set_id").distinct(), "repeated_sets")
    low, other = (classes.select(F.col("set_id").alias(c), F.col("id").alias(e)) for c, e in (("low", "a"), ("set_id", "b")))
    return pairs.join(low, "low").join(other, "set_id").select("a", "b")


def _sets_of(k: int):
    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in released(batches):
            names = [_set_id(shingle_set(text, k)) for text in rows["text"]]
            yield pd.DataFrame({"set_id": names, "text": rows["text"]})

    return sets_of


def _set_id(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _marker(k: int):
    minima = MinHash(CHUNKS * WIDTH)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in released(batches):
            sets = [shingle_set(text, k) for text in rows["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"],
                    "n_shingles": [len(s) for s in sets],
                    "set_id": [_set_id(s) for s in sets],
                    "signature": [minima(s).tobytes() for s in sets],
                }
            )

    return mark


def _keys(digits: str) -> Column:
    """Every chunk with one of its symbols left out, numbered by what was left out."""
    keys = []
    for chunk in range(CHUNKS):
        for gap in range(WIDTH):
            at = [chunk * WIDTH + i for i in range(WIDTH) if i != gap]
            parts = [F.substring(digits, 1 + 4 * i, 4) for i in at]
            keys.append(F.conv(F.concat(F.lit(f"{chunk * WIDTH + gap:02x}"), *parts), 16, 10).cast("long"))
    return F.array(*keys)


def _close_signatures(classes: DataFrame, bucket_rows: int) -> DataFrame:
    """Edges (a, b) that span every set of classes with close signatures in a bucket."""
    rows = classes.select("id", "signature", F.hex("signature").alias("digits"))
    rows = rows.select("id", "signature", F.explode(_keys("digits")).alias("key"))
    hot = materialize(
        rows.groupBy("key").count().where(F.col("count") > bucket_rows).select(
            "key", F.ceil(F.col("count") / bucket_rows).cast("int").alias("parts")
        ),
        "hot_keys",
    )
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    meets = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda other: F.least(part, other) * F.col("parts") + F.greatest(part, other),
        )
    )
    rows = rows.join(small_side(hot), "key", "left").select("key", F.explode(meets).alias("meet"), "id", "signature")
    return rows.repartition("key", "meet").sortWithinPartitions("key", "meet").mapInPandas(_span_buckets, "a long, b long")


def _span_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning forests of the close rows with equal (key, meet); input is sorted by these."""
    held: list[pd.DataFrame] = []
    for rows in released(batches):
        end = (rows["key"].iat[-1], rows["meet"].iat[-1]) if len(rows) else None
        if end is None:
            continue
        open_ = ((rows["key"] == end[0]) & (rows["meet"] == end[1])).to_numpy()
        cut = len(rows) - int(open_.sum())
        if cut == 0 and held and (held[0]["key"].iat[-1], held[0]["meet"].iat[-1]) == end:
            held.append(rows)
            continue
        yield _forest_of(pd.concat([*held, rows.iloc[:cut]]))
        held = [rows.iloc[cut:]]
    if held:
        yield _forest_of(pd.concat(held))


def _forest_of(rows: pd.DataFrame) -> pd.DataFrame:
    key, meet = rows["key"].to_numpy(), rows["meet"].to_numpy()
    same = np.zeros(len(rows), bool)
    if len(rows) > 1:
        next_ = (key[1:] == key[:-1]) & (meet[1:] == meet[:-1])
        same[1:] |= next_
        same[:-1] |= next_
    rows, key, meet = rows[same], key[same], meet[same]
    ids, index = np.unique(rows["id"].to_numpy(), return_inverse=True)
    signatures = np.frombuffer(b"".join(rows["signature"]), np.uint16).reshape(len(rows), CHUNKS * WIDTH)
    forest, lag, at = Forest(len(ids)), 1, np.arange(len(rows) - 1)
    while len(at):
        at = at[at + lag < len(rows)]
        at = at[(key[at] == key[at + lag]) & (meet[at] == meet[at + lag])]
        look = at[forest.label[index[at]] != forest.label[index[at + lag]]]
        if len(look):
            close = (signatures[look] != signatures[look + lag]).sum(axis=1) <= MOST_DIFFERING
            forest.merge(index[look[close]], index[look[close] + lag])
        lag += 1
    edges = np.array(forest.edges, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": ids[edges[:, 0]], "b": ids[edges[:, 1]]})


def _confirmed_links(
    docs: DataFrame,
    repeated: DataFrame,
    classes: DataFrame,
    clusters: DataFrame,
    k: int,
    percent: int,
    cluster_shingles: int,
) -> DataFrame:
    members = materialize(clusters.join(classes.select("id", "n", "set_id", "least"), "id"), "members")
    large = materialize(
        members.groupBy("component").agg(F.sum("n").alias("all")).where(F.col("all") > cluster_shingles).select(
            "component", F.ceil(F.col("all") / cluster_shingles).cast("int").alias("parts")
        ),
        "large_clusters",
    )
    members = materialize(members.join(small_side(large), "component", "left"), "members")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    others = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    once = docs.join(small_side(repeated.select("doc_id")), "doc_id", "left_anti").select("doc_id", "text")
    wanted = members.select("id", "component", "parts", "least", "set_id")
    texts = once.join(small_side(wanted.drop("set_id")), F.col("doc_id") == F.col("least"))
    # an id does not tell which of its texts a class has; its set does
    again = docs.join(small_side(repeated.select("doc_id")), "doc_id", "left_semi").select("text")
    again = again.mapInPandas(_sets_of(k), "set_id binary, text string").groupBy("set_id").agg(F.first("text").alias("text"))
    again = again.join(wanted.join(small_side(repeated.select(F.col("doc_id").alias("least"))), "least", "left_semi"), "set_id")
    columns = ["component", "id", "text", "parts"]
    texts = texts.select(*columns).union(again.select(*columns))
    blocks = texts.select("component", "id", "text", part.alias("part"), F.explode(others).alias("other")).select(
        "component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "id", "part", "text"
    )

    def confirm(rows: pd.DataFrame) -> pd.DataFrame:
        return _links_within(rows, k, percent)

    return blocks.groupBy("component", "i", "j").applyInPandas(confirm, "a long, b long")


def _links_within(rows: pd.DataFrame, k: int, percent: int) -> pd.DataFrame:
    """Spanning forest of the links between the rows of one block, or of two different ones."""
    cross = rows["i"].iat[0] != rows["j"].iat[0]
    ids, parts = rows["id"].to_numpy(), rows["part"].to_numpy()
    sets = [shingle_set(text, k) for text in rows["text"]]
    sizes = np.array([len(s) for s in sets])
    terms, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(codes, kind="stable")
    owners = owner[order]
    starts = np.searchsorted(codes[order], np.arange(len(terms) + 1))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    forest = Forest(len(sets))
    for x in range(len(sets) - 1):
        own = codes[ends[x] : ends[x + 1]]
        shared = np.bincount(np.concatenate([owners[starts[c] : starts[c + 1]] for c in own]), minlength=len(sets))
        shared[: x + 1] = 0
        linked = 100 * shared >= percent * (sizes[x] + sizes - shared)
        linked[: x + 1] = False
        if cross:
            linked &= parts != parts[x]
        (found,) = np.nonzero(linked)
        forest.merge(np.full(len(found), x), found)
    edges = np.array(forest.edges, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": ids[edges[:, 0]], "b": ids[edges[:, 1]]})
