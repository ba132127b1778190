"""Document fingerprints of closed syncmers, and their likeness by place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A syncmer has so many units; its inner substrings have so many.
K, S = 5, 2
#: Characters of a unit at most; longer words are several units.
UNIT = 6
#: Hashes of anchors are numbers below this.
HASHES = 1 << 32
#: A fingerprint keeps all anchors with hashes below a fixed bound, one of 32, so it
#: grows with the text, and at least so many of the smallest.
BELOW, ANCHORS = HASHES // 32, 64
#: Anchors count as in place up to this displacement from the usual one, in units.
NEAR = 64
#: Documents of a range of neighbouring ids, about, and ranges at most.
RANGE_ROWS, RANGES = 1_000, 4_096

ANCHOR_TYPE = "array<struct<h:bigint,at:int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def anchors(text: Column) -> Column:
    """Closed syncmers of the text below ``BELOW``, and at least the ``ANCHORS`` smallest: (h, at) by hash, of equal ones the first.

    Units are runs of non-blank characters, cut after ``UNIT``.  A run of ``K``
    units is kept if the least of the hashes of its runs of ``S`` units is its
    first or its last one, which depends on the run alone.  A text of fewer
    units is one run; a text of none has no anchors.
    """
    units = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\S{1,%d}" % UNIT), F.lit(0))
    inner = K - S + 1

    def digest(h: Column) -> Column:
        return F.shiftrightunsigned(h, 32)

    def of_units(u: Column) -> Column:
        pairs = F.transform(u, lambda x, i: F.xxhash64(x, *[F.get(u, i + j) for j in range(1, S)]))
        return _let(pairs, lambda p: _let(F.size(u), lambda n: of_pairs(p, n)))

    def of_pairs(p: Column, n: Column) -> Column:
        def pick(first: Column, i: Column) -> Column:
            others = [F.get(p, i + j) for j in range(1, inner)]
            # the last runs of the text have no whole one: null, and not kept
            edge = (first <= F.least(*others)) | (others[-1] <= F.least(first, *others[:-1]))
            # every other inner run covers the units of the whole one
            whole = F.xxhash64(first, *others[S - 1 :: S], others[-1])
            return F.when((i <= n - K) & edge, F.struct(digest(whole).alias("h"), i.cast("int").alias("at")))

        kept = F.filter(F.transform(p, pick), lambda x: x.isNotNull())
        run = F.xxhash64(F.concat_ws(" ", F.transform(p, lambda x: x.cast("string"))))
        short = F.array(F.struct(digest(run).alias("h"), F.lit(0).alias("at")))
        none = F.array().cast(ANCHOR_TYPE)
        return F.when(n >= K, _let(kept, smallest)).when(n > 0, short).otherwise(none).cast(ANCHOR_TYPE)

    def smallest(kept: Column) -> Column:
        # numbers sort faster than structs: only those up to the last hash that stays are sorted with their places
        hashes = F.sort_array(F.array_distinct(F.transform(kept, lambda x: x["h"])))
        last = F.greatest(F.coalesce(F.get(hashes, F.lit(ANCHORS - 1)), F.lit(HASHES)), F.lit(BELOW))
        few = _let(last, lambda last: F.sort_array(F.filter(kept, lambda x: x["h"] <= last)))
        return _let(few, lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["h"] != x["h"])))

    return _let(units, of_units)


def fingerprint(found: Column) -> Column:
    """Anchors as text: 8 hexadecimal digits of the hash, a dot and the place, by hash."""
    return F.array_join(F.transform(found, lambda a: F.concat(F.lpad(F.hex(a["h"]), 8, "0"), F.lit("."), a["at"])), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of anchors that two texts have in common at matching places, from 0 to 1.

    Compares the anchors up to the hash to which both fingerprints are complete.
    An anchor of both matches if its displacement is near the median one.  The
    share of the union is turned into that of the mean size (Dice).  Two texts
    without anchors are alike.
    """

    def complete(x: Column) -> Column:
        # with fewer than ANCHORS, all are there
        return F.when(F.size(x) < ANCHORS, F.lit(HASHES)).otherwise(F.greatest(F.element_at(x, -1)["h"], F.lit(BELOW)))

    def compare(x: Column, y: Column) -> Column:
        sides = [F.transform(z, lambda v, s=s: F.struct(v["h"].alias("h"), F.lit(s).alias("s"), v["at"].alias("at"))) for s, z in enumerate((x, y))]
        every = _let(F.least(complete(x), complete(y)), lambda last: F.filter(F.concat(*sides), lambda v: v["h"] <= last))
        return _let(F.sort_array(every), shared)

    def shared(both: Column) -> Column:
        # a hash of both texts stands twice in a row
        moves = F.transform(
            both, lambda v, i: F.when(F.get(both, i + 1)["h"] == v["h"], v["at"] - F.get(both, i + 1)["at"])
        )
        return _let(F.sort_array(F.filter(moves, lambda d: d.isNotNull())), lambda m: of_moves(m, F.size(both) - F.size(m)))

    def of_moves(m: Column, union: Column) -> Column:
        usual = F.get(m, F.floor(F.size(m) / 2).cast("int"))
        share = _let(usual, lambda u: F.size(F.filter(m, lambda d: F.abs(d - u) <= NEAR))) / union
        return F.when(union == 0, 1.0).when(F.size(m) == 0, 0.0).otherwise(2 * share / (1 + share))

    return _let(a, lambda x: _let(b, lambda y: compare(x, y)))


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS, **carried: Column) -> DataFrame:
    """``docs`` with the ``carried`` values of the next row by descending doc_id in ``next_<name>``; after the last: the first.

    Ids are cut in ranges at ids that occur, so that the first row of a range
    is known by its id: it goes to its range and, to end it, to the one before.
    So rows move once and no range is longer than its ids make it.  Null ids
    come last; rows of one id are ordered by their text.
    """
    rows = docs.count()
    if not rows:
        return docs.withColumns(carried | {f"next_{k}": v for k, v in carried.items()})
    steps = min(RANGES, max(1, -(-rows // range_rows)))
    places = [i / steps for i in range(1, steps)] + [1.0]
    found = docs.agg(F.percentile_approx("doc_id", places, 10 * max(1000, steps)).alias("cuts"), F.max("doc_id").alias("top"))
    found = found.first()
    # from the largest id down; the first range starts with the largest id
    heads = sorted({*(found["cuts"] or []), *([found["top"]] if found["top"] is not None else [])}, reverse=True)
    last = max(0, len(heads) - 1)
    starts = F.array(*[F.lit(h).cast("long") for h in heads]).cast("array<bigint>")
    home = F.when(F.col("doc_id").isNull(), last).otherwise(
        F.size(F.filter(starts, lambda h: h >= F.col("doc_id"))) - 1
    )
    at_head = F.col("doc_id").isNotNull() & F.array_contains(starts, F.col("doc_id"))
    if not heads:
        # null ids only: every row could be the first
        at_head = F.lit(True)
    before = F.when(home == 0, last).otherwise(home - 1)
    sent = F.array(F.struct(home.cast("int").alias("to"), F.lit(False).alias("ends")))
    extra = F.array(F.struct(before.cast("int").alias("to"), F.lit(True).alias("ends")))
    rows_ = docs.withColumns(carried).withColumn("_range", F.explode(F.when(at_head, F.concat(sent, extra)).otherwise(sent)))
    rows_ = rows_.withColumns({"_to": F.col("_range.to"), "_ends": F.col("_range.ends")}).drop("_range")
    order = Window.partitionBy("_to").orderBy("_ends", F.col("doc_id").desc_nulls_last(), *[F.col(c) for c in carried if c != "anchors"])
    return (
        rows_.withColumns({f"next_{k}": F.lead(k).over(order) for k in carried}).where("not _ends").drop("_to", "_ends")
    )


def compare_with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text) and of its edited text.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  The edited text has its last half replaced by as
    much of the beginning of the next document (by descending id; after the
    last the first).  Null texts count as empty; an only document is its own
    next one.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("anchors", anchors(F.col("text"))), range_rows, text=F.col("text"), anchors=F.col("anchors"))
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", "anchors", "next_anchors", size.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("edited_anchors", anchors(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("anchors")).alias("fingerprint"),
        fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
