"""Exact duplicates by a tree-merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronorank.llm.common import small_side
from chronorank.shared import materialize

#: Bits of a digest that one round exchanges runs by; a merge has at most two to this power of them.
ROUND_BITS = 4
#: Order of a run: by part, text (digest and proof), and the smallest identifier of equal texts first.
ORDER = ["part", "digest", "proof", "no_id", "id", "row"]

WHITE = r"[\x20\x09-\x0D]+"
SQL = r"""
WITH texts AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM texts
WINDOW same AS (PARTITION BY text_sha256)
"""


def normalized(text: Column) -> Column:
    """``text`` with every run of blanks as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _digests(column: pa.Array) -> np.ndarray:
    """Digests as rows of four numbers."""
    fixed = column.cast(pa.binary(32))
    return np.frombuffer(fixed.buffers()[1], np.uint64)[4 * fixed.offset :][: 4 * len(fixed)].reshape(-1, 4)


def _heads(rows: pa.RecordBatch) -> np.ndarray:
    """True where rows in ``ORDER`` go on to another text or part."""
    new = np.ones(rows.num_rows, bool)
    digests = _digests(rows.column("digest"))
    new[1:] = (digests[1:] != digests[:-1]).any(axis=1)
    for name in ("proof", "part"):
        values = rows.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return new


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each part and text of rows in ``ORDER``: the first one, with the sum of ``n``.

    The last text of a batch may go on in the next one, so its entry is held
    back; nothing else is kept.
    """
    held: pa.RecordBatch | None = None
    for rows in batches:
        if not rows.num_rows:
            continue
        if held is not None:
            rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
        at = np.flatnonzero(_heads(rows))
        firsts = rows.take(pa.array(at))
        sums = pa.array(np.add.reduceat(rows.column("n").to_numpy(), at))
        columns = [sums if name == "n" else firsts.column(name) for name in rows.schema.names]
        entries = pa.RecordBatch.from_arrays(columns, schema=rows.schema)
        if len(at) > 1:
            yield entries.slice(0, len(at) - 1)
        held = entries.slice(len(at) - 1)
    if held is not None:
        yield held


def merge_tree(runs: DataFrame, bits: int, round_bits: int = ROUND_BITS) -> DataFrame:
    """Entries of all ``runs`` (part, digest, proof, no_id, id, row, n), one for each text.

    The ``2 ** bits`` parts exchange their runs in rounds.  In a round the parts
    whose numbers differ in the same ``round_bits`` bits are one tree: each of
    its members takes over a share of the digests from all of them, the share
    named by those bits of the digest, and merges what it gets into one run
    again.  After the last round a part's number is the head of its digests.
    Entries halve in number wherever runs meet in a text, so a frequent text
    sends one entry for each part and round, and no part ends with everything.
    """
    schema = runs.schema
    for low in range(0, bits, round_bits):
        width = min(round_bits, bits - low)
        mask = ((1 << width) - 1) << low
        head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
        part = F.col("part").bitwiseAND(F.lit(~mask)).bitwiseOR(head.bitwiseAND(F.lit(mask)))
        moved = runs.withColumn("part", part.cast("int")).repartitionById(1 << bits, F.col("part"))
        runs = moved.sortWithinPartitions(*ORDER).mapInArrow(merge_runs, schema)
    return runs


def parts_bits(df: DataFrame) -> int:
    """Bits of the number of parts: the session's shuffle partitions, as a power of two."""
    return max(1, (int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, keep_id, group_size, kept, text_sha256 of every row of ``docs``.

    Texts are equal if they are identical with every run of blanks as one space;
    null counts as empty.  One row of equal texts is kept: the one with the
    smallest key.  Null keys come last, and of rows with the same key one is
    kept; ``keep_id`` is null where no row of a text has a key.  Other columns
    are ignored; an empty table gives no rows.

    Every task digests its texts and sorts the digests into a run of one entry
    for each text; texts never move.  Runs are merged by ``merge_tree``.  An
    entry stands for equal texts only if their SHA-256 and a second, unrelated
    hash agree, at every level.  Answers for texts that occur again go back to
    the entries of the first runs, of which a text has one for each part and
    task, and from there to the rows of that part; so no join sees a hot key.
    """
    bits = parts_bits(docs)
    plain = normalized(F.col(text))
    digested = docs.select(F.col(key).alias("id"), plain.alias("_text")).select(
        F.spark_partition_id().bitwiseAND(F.lit((1 << bits) - 1)).alias("part"),
        F.unhex(F.sha2("_text", 256)).alias("digest"),
        F.xxhash64("_text").alias("proof"),
        F.col("id").isNull().alias("no_id"),
        "id",
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(digested, "digests")
    first = rows.withColumn("n", F.lit(1).cast("long")).sortWithinPartitions(*ORDER)
    first = materialize(first.mapInArrow(merge_runs, first.schema), "digest_runs")
    again = merge_tree(first, bits).where("n > 1").select(
        "digest", "proof", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size")
    )
    again = materialize(again, "repeated")
    same = ["digest", "proof"]
    # tasks that share a part have entries of their own
    answers = first.select("part", *same).join(small_side(again), same).distinct()
    out = rows.join(answers, ["part", *same], "left")
    return out.select(
        F.col("id").alias(key),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

