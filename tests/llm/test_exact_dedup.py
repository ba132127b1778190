"""Exact duplicates against a plain grouping, and their edge cases."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from chronorank.llm.exact_dedup import exact_duplicates, merge_runs

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def plain(rows):
    """The same by a dict of normalised texts; the first row of the smallest id is kept."""
    groups = {}
    for at, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append((doc_id is None, doc_id or 0, at))
    out = []
    for text, members in groups.items():
        _, keep, kept_at = min(members)
        keep = None if min(members)[0] else keep
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(None if none else i, keep, len(members), at == kept_at, sha) for none, i, at in members]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_against_plain_grouping(spark):
    draw = random.Random(3)
    texts = ["a b", "a  b", "a\tb", " a b", "", None, " ", "\n", "x " * 50_000, "é ü", "a\u000bb", "A b"]
    # one text holds a third of all rows
    rows = [(i, "hot text " if i % 3 == 0 else draw.choice(texts) or None) for i in range(900)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(exact_duplicates(df)) == plain(rows)


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_texts_that_go_on_in_the_next_batch(size):
    schema = pa.schema([("part", pa.int32()), ("digest", pa.binary()), ("proof", pa.int64()), pa.field("n", pa.int64(), nullable=False)])
    texts = [0, 0, 0, 1, 2, 2, 2, 2, 2, 2, 3]
    rows = [{"part": 0, "digest": bytes([t]) * 32, "proof": t, "n": 1} for t in texts]
    batches = [pa.RecordBatch.from_pylist(rows[at : at + size], schema=schema) for at in range(0, len(rows), size)]
    batches.insert(1, batches[0].slice(0, 0))
    merged = [row for batch in merge_runs(iter(batches)) for row in batch.to_pylist()]
    assert [(row["proof"], row["n"]) for row in merged] == [(0, 3), (1, 1), (2, 6), (3, 1)]


@pytest.mark.parametrize("partitions", ["2", "40", "300"])
def test_rounds_of_any_number(spark, partitions):
    rows = [(i, f"text {i % 40}") for i in range(200)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert found(exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(None, "only null"), (None, "only  null"), (5, "same"), (5, "same"), (None, "same"), (4, "other"), (None, None)]
    df = spark.createDataFrame([(*r, *"abcdefgh") for r in rows], "doc_id long, text string, id string, part string, n string, row string, digest string, proof string, kept string, keep_id string")
    got = exact_duplicates(df)
    assert got.columns == COLUMNS
    result = found(got)
    want = plain(rows)
    # which of the rows with one id is kept is open
    assert [r[:3] + r[4:] for r in result] == [r[:3] + r[4:] for r in want]
    kept = [r for r in result if r[3]]
    assert len(kept) == len({r[4] for r in result})


def test_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ids_of_another_type(spark):
    df = spark.createDataFrame([("b", "t"), ("a", "t"), ("c", "u")], "doc_id string, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_duplicates(df).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
