"""Chunk files and side files."""

import gzip
import lzma
import struct

import pytest
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from chronorank.functions import text as T
from chronorank.operators import stats as ST
from chronorank.schema import FIELD_ID, ROUTABLE, STREAM_ITEM
from chronorank.sources import chunks as C
from chronorank.sources import side_files as SF


def encode(value, kind):
    """Binary form of a value of a record type."""
    if isinstance(kind, StructType):
        out = b""
        for field in kind.fields:
            if value.get(field.name) is not None:
                out += struct.pack(">bh", C._wire(field.dataType), field.metadata[FIELD_ID])
                out += encode(value[field.name], field.dataType)
        return out + b"\x00"
    if isinstance(kind, MapType):
        head = struct.pack(">bbi", C._wire(kind.keyType), C._wire(kind.valueType), len(value))
        return head + b"".join(encode(k, kind.keyType) + encode(v, kind.valueType) for k, v in value.items())
    if isinstance(kind, ArrayType):
        head = struct.pack(">bi", C._wire(kind.elementType), len(value))
        return head + b"".join(encode(v, kind.elementType) for v in value)
    if isinstance(kind, (StringType, BinaryType)):
        data = value.encode() if isinstance(value, str) else value
        return struct.pack(">i", len(data)) + data
    return C.NUMBERS[C._wire(kind)].pack(value)


def item(i, **more):
    return {
        "version": 0, "doc_id": f"d{i}", "stream_id": f"{i}-d{i}", "source": "news",
        "stream_time": {"epoch_ticks": float(i), "zulu_timestamp": "2012-01-01T00:00:00.000Z"},
        "body": {
            "clean_visible": f"text é {i}",
            "sentences": {"lingpipe": [{"tokens": [{"token_num": 0, "token": "text"}, {"token": str(i)}]}]},
        },
        **more,
    }


@pytest.fixture(scope="module")
def chunks(tmp_path_factory):
    root = tmp_path_factory.mktemp("chunks")
    (root / "deep").mkdir()
    data = [encode(item(i), STREAM_ITEM) for i in range(6)]
    (root / "plain.sc").write_bytes(data[0] + data[1])
    (root / "deep" / "a.sc.xz").write_bytes(lzma.compress(data[2] + data[3]))
    (root / "deep" / "b.sc.gz").write_bytes(gzip.compress(data[4]))
    (root / "cut.sc").write_bytes(data[5] + data[0][:-20])
    (root / "bad.sc.xz").write_bytes(b"not compressed")
    return str(root)


def test_read_all_kinds(spark, chunks):
    rows = C.read_stream_items(spark, chunks).cache()
    good = C.good_items(rows).collect()
    assert sorted(r.stream_id for r in good) == [f"{i}-d{i}" for i in range(6)]
    one = next(r for r in good if r.doc_id == "d2")
    assert one.body.clean_visible == "text é 2"
    token = one.body.sentences["lingpipe"][0].tokens[0]
    assert (token.token, token.sentence_pos, token.equiv_id) == ("text", -1, -1)
    assert one.abs_url is None and one.ratings is None
    corrupt = C.corrupt_items(rows).collect()
    assert sorted((r._path.rsplit("/", 1)[1], r._index) for r in corrupt) == [("bad.sc.xz", 0), ("cut.sc", 1)]


@pytest.mark.parametrize("large_file", [0, 150, 1 << 40])
def test_files_read_as_streams_give_the_same_rows(spark, chunks, large_file):
    def found(size):
        rows = C.read_stream_items(spark, chunks, large_file=size).select("_path", "_index", "stream_id", "body", "_corrupt")
        return sorted(map(repr, rows.collect()))

    assert found(large_file) == found(C.LARGE_FILE)


def test_a_file_beyond_the_reader_limit_is_streamed_in_bounded_memory(spark, tmp_path):
    """Spark's reader refuses files above the set length; a stream passes them, one batch at a time."""
    text = "x" * 1_000_000
    one = encode(item(0, body={"clean_visible": text}), STREAM_ITEM)
    with open(tmp_path / "long name.sc", "wb") as file:
        for _ in range(120):
            file.write(one)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 50_000_000)
    try:
        rows = C.good_items(C.read_stream_items(spark, str(tmp_path), large_file=50_000_000))
        got = rows.selectExpr("count(*)", "max(_index)", "sum(length(body.clean_visible))").first()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert tuple(got) == (120, 119, 120 * len(text))


def test_many_small_files_make_few_tasks(spark, tmp_path):
    for n in range(300):
        (tmp_path / f"{n}.sc").write_bytes(encode(item(n), STREAM_ITEM))
    rows = C.read_stream_items(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() <= 40
    assert C.good_items(rows).select("stream_id").distinct().count() == 300


def test_projected_read_skips_other_fields(spark, chunks):
    rows = C.good_items(C.read_stream_items(spark, chunks, ROUTABLE))
    assert "doc_id" not in rows.columns
    found = rows.selectExpr("stream_id", "body.sentences['lingpipe'][0].tokens[1].token AS t").collect()
    assert {(r.stream_id, r.t) for r in found} == {(f"{i}-d{i}", str(i)) for i in range(6)}


def test_absent_fields_do_not_come_from_the_record_before(spark, tmp_path):
    second = {"stream_id": "x"}
    (tmp_path / "two").write_bytes(encode(item(1, abs_url=b"u"), STREAM_ITEM) + encode(second, STREAM_ITEM))
    rows = {r.stream_id: r for r in C.read_stream_items(spark, str(tmp_path)).collect()}
    assert rows["1-d1"].abs_url == b"u"
    assert rows["x"].abs_url is None and rows["x"].body is None


def test_topics(spark, tmp_path):
    path = tmp_path / "topics.xml"
    path.write_text(
        "<root><event><id>2</id><type>x</type><query>the costa concordia</query></event>"
        "<event><id>1</id><query>old</query></event><event><id>1</id><query>new one</query></event></root>"
    )
    rows = {r.query_id: r.query for r in SF.read_topics(spark, str(path)).collect()}
    assert rows == {1: "new one", 2: "the costa concordia"}
    stopped = {r.query_id: r.query for r in SF.read_topics(spark, str(path), ["the"]).collect()}
    assert stopped[2] == "costa concordia"


def test_side_files(spark, tmp_path):
    (tmp_path / "vocab").write_text("storm 3 2\n\"fire 4.5\nTOTAL 10\n")
    vocab = SF.read_vocab(spark, str(tmp_path / "vocab"))
    rows = vocab.vocab.withColumn("cp", vocab.vocab.cf / vocab.total).collect()
    assert {(r.term, r.cp) for r in rows} == {("storm", 0.3), ("\"fire", 0.45)}
    (tmp_path / "stop").write_text("the\nof\n")
    stop = SF.read_stoplist(spark, str(tmp_path / "stop"))
    assert SF.stop_terms(stop) == ["of", "the"]
    texts = spark.createDataFrame([("the end of the story", ["the", "of"])], "text string, stop array<string>")
    for terms in (SF.stop_terms(stop), texts.stop):
        assert texts.select(T.words("text", terms).alias("w")).collect()[0].w == ["end", "story"]
    assert ST.doc_lengths(texts, "text", "text", also=["of"]).collect()[0][1:] == (5, 4)
    (tmp_path / "bins").write_text("2012-01-01-00 0\n2012-01-01-01 1\n")
    assert {(r.hour, r.bin) for r in SF.read_date_bins(spark, str(tmp_path / "bins")).collect()} == {
        ("2012-01-01-00", 0), ("2012-01-01-01", 1),
    }
    (tmp_path / "ids.txt").write_text("1-a\n2-b\n")
    assert SF.read_ids(spark, str(tmp_path / "ids.txt")).count() == 2


def test_a_million_stopwords_leave_by_lookup_within_the_row(spark):
    rows = [(1, "The end, of THE story x7!", 0), (2, None, 0), (3, "", 0), (4, "x8 X999999 kept x1000000 kept", 0)]
    docs = spark.createDataFrame(rows, "doc_id int, clean_visible string, _at int")
    stop = spark.range(1_000_000).selectExpr("concat('x', id) AS term").union(
        spark.createDataFrame([("the",), ("of",), ("",), (None,), ("the",)], "term string")
    )
    left = SF.without_stopwords(docs, stop)
    assert left.columns == docs.columns
    got = {r.doc_id: r.clean_visible for r in left.collect()}
    assert got == {1: "end story", 2: None, 3: "", 4: "kept x1000000 kept"}
    short = SF.without_stopwords(docs, stop.limit(0))
    assert short.where("doc_id = 1").first().clean_visible == "the end of the story x7"
    with pytest.raises(ValueError, match="vocabulary"):
        SF.without_stopwords(docs, stop, max_bytes=1_000)


def test_scored_files(spark, tmp_path):
    for query in (1, 7):
        (tmp_path / f"out.{query}").write_text(f'a"b\t{query}\t-1.5\n')
    rows = SF.read_scored(
        spark, [str(tmp_path / "out.*")], "docid string, sentenceid int, docscore double", skip=[7]
    ).collect()
    assert [(r.docid, r.sentenceid, r.docscore, r.query_id) for r in rows] == [('a"b', 1, -1.5, 1)]
