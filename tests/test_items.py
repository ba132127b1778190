"""Items: times, keys, the stored table, sentences and export."""

from datetime import datetime

from pyspark.sql import functions as F

from chronorank.functions import ids as I
from chronorank.functions import text as T
from chronorank.operators import export as E
from chronorank.operators import loading as LD
from chronorank.operators import routing as R
from chronorank.operators import scoring as SC
from chronorank.operators import sentences as S
from chronorank.operators import stats as ST
from chronorank.operators.topics import topic_vectors
from chronorank.sources import items as SI
from chronorank.sources import sinks as K

ITEM = (
    "doc_id long, stream_id string, source string, stream_time struct<zulu_timestamp: string>, "
    "abs_url binary, body struct<clean_visible: string, "
    "sentences: map<string, array<struct<tokens: array<struct<token: string>>>>>>"
)


def sentences(*texts):
    return [([(t,) for t in text.split()],) if text is not None else (None,) for text in texts]


def items(spark):
    rows = [
        (1, "10-a", "news", ("2012-01-01T05:10:00.250Z",), b"http://a/\xc3\xa9", ("One two. Three.", {"lingpipe": sentences("One two", None, "Three")})),
        (2, "20-b", None, None, None, ("No time", {"lingpipe": []})),
        (3, "30-c", "news", ("2012-01-02T00:00:00.000Z",), None, None),
        (4, "40-d", "news", ("not a time",), None, ("", {})),
        (5, "50-e", "news", ("2012-01-01T06:00:00.000Z",), None, ("Other tagger", {"serif": sentences("x")})),
        (6, "60-f", "news", ("2012-01-01T05:00:00.000Z",), None, ("Many", {"lingpipe": sentences(*[f"w{i} storm" for i in range(30)])})),
    ]
    return spark.createDataFrame(rows, ITEM)


def test_valid_items(spark):
    assert sorted(r.doc_id for r in R.valid_items(items(spark)).collect()) == [1, 2, 5, 6]


def test_times(spark):
    rows = {r.doc_id: r for r in R.item_times(items(spark)).collect()}
    assert (rows[1].epoch_ms, rows[1].hour) == (1325394600250, "2012-01-01-05")
    assert datetime.fromtimestamp(rows[1].epoch_ms / 1000).year == 2012
    assert rows[2].epoch_ms is None and rows[4].epoch_ms is None


def test_size_filter_keeps_rejected_rows(spark):
    rows = R.size_filter(items(spark).select("doc_id", "body.clean_visible"), 5).collect()
    assert {r.doc_id: r.accepted for r in rows if r.n_bytes is not None} == {
        1: False, 2: False, 4: True, 5: False, 6: True,
    }


def stored(spark, tmp_path):
    timed = R.item_times(items(spark).filter("doc_id IN (1, 2, 5, 6)"))
    bins = spark.createDataFrame([("2012-01-01-05", 7)], "hour string, bin int")
    routed = spark.createDataFrame([(1, 3), (2, 3), (5, 4), (6, 4)], "doc_id long, query_id int")
    path = str(tmp_path / "items")
    SI.write_items(R.stored_items(timed, routed, bins).drop("doc_id"), path)
    return SI.read_items(spark, path)


def test_stored_table(spark, tmp_path):
    table = stored(spark, tmp_path)
    rows = {r.stream_id: r for r in table.collect()}
    assert rows["10-a"].rowkey == "030007.10-a"
    assert (rows["20-b"].date_bin, rows["20-b"].rowkey) == (-1, None)  # no timestamp
    assert (rows["50-e"].date_bin, rows["50-e"].rowkey) == (-1, None)  # unknown hour
    assert rows["60-f"].clean_visible == "Many"
    assert [r.stream_id for r in SI.scan_bins(table, 3, 7, 8).collect()] == ["10-a"]
    assert SI.scan_bins(table, 3, 0, 7).count() == 0
    assert SI.scan_query(table, 4).count() == 2
    keys = spark.createDataFrame([(4, "60-f"), (3, "60-f")], "query_id int, stream_id string")
    assert [r.stream_id for r in SI.lookup_items(table, keys).collect()] == ["60-f"]
    assert ST.row_count(table).collect()[0].n == 4


def test_scan_reads_only_the_query_and_columns(spark, tmp_path):
    plan = SI.scan_query(stored(spark, tmp_path), 4).select("clean_visible")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(query_id" in text
    assert "ReadSchema: struct<body:struct<clean_visible:string>>" in text


def skewed(spark):
    """One query with most bytes, one of its hours larger than a file, and many small cells."""
    rows = spark.range(6000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(100)))
    return rows.select(
        F.when(F.col("k") < 70, 1).otherwise(F.col("k").cast("int")).alias("query_id"),
        F.when(F.col("k") < 40, 5).otherwise((F.col("id") % 50).cast("int")).alias("date_bin"),
        F.col("id").cast("string").alias("stream_id"),
        F.repeat(F.sha2(F.col("id").cast("string"), 512), 8).alias("clean_visible"),
        F.lit(1024).cast("long").alias("n_bytes"),
    )


def test_files_hold_about_equal_bytes(spark, tmp_path):
    rows = skewed(spark)
    size = 256 * 1024
    placement = SI.plan_slots(rows, size)
    by_slot = placement.of(rows).groupBy(SI.SLOT).agg(F.sum("n_bytes").alias("bytes"), F.count_distinct("query_id", "date_bin").alias("cells"))
    found = {r[SI.SLOT]: r.bytes for r in by_slot.collect()}
    assert sum(found.values()) == 6000 * 1024
    assert max(found.values()) < 2 * size
    assert len(found) <= 2 * (6000 * 1024 // size)
    SI.write_items(rows.drop("n_bytes"), str(tmp_path / "placed"), placement=placement)
    back = spark.read.parquet(str(tmp_path / "placed"))
    assert back.count() == 6000
    assert back.select("query_id", "date_bin", "stream_id").exceptAll(rows.select("query_id", "date_bin", "stream_id")).count() == 0
    # of the query that holds most, files are of a size (the written ones as well)
    sizes = [p.stat().st_size for p in (tmp_path / "placed" / "query_id=1").glob("*.parquet")]
    assert len(sizes) > 4 and sorted(sizes)[-1] < 2.5 * sorted(sizes)[len(sizes) // 2]


def test_body_is_built_after_the_move(spark, tmp_path):
    """Nothing but the narrow row crosses the exchange; the derived column is in the file."""
    rows = skewed(spark)
    seen = []

    def finish(moved):
        seen.append(moved._jdf.queryExecution().optimizedPlan().toString())
        return moved.withColumn("body", F.struct("clean_visible", F.length("clean_visible").alias("n")))

    SI.write_items(rows.drop("n_bytes"), str(tmp_path / "late"), placement=SI.plan_slots(rows), finish=finish)
    assert "Repartition" in seen[0] and "body" not in seen[0]
    assert SI.read_items(spark, str(tmp_path / "late")).select("body.n").distinct().count() == 1


def test_few_keys_read_few_row_groups(spark, tmp_path):
    rows = skewed(spark)
    SI.write_items(rows.drop("n_bytes"), str(tmp_path / "keyed"), placement=SI.plan_slots(rows, 256 * 1024))
    table = spark.read.parquet(str(tmp_path / "keyed"))
    keys = rows.where("query_id = 1").limit(20).select("query_id", "stream_id")
    keys = spark.createDataFrame(keys.collect(), "query_id int, stream_id string")
    found = SI.lookup_items(table, keys)
    assert found.select("query_id", "stream_id").exceptAll(keys).count() == 0 and found.count() == 20
    # one key: of the files of its query, Bloom filters leave few
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = SI.lookup_items(table, keys.limit(1))
        one.collect()
        plan = one._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "PartitionFilters: [isnotnull(query_id" in plan.toString()
    assert 0 < scanned_rows(plan) <= table.where("query_id = 1").count() / 4


def scanned_rows(node):
    """Rows that the largest scan of an executed plan gave, after row groups were left out."""
    own = node.metrics().apply("numOutputRows").value() if "Scan parquet" in node.nodeName() else 0
    children = node.children()
    return max([own, *(scanned_rows(children.apply(at)) for at in range(children.size()))])


def loaded(spark, tmp_path, limit):
    topics = topic_vectors(spark.createDataFrame([(3, "two three"), (4, "storm w25 tagger")], "query_id int, query string"))
    stats = ST.as_collection(spark.createDataFrame([("storm", 30.0), ("three", 1.0)], "term string, weight double"))
    bins = spark.createDataFrame([("2012-01-01-05", 7), ("2012-01-01-06", 8)], "hour string, bin int")
    given = items(spark).drop("doc_id")
    LD.load_items(given, topics, stats, bins, str(tmp_path / "items"), str(tmp_path / "rejected"), limit=limit)
    return SI.read_items(spark, str(tmp_path / "items")), spark.read.parquet(str(tmp_path / "rejected"))


def test_load_keeps_rejected_items_with_a_reason(spark, tmp_path):
    stored_items, rejected = loaded(spark, tmp_path, 600)
    assert {r.stream_id: r.reason for r in rejected.collect()} == {"30-c": "no body", "40-d": "no text", "60-f": "too large"}
    assert {r.stream_id: (r.query_id, r.date_bin, r.rowkey) for r in stored_items.collect()} == {
        "10-a": (3, 7, "030007.10-a"), "20-b": (3, -1, None), "50-e": (4, 8, "040008.50-e"),
    }
    # the whole item counts, not its text alone
    assert all(r.n_bytes >= 600 for r in rejected.where("reason = 'too large'").collect())


def test_load_without_rejected_items(spark, tmp_path):
    stored_items, rejected = loaded(spark, tmp_path, 10**9)
    assert stored_items.count() == 4 and rejected.count() == 2


def test_sentences(spark):
    rows = S.sentences(items(spark).filter("body IS NOT NULL")).orderBy("stream_id", "sent_num").collect()
    first = [(r.sent_num, r.sentence) for r in rows if r.stream_id == "10-a"]
    assert first == [(0, "One two "), (1, "Three ")]
    assert {r.stream_id for r in rows} == {"10-a", "60-f"}


def test_sentence_scores(spark, tmp_path):
    table = stored(spark, tmp_path)
    topics = topic_vectors(spark.createDataFrame([(3, "three"), (4, "storm w25")], "query_id int, query string"))
    stats = ST.as_collection(spark.createDataFrame([("storm", 30.0), ("three", 1.0)], "term string, weight double"))
    scores = S.sentence_scores(table, SC.topic_models(topics, stats), topics.small)
    rows = [r for r in scores.orderBy("sent_num").collect() if r.stream_id == "60-f"]
    assert [r.sent_num for r in rows] == list(range(30))
    assert {(r.n_sent, r.doc_len) for r in rows} == {(30, 60)}
    assert rows[0].doc_score != rows[0].top_score
    assert rows[25].sent_score > rows[24].sent_score
    assert scores.filter("stream_id IN ('20-b', '50-e')").count() == 0
    last = S.latest_sentence(scores).collect()
    assert {r.stream_id: r.sent_num for r in last} == {"10-a": 1, "60-f": 29}


def test_trec_export(spark, tmp_path):
    records = E.trec_records(R.item_times(items(spark)))
    rows = {r.stream_id: r for r in records.collect()}
    assert "30-c" not in rows and "40-d" in rows
    assert rows["10-a"].record == (
        "<DOC>\n<DOCNO>10-a</DOCNO>\n<SOURCE>news</SOURCE>\n<URL>http://a/é</URL>\n"
        "<DATETIME>2012-01-01T05:10:00.250Z</DATETIME>\n<HOURDAYDIR>2012-01-01-05</HOURDAYDIR>\n"
        "<EPOCH>1325394600250</EPOCH>\n<TEXT>\n0 One two \n1 Three \n\n</TEXT>\n</DOC>\n"
    )
    assert "<SOURCE></SOURCE>" in rows["20-b"].record and "<EPOCH>0</EPOCH>" in rows["20-b"].record
    K.write_trec(records, str(tmp_path / "trec"))
    lines = spark.read.text(str(tmp_path / "trec")).filter("value = '<DOC>'").count()
    assert lines == len(rows)


def test_id_paths(spark):
    ids = ["abc", "http://a.b/c?d=1^", "é \x01+,", "1330610340ef8a", "a|b\\c\"*<>"]
    df = spark.createDataFrame([(i,) for i in ids], "id string").withColumn("path", I.id_to_path(F.col("id")))
    rows = df.withColumn("back", I.path_to_id(F.col("path"))).collect()
    assert [r.back for r in rows] == ids
    assert rows[0].path == "ab/c"
    assert rows[1].path.replace("/", "") == "http+==a,b=c^3fd^3d1^5e"
    assert all(len(part) <= 2 for r in rows for part in r.path.split("/"))


def test_sharded_and_text_sinks(spark, tmp_path):
    rows = stored(spark, tmp_path)
    K.write_sharded(rows.select("query_id", "stream_id"), str(tmp_path / "shards"), depth=1)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert {(r.query_id, str(r.shard), r.stream_id) for r in back.collect()} == {
        (3, "10", "10-a"), (3, "20", "20-b"), (4, "50", "50-e"), (4, "60", "60-f"),
    }
    run = spark.createDataFrame([(1, "b", 2, -2.5), (1, "a", 1, -1.5)], "query_id int, stream_id string, rank int, score double")
    K.write_run(run, str(tmp_path / "run"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "run")).collect()) == ["1,a,-1.5", "1,b,-2.5"]
    K.write_kv(spark.createDataFrame([("w", 3)], "word string, n long"), str(tmp_path / "kv"))
    assert [r.value for r in spark.read.text(str(tmp_path / "kv")).collect()] == ["w\t3"]


def test_tokens(spark):
    row = spark.createDataFrame([("The Cat's 2nd\tÉté\n",)], "t string").select(
        T.words("t").alias("w"), T.words("t", ["the"]).alias("s"), T.space_tokens("t").alias("b")
    ).collect()[0]
    assert row.w == ["the", "cat", "s", "2nd", "été"]
    assert row.s == row.w[1:]
    assert row.b == ["The", "Cat's", "2nd", "Été"]


def test_text_sinks_and_split_keys(spark, tmp_path):
    stats = spark.createDataFrame([("storm", 3.0), ("of", 10.0)], "term string, weight double")
    K.write_vocab(stats, str(tmp_path / "vocab"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "vocab")).collect())) == [("of", 10.0), ("storm", 3.0)]
    rows = spark.createDataFrame([("p", "news", None, '1-"a', -1.5)], "path string, source string, epoch long, id string, score double")
    K.write_scored(rows, str(tmp_path / "scored"))
    assert [r.value for r in spark.read.text(str(tmp_path / "scored")).collect()] == ['p\tnews\t\t1-"a\t-1.5']
    key = spark.createDataFrame([("030007.10-a",)], "rowkey string")
    assert key.select(I.stream_id_of("rowkey").alias("id")).collect()[0].id == "10-a"


def test_hour_label_ignores_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    times = spark.createDataFrame([(1325394600250,), (-1,), (None,)], "ms long")
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = [r.h for r in times.select(T.hour_label("ms").alias("h")).collect()]
            assert got == ["2012-01-01-05", "1969-12-31-23", None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
