"""Operators that SQL cannot express, against brute force, exact round trips and held-out labels."""

import hashlib
import random
import re
import struct
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from chronorank.llm import components, extraction, fingerprints, licenses, near_dup, pieces, quality, queries, toxicity, urls, vectors
from chronorank.llm.common import shingle_set

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


@pytest.fixture(scope="module")
def near_copies(spark):
    """A large group of copies and one of near copies around a text, chains and unrelated texts."""
    draw = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [draw.choice(words) for _ in range(90)]
    texts = [" ".join(base)] * 40
    for n in range(120):
        own = list(base)
        for _ in range(n % 6):
            own[draw.randrange(90)] = f"x{n}"
        texts.append(" ".join(own))
    own = [draw.choice(words) for _ in range(90)]
    for n in range(30):
        own = list(own)
        own[(7 * n) % 90] = f"y{n}"
        texts.append(" ".join(own))
    texts += [" ".join(draw.choice(words) for _ in range(draw.randint(1, 60))) for _ in range(150)]
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("k", "percent", "bucket", "cluster"), [(3, 85, 8192, 1_000_000), (5, 80, 16, 2_000)])
def test_near_duplicates(spark, near_copies, k, percent, bucket, cluster):
    sets = {i: set(shingle_set(t, k).tolist()) for i, t in near_copies}
    want = Groups()
    for i, a in sets.items():
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                want.join(i, j)
    table = spark.createDataFrame(near_copies, "doc_id long, text string")
    for r in near_dup.near_duplicates(table, k, percent, bucket, cluster).collect():
        assert r.component_id == want.find(r.doc_id)
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("turned", [False, True])
def test_different_texts_of_one_id_all_keep_their_links(spark, turned):
    words = {name: [f"{name}{i}" for i in range(60)] for name in "abc"}
    a, b, c = (" ".join(words[name]) for name in "abc")
    near_a, near_b = (" ".join([*words[name][:-1], "end"]) for name in "ab")
    rows = [(5, a), (5, b), (7, near_a), (9, near_b), (11, c), (11, c), (11, None), (12, c), (None, b), (13, "other words here")]
    table = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, near_dup.near_duplicates(table).collect()), key=repr)
    want = [(5, 58, 5, True)] * 2 + [(7, 58, 5, False), (9, 58, 5, False), (None, 58, 5, False)]
    want += [(11, 58, 11, True)] * 2 + [(11, 0, 11, True), (12, 58, 11, False), (13, 1, 13, True)]
    assert got == sorted(want, key=repr)


def test_one_id_on_a_third_of_the_rows(spark):
    rows = [(1, " ".join(f"x{n}y{i}" for i in range(20))) for n in range(300)] + [(2 + n, f"t{n} u v w") for n in range(600)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.component_id == r.doc_id and r.kept for r in got)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (101, 102), (5, 5)], "a long, b long")
    got = dict(map(tuple, components.components(edges).collect()))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("bucket", [4096, 20])
def test_vectors(spark, bucket):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(20, 24))
    x = np.concatenate([centres[draw.integers(0, 20, 260)] + 0.24 * draw.normal(size=(260, 24)), centres[[0] * 30]])
    label = draw.integers(0, 3, len(x))
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(label[i])) for i in range(len(x))]
    unit = np.float32(x).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in vectors.near_vectors(table, bucket_rows=bucket).collect()}
    found = sum(r.n_links for r in got.values())
    assert all(r.n_links <= linked[i].sum() for i, r in got.items())
    assert found >= 0.98 * linked.sum() > 0


def test_fingerprints(spark, folder):
    docs = sorted(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())[::-1]
    got = {r.doc_id: r for r in queries.op1_fingerprints(spark, folder).collect()}
    near = []
    for i, d in enumerate(docs):
        text, after = d.text, docs[(i + 1) % len(docs)].text
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        row = got[d.doc_id]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row.near_next <= 1 and (row.near_edited == 1) >= (row.fingerprint == row.edited_fingerprint)
        if len(text) > 200:
            near.append((row.near_edited, row.near_next))
    assert np.median([a for a, _ in near]) > 0.4 > 0.1 > np.median([b for _, b in near])
    equal = defaultdict(set)
    for d in docs:
        equal[d.text].add(got[d.doc_id].fingerprint)
    assert all(len(prints) == 1 for prints in equal.values())


def plain_anchors(text):
    """Closed syncmers by the definition, run by run."""

    def hashed(*values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    units = re.findall(r"[^ \t\n\x0b\f\r]{1,6}", (text or "").lower())
    pairs = [hashed(*units[i : i + 2]) for i in range(len(units))]
    if len(units) < 5:
        found = {hashed(" ".join(map(str, pairs))) % (1 << 64) >> 32: 0} if units else {}
    else:
        found = {}
        for i in range(len(units) - 4):
            inner = pairs[i : i + 4]
            if min(inner) in (inner[0], inner[-1]):
                found.setdefault(hashed(inner[0], inner[2], inner[3]) % (1 << 64) >> 32, i)
    hashes = sorted(found)
    kept = [h for n, h in enumerate(hashes) if n < 64 or h <= 1 << 27]
    return [(h, found[h]) for h in kept]


def plain_likeness(a, b):
    last = min(max(x[-1][0], 1 << 27) if len(x) >= 64 else 1 << 32 for x in (a, b))
    a, b = ({h: at for h, at in x if h <= last} for x in (a, b))
    moves = sorted(a[h] - b[h] for h in a.keys() & b.keys())
    if not a and not b:
        return 1.0
    near = sum(abs(m - moves[len(moves) // 2]) <= 64 for m in moves)
    share = near / len(a.keys() | b.keys())
    return 2 * share / (1 + share)


def test_fingerprints_by_brute_force(spark):
    draw = random.Random(8)
    words = ["a", "Wort", "été", "😀", "longer-than-a-unit", "x1", "THE"] + [f"w{n}" for n in range(4_000)]
    texts = [" ".join(draw.choice(words) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 6, 40, 300, 2_000, 12_000, 60_000)]
    texts += [texts[-2][:30_000] + texts[-2][36_000:], texts[-2] + " ".join(f"n{n}" for n in range(500)), "same " * 500, " \t\n", None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    rows = table.withColumn("a", fingerprints.anchors(F.col("text")))
    got = {r.doc_id: [tuple(v) for v in r.a] for r in rows.select("doc_id", "a").collect()}
    want = [plain_anchors(t) for t in texts]
    assert [got[i] for i in range(len(texts))] == want
    assert len(want[11]) > 10 * fingerprints.ANCHORS and len(want[9]) == fingerprints.ANCHORS
    other = rows.select(F.col("doc_id").alias("o"), F.col("a").alias("b"))
    pairs = rows.select("doc_id", "a").join(other, F.abs(F.col("doc_id") - F.col("o")) <= 3)
    for r in pairs.select("doc_id", "o", fingerprints.likeness(F.col("a"), F.col("b")).alias("near")).collect():
        assert r.near == pytest.approx(plain_likeness(want[r.doc_id], want[r.o])), (r.doc_id, r.o)
    # 500 new words behind 12,000 show
    assert 0.9 < plain_likeness(want[10], want[13]) < 1


def test_ranges_of_next_documents(spark):
    from chronorank.llm.fingerprints import with_next

    ids = [5, 9, 2, 7, 7, 40, 1, None, 12, 3]
    table = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    for size in (1, 3, 100):
        got = with_next(table, size, text=F.col("text")).select("text", "next_text").collect()
        order = ["t40", "t12", "t9", "t7", "t7", "t5", "t3", "t2", "t1", "tNone"]
        assert sorted(map(tuple, got)) == sorted(zip(order, order[1:] + order[:1], strict=True))


def test_pieces_equal_the_library_and_round_trip(spark, folder):
    sentencepiece = pytest.importorskip("sentencepiece")
    with open(MODEL, "rb") as file:
        own = pieces.PieceTransducer(file.read())
    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    draw = random.Random(2)
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").limit(60).collect()]
    texts += ["".join(draw.choice(" \n\taeiounrst.,éß日😀TH01▁") for _ in range(draw.randint(0, 60))) for _ in range(500)]
    texts += [" " * n + "the" for n in range(40)]
    for text in texts:
        ids = list(own.encode(text))
        assert ids == theirs.encode(text)
        assert own.decode(pa.array([ids], pa.list_(pa.int32()))) == [text.replace("▁", " ")]
    assert queries.op10_sentencepiece(spark, folder).where("not round_trip").count() == 0


def test_unigram_path_is_the_shortest():
    model = pieces.PieceTransducer(b"")
    model.texts = ["<unk>", "a", "b", "ab", "aba", "ba"]
    model.scores = [0.0, -1.0, -1.2, -1.9, -2.2, -1.1]
    model.kinds = [2, 1, 1, 1, 1, 1]
    model.ids, model.longest = {t: i for i, t in enumerate(model.texts) if i}, 3

    def every(text):
        if not text:
            yield 0.0, []
        for n in range(1, len(text) + 1):
            if text[:n] in model.ids:
                for cost, path in every(text[n:]):
                    yield cost - model.scores[model.ids[text[:n]]], [text[:n], *path]

    for text in ("abab", "aabba", "babab", "bbaab"):
        assert model.shortest_path(text) == min(every(text))[1]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="content with-sidebar"><article><p>Text</p></article></div>', "Text"),
        ('<div class="sidebar-right"><div id="x"><article><p>Text</p></article></div><p>News</p></div>', "Text"),
        ('<form id="page"><main><p>Text</p></main><input></form>', "Text"),
        ('<article><div class="article-header"><h1>Head</h1></div><p>Text</p></article>', "Head\nText"),
        ('<article><div class="toolbar"><h1>Head</h1>Print</div><p>Text</p></article>', "Head\nText"),
        ('<article><p>A <a class="related" href="x">link</a> in</p><p class="share-price">Up</p></article>', "A link in\nUp"),
        ('<article><p id="search-history">Past</p><p class="ad">Buy</p></article>', "Past"),
        ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>", "So x=1 holds"),
        ('<article class="post comments-open no-sidebar"><p>Text</p></article>', "Text"),
        ('<article><p>Text</p><div class="related"><h3>More</h3><article>Card</article></div></article>', "Text"),
        ('<div class="related"><article><p>Card</p></article></div><main><p>Text</p></main>', "Text"),
        ('<div class="related"><article><p>Card</p><div class="share">Tell</div></article></div>', "Card"),
        ('<article><p>Text</p></article><article class="reader-comment"><p>No</p></article>', "Text"),
        ('<article><p>Text</p><div class="comments"><article><p>No</p></article></div><form>Send</form></article>', "Text"),
        ('<article><p>Text</p><div class="share-buttons"><h4>Tell</h4></div><footer>End</footer></article>', "Text"),
        ('<aside><article>Card</article></aside><nav>Menu</nav><article data-id="ad"><p>Text</p></article>', "Text"),
        ('<header class="x"><h1>Site</h1></header><div class="cookie-notice">Yes</div><article>Text</article>', "Text"),
    ],
)
def test_frame_names_leave_the_article(page, want):
    lines, kinds = extraction.page_lines(f"<html><body>{page}</body></html>")
    assert "\n".join(x for x, k in zip(lines, kinds, strict=True) if k == extraction.ARTICLE) == want
    assert set(kinds) <= {extraction.ARTICLE, extraction.FRAME, extraction.OPEN}


def test_common_lines():
    draw = random.Random(2)
    for _ in range(300):
        a, b = ([draw.randint(0, 4) for _ in range(draw.randint(0, 10))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        places = extraction.shared_lines(a, b)
        rest = iter(b)
        assert len(places) == best[-1][-1] and all(a[i] in rest for i in places)


def test_pages_without_an_article_lose_what_neighbours_share(spark):
    frame = "<div>Home News Contact</div>%s<div>All rights reserved by us</div>"
    rows = [(i, f"http://a.com/n/{i}", frame % f"<p>Story {i}</p><p>More {i}</p>") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (2_000, 5):
        got = {r.page_id: r for r in extraction.extract_text(pages, size).collect()}
        alone = [r for r in got.values() if r.shared == 0]
        assert len(alone) <= (0 if size > 40 else 10)
        assert all(r.text == f"Story {r.page_id}\nMore {r.page_id}" for r in got.values() if r.shared)


def test_open_lines_beside_an_article_are_decided_by_the_difference(spark):
    body = "<div>Home News</div><article>%s</article><h2>Lead %s</h2><div><p>Body %s</p></div><div>All rights reserved</div>"
    rows = [(i, f"http://a.com/n/{i:02d}", body % (f"Card {i}", i, i)) for i in range(10)]
    rows += [(i, f"http://b.com/n/{i:02d}", body % ("Same card", i // 2, i // 2)) for i in range(10, 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extraction.extract_text(pages).collect()}
    assert all(got[i] == f"Card {i}\nLead {i}\nBody {i}" for i in range(10))
    # pairs of copies: each one's other neighbour tells the frame; the first and the last have none and lose nothing
    for i in range(10, 20):
        text = f"Same card\nLead {i // 2}\nBody {i // 2}"
        head, rest = text.split("\n", 1)
        assert got[i] == (f"Home News\n{head}\n{rest}\nAll rights reserved" if i in (10, 19) else text)


def test_texts_are_equal_at_every_range_size(spark):
    frame = "<div>Home News Contact</div><p>Story %s</p><p>More %s</p><div>All rights reserved by us</div>"
    rows = [(i, f"http://{h}.com/n/{i:02d}", frame % (i, i)) for h, ids in (("a", range(16)), ("b", range(16, 40))) for i in ids]
    rows += [(31, "http://b.com/n/31", frame % (n, n)) for n in (70, 71)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(60)
    got = [sorted(map(tuple, extraction.extract_text(pages, size).collect())) for size in (2_000, 20, 5, 1)]
    assert got[0] == got[1] == got[2] == got[3]
    assert len(got[0]) == len(rows) and all(text.startswith("Story") and shared == 2 for _, _, text, _, shared in got[0])


def test_url_templates_of_deep_paths_small_shares_and_similar_siblings(spark):
    rules = (
        urls.Rule("allow", "a.org", "/a/b/c/good"), urls.Rule("block", "a.org", "/a/b/c/bad/1"),
        urls.Rule("allow", "b.org", "/"), urls.Rule("block", "b.org", "/s07/1"), urls.Rule("block", "b.org", "/s08/1"),
    )
    names = [f"http://a.org/a/b/c/good/{i}" for i in range(60)] + [f"http://a.org/a/b/c/bad/1{i}" for i in range(60)]
    names += ["http://a.org/a/b/c/bad/2", "http://a.org/a/b/c/bad/2/x/y"]
    names += [f"http://b.org/s{s:02d}/1{i}" for s in range(40) for i in range(50)]
    pages = spark.createDataFrame(list(enumerate(names)), "page_id long, url string")
    got = {names[r.page_id]: r for r in urls.judge_urls(pages, rules).collect()}
    assert len(got) == len(names)
    assert got["http://a.org/a/b/c/good/3"].template.startswith("/*/*/*/good")
    new, deep = got["http://a.org/a/b/c/bad/2"], got["http://a.org/a/b/c/bad/2/x/y"]
    assert new.template == "/*/*/*/bad/*" and deep.template == "/*/*/*/bad/*/*/*"
    assert (new.rule, new.verdict) == (None, "block") and new.purity < urls.LEAST_PURITY
    # two of 40 even sections are blocked, 2.5 % of the host's pages each: they branch, as one
    assert {got[f"http://b.org/s{s}/11"].template for s in ("07", "08")} == {"/{s08}/*"}
    assert {got[f"http://b.org/s{s}/11"].template for s in ("06", "39")} == {"/*/*"}


def test_url_templates_reject_and_allow_what_no_rule_decides(spark):
    rules = (urls.Rule("block", "a.org", "/bad/1"), urls.Rule("allow", "a.org", "/good/1"), urls.Rule("block", "b.org", "/x/1"))
    names = [f"http://a.org/{s}/{k}{i}" for s in ("bad", "good") for k in (1, 2) for i in range(40)]
    names += [f"http://b.org/{s}/{i}" for s in ("x", "y") for i in range(100, 140)] + ["http://c.org/x/2"]
    pages = spark.createDataFrame(list(enumerate(names)), "page_id long, url string")
    for r in urls.judge_urls(pages, rules).collect():
        wrong = "/bad/" in names[r.page_id] or r.host == "b.org"
        assert r.verdict == ("block" if wrong else "allow"), r


def test_a_segment_written_like_a_wildcard_is_none(spark):
    rules = (urls.Rule("block", "a.org", "/*/1"), urls.Rule("allow", "a.org", "/q/1"), urls.Rule("allow", "a.org", "/{*}/1"))
    names = [f"http://a.org/*/1{i}" for i in range(60)] + ["http://a.org/*/2"]
    names += [f"http://a.org/{s}/1{i}" for s in ("q", "{*}") for i in range(5)] + ["http://a.org/q/7"]
    pages = spark.createDataFrame(list(enumerate(names)), "page_id long, url string")
    got = {names[r.page_id]: (r.template, r.verdict) for r in urls.judge_urls(pages, rules).collect()}
    assert got["http://a.org/*/2"] == ("/#*/*", "block")
    assert got["http://a.org/q/7"] == ("/*/*", "allow")


def license_runs(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(words[i : i + licenses.K]) for i in range(max(1, len(words) - licenses.K + 1))] if words else []


def test_licenses(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs).collect()}
    for doc_id, text in texts.items():
        runs = license_runs(text)
        exact = 0
        for name, notices in licenses.NOTICES.items():
            for plain in map(license_runs, notices):
                starts = [i for i in range(len(runs)) if runs[i : i + len(plain)] == plain]
                exact += len(starts)
                spans = {(m.first, m.end) for m in got[doc_id] if m.license == name and m.containment == 1}
                assert spans >= {(i, i + len(plain) + licenses.K - 1) for i in starts}
        assert sum(m.containment == 1 for m in got[doc_id]) >= exact
        for m in got[doc_id]:
            inside = set(runs[m.first : m.end - licenses.K + 1])
            shares = [len(set(p) & inside) / len(set(p)) for p in map(license_runs, licenses.NOTICES[m.license])]
            assert any(s == pytest.approx(m.containment) for s in shares) and m.containment >= licenses.CONTAINMENT
        spans = sorted((m.first, m.end) for m in got[doc_id])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_every_notice_of_a_text_and_related_licences():
    scanner = licenses.Scanner(licenses.NOTICES)
    for name, notices in licenses.NOTICES.items():
        for notice in notices:
            size = len(licenses.license_words(notice))
            # alone, next to itself, and far apart
            for gap in ("", "some other words here ", "filler text " * 700):
                text = f"before it {notice} {gap}{notice} after it"
                skip = 2 + size + len(gap.split())
                assert scanner.scan(text) == [(name, 1.0, 2, 2 + size), (name, 1.0, skip, skip + size)], (name, gap)


def test_notices_with_changed_words_are_found_at_the_threshold():
    scanner = licenses.Scanner(licenses.NOTICES)
    draw = random.Random(4)
    for name, notices in licenses.NOTICES.items():
        for notice in notices:
            words = licenses.license_words(notice)
            if len(words) < 30:
                continue
            for _ in range(20):
                own = [w.decode() for w in words]
                own[draw.randrange(licenses.K, len(own) - licenses.K)] = "changed"
                plain, changed = license_runs(notice), license_runs(" ".join(own))
                share = len(set(plain) & set(changed)) / len(set(plain))
                if share >= licenses.CONTAINMENT:
                    found = scanner.scan("a b c " + " ".join(own) + " x y z")
                    assert len(found) == 1 and found[0][1] >= share


def test_kneser_ney_sums_to_one(spark):
    texts = spark.createDataFrame([("abracadabra alakazam",), ("banana bandana",), ("cabana",)], "text string")
    model = quality.KneserNey(texts)
    letters = sorted({c for r in texts.collect() for c in r.text})
    for history in ("aba", "ban", "zzz", "a a", "qqq"):
        keys = [int(quality.character_grams(history + c)[0]) for c in [*letters, "\u4e00"]]
        table = spark.createDataFrame([(k,) for k in keys], "key long")
        total = sum(np.exp(r.logp) for r in model.log_probabilities(table).collect())
        assert total == pytest.approx(1, abs=1e-9)


def test_perplexity_of_blocks(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    model = quality.KneserNey(docs.select("text"))
    one = {r.doc_id: (round(r.nats, 3), r.grams) for r in quality.perplexities(docs, model).collect()}
    many = {r.doc_id: (round(r.nats, 3), r.grams) for r in quality.perplexities(docs, model, 7).collect()}
    assert one == many
    for r in docs.collect():
        assert one[r.doc_id][1] == max(0, len(r.text) - quality.ORDER + 1)


def test_quality_and_toxicity_on_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = queries.op4_quality_classifier(spark, folder).join(labels, "doc_id")
    good = judged.where("quality = 1")
    assert good.where("rejected").count() <= 0.01 * good.count()
    poor = judged.where("quality = 0")
    assert poor.where("rejected").count() >= 0.8 * poor.count()
    scored = queries.op5_toxicity(spark, folder).join(labels, "doc_id").where("held_out")
    assert scored.where("toxic = 1 and predicted = 1").count() >= 0.9 * scored.where("toxic = 1").count()
    assert scored.where("toxic = 0 and predicted = 1").count() <= 0.05 * scored.where("toxic = 0").count()


def test_segments():
    cost = toxicity.COST
    hits = [(0, 2.0), (1, -1.5), (2, 3.0), (30, 1.0), (40, -2.0), (41, 4.0)]
    score = np.full(50, -cost)
    for at, value in hits:
        score[at] = value
    sums = np.concatenate([[0.0], np.cumsum(score)])
    best = max((sums[j] - sums[i], i, j) for i in range(50) for j in range(i + 1, 51))
    found = toxicity.segments(hits)
    assert max(s for *_, s in found) == pytest.approx(best[0])
    assert (0, 3, pytest.approx(3.5)) in found and (30, 31, 1.0) in found and (41, 42, 4.0) in found


def test_remembered_parts_are_bounded_and_change_no_ids(monkeypatch):
    with open(MODEL, "rb") as file:
        model = file.read()
    draw = random.Random(8)
    texts = ["".join(draw.choice("aeinrst ,.éß日▁\n") for _ in range(80)) for _ in range(60)]
    want = [list(pieces.PieceTransducer(model).encode(text)) for text in texts]
    monkeypatch.setattr(pieces, "MEMORY", 7)
    monkeypatch.setattr(pieces, "JOINTS", 11)
    own = pieces.PieceTransducer(model)
    for text, ids in zip(texts, want, strict=True):
        assert list(own.encode(text)) == ids
        assert len(own.memory) <= 7 and len(own.older) <= 7
    # plain bytes hold less than arrays, and are joined as they are
    assert all(type(ids) is bytes for ids in [*own.memory.values(), *own.older.values()])


def test_parts_end_where_no_piece_joins_two_characters(monkeypatch):
    with open(MODEL, "rb") as file:
        model = file.read()
    own = pieces.PieceTransducer(model)
    asked, path = [], own.shortest_path
    monkeypatch.setattr(own, "shortest_path", lambda part: asked.append(part) or path(part))
    pairs = {t[i : i + 2] for t in own.ids for i in range(len(t) - 1)}
    texts = [f"oneadtha{mark} ñandenheit{mark}" for mark in ("", ",", ".", "###", "ñß", "日")]
    for text in texts:
        assert own.encode(text).tolist() == [own.ids[p] for p in own.merged(own.normalise(text))]
    # what is before a mark that no piece joins to it is looked for once, not once with every mark
    assert len(asked) == len(set(asked))
    assert all(part[i : i + 2] in pairs for part in asked for i in range(len(part) - 1))


def test_steps_and_shared_kinds_of_characters_change_no_ids(monkeypatch):
    with open(MODEL, "rb") as file:
        model = file.read()
    draw = random.Random(9)
    texts = ["".join(draw.choice("aeinrst ,.éß日😀▁\n") for _ in range(draw.randint(0, 90))) for _ in range(80)]
    texts += ["", None, "a" * 100, " " * 50, "", None]
    plain = pieces.PieceTransducer(model)
    want = [list(plain.encode(text)) for text in texts]
    for step, kinds in ((1, 2_048), (7, 2_048), (50, 3), (1_000_000, 2)):
        monkeypatch.setattr(pieces, "STEP", step)
        monkeypatch.setattr(pieces, "CHARACTERS", kinds)
        own = pieces.PieceTransducer(model)
        assert own.encode_all(texts).to_pylist() == want
        assert own.encode_all([]).to_pylist() == [] and own.encode_all([None, ""]).to_pylist() == [[], []]
