"""Main text of web pages: structure of the page, and differences from the page with the nearest URL."""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronorank.llm.urls import host_and_path

#: Pages of a range of neighbouring URLs, about, and ranges at most.
RANGE_ROWS, RANGES = 500, 4_096
#: Pages that are drawn for each border of a range, so that ranges are about even.
DRAWN = 8
#: A page that shares more of its open lines than this with its neighbour is a copy of it and keeps them.
COPY = 0.8

#: What a line is: part of the article, of the page's frame, or neither.
ARTICLE, FRAME, OPEN = 1, 2, 0

# fixed values: elements of HTML by their role
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe object svg canvas xmp noembed noframes".split())
FRAMES = frozenset("nav footer aside form head title menu dialog button select label fieldset search".split())
MAIN = frozenset(("article", "main"))
CLOSED_BY_BLOCK = "p"
#: Elements that are removed like frames, but that a page's article may lie in.
WRAPPERS = frozenset(("form", "fieldset"))
#: Elements of a text; in an article their names tell what they are about, unless they are adverts.
TEXTS = frozenset(
    "a b blockquote caption code dd dt em figcaption figure h1 h2 h3 h4 h5 h6 i li p pre q span strong td th tr".split()
)
#: Names in class, id or role that mark the frame of a page.
FRAME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies dialog disqus footer gdpr header masthead menu modal nav navbar navigation "
    "newsletter notice popup promo promoted recommended related search share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget".split()
)
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising promo promoted sponsor sponsored".split())
#: Of these, what lists other articles, and what answers to one.
LISTINGS = ADVERTS | frozenset(("recommended", "related", "widget"))
ANSWERS = frozenset(("comment", "comments", "disqus"))
#: Of these, what the head of an article may be called.
HEADS = frozenset(("banner", "header", "masthead"))
#: A name that begins with one of these tells what its element has beside it, or has not.
LAYOUT = frozenset("has hide is no show with without".split())

#: How firm a frame is: an article or main in a soft one is the page's, in a
#: listing it is that if the page has no other, and in a hard one it never is.
NONE, SOFT, LISTING, HARD = range(4)
#: An article in a listing, until the whole page is known.
LISTED = 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<",
    re.S,
)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[^a-z]+")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def page_lines(source: str | None) -> tuple[list[str], list[int]]:
    """The lines of a page and what each one is by the page's structure.

    A line is the text between two borders of block elements, with character
    references decoded and white space turned into single blanks.  Elements are
    frames by what they are, or by their names.  A name alone never removes an
    article, a main element or the headline of an article; see ``_frame_of``.
    """
    lines: list[str] = []
    kinds: list[int] = []
    held: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name, frame it is in, ARTICLE or LISTED if it is in one
    source = source or ""

    def flush() -> None:
        if held:
            line = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if line:
                frame, article = stack[-1][1:] if stack else (NONE, OPEN)
                lines.append(line)
                kinds.append(LISTED if frame == LISTING and article == LISTED else FRAME if frame else article)

    at = 0
    while at < len(source):
        token = _TOKEN.match(source, at)
        if token is None:
            break
        at = token.end()
        name = token.group(2)
        if name is None:
            text = token.group()
            if text[0] != "<" or text == "<":
                held.append(text)
            continue
        name = name.lower()
        if token.group(1):
            if name in BLOCKS:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    flush()
                    del stack[i:]
                    break
            continue
        if name in RAW:
            if not token.group(3).endswith("/"):
                end = _RAW_END[name].search(source, at)
                at = end.end() if end else len(source)
            continue
        if name in BLOCKS:
            flush()
            if stack and stack[-1][0] == CLOSED_BY_BLOCK:
                stack.pop()
        elif name == "br":
            held.append(" ")
        if name in VOID:
            continue
        frame, article = stack[-1][1:] if stack else (NONE, OPEN)
        main = name in MAIN
        own = _frame_of(name, token.group(3), article) if frame != HARD else NONE
        if main and not own and frame:
            # of the page, or one of those that a listing has
            frame, article = (NONE, ARTICLE) if frame == SOFT and not article else (LISTING, LISTED)
        elif main and not own:
            article = article or ARTICLE
        elif article == LISTED and own:
            frame = HARD
        elif frame == SOFT and article and name == "h1":
            frame = NONE
        else:
            frame = max(frame, own)
        if name in BLOCKS or frame:
            if frame:
                flush()
            stack.append((name, frame, article))
    flush()
    listed = FRAME if ARTICLE in kinds else ARTICLE
    return lines, [listed if k == LISTED else k for k in kinds]


def _frame_of(name: str, attributes: str, article: int) -> int:
    """How firm a frame an element is by itself; ``article`` tells if it is in one."""
    if name in ("html", "body"):
        return NONE
    if name in WRAPPERS:
        return SOFT
    if name in FRAMES or (name == "header" and not article):
        return HARD
    marks = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower().split() if attributes else ()
    found: set[str] = set()
    for mark in marks:
        words = [w for w in _WORDS.split(mark) if w]
        if not words or words[0] in LAYOUT:
            continue
        if name in MAIN:  # the name of a whole article tells what it has, but for one that is an answer
            found |= ANSWERS & {words[-1]}
        elif article and name in TEXTS:
            found |= ADVERTS & {mark}
        else:
            found |= FRAME_NAMES & set(words)
    if article:
        found -= HEADS
    if found & ANSWERS:
        return HARD
    return LISTING if found & LISTINGS else SOFT if found else NONE


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of two lists of hashed lines."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places = defaultdict(list)
    for j in range(len(b) - tail - 1, head - 1, -1):
        places[b[j]].append(j)
    ends: list[int] = []  # least end in b of a common subsequence of each length
    links: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in places.get(a[i], ()):
            at = bisect_left(ends, j)
            link = (i, links[at - 1] if at else None)
            if at == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[at], links[at] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(head), *middle[::-1], *range(len(a) - tail, len(a))]


def _hashed(lines: list[str], kinds: list[int]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(x) >> 1 for x, k in zip(lines, kinds, strict=True) if k != ARTICLE]


def _article(lines: list[str], kinds: list[int]) -> int | None:
    """One hash for all lines of the article; none without an article."""
    own = [x for x, k in zip(lines, kinds, strict=True) if k == ARTICLE]
    return xxhash.xxh3_64_intdigest("\n".join(own)) >> 1 if own else None


def extract_text(pages: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """page_id, url, text, lines, shared of every row of ``pages`` (page_id, url, html).

    Pages are sorted by host and path; each one's partner is the next page of
    its host, or the one before for the last.  The lines outside of the article
    are aligned with the partner's by longest common subsequence, and shared
    ones are deleted.  What is left is the article, and lines that neither
    belong to an article nor to a known part of the frame.  A page whose open
    lines are nearly all shared, and whose article, if any, is the partner's, is
    a copy of it: the page before is its partner then, and if it is a copy of
    that as well, it keeps its open lines.  So do pages without a partner.

    ``text`` joins the lines left by one newline; ``lines`` and ``shared`` count
    those of the page and the deleted ones.  Null pages have an empty text.
    Repeated rows are partners like others.  Ranges are cut at some of the
    pages themselves, which also end the range before, and the last page of that
    begins the next one; so any number of pages of a host, or of one URL, is
    spread, and the cuts don't show in the results.
    """
    host, path = host_and_path(F.col("url"))
    place = F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0")
    rows = pages.select(
        F.col("page_id").cast("long"), "url", "html", host.alias("host"), F.concat_ws("\u0001", host, path, place).alias("place")
    )
    count = rows.count()
    wanted = min(RANGES, count // range_rows)
    some = rows.where(F.pmod(F.xxhash64("place"), F.lit(max(1, count))) < DRAWN * wanted).select("place").distinct()
    # about DRAWN * RANGES short strings at most
    cuts = sorted(r["place"].encode() for r in some.limit(2 * DRAWN * RANGES).collect())[DRAWN - 1 :: DRAWN]
    kind = (
        "to int, ends boolean, place string, page_id long, url string, host string, lines array<string>, "
        "kinds array<int>, outside array<bigint>, article bigint, content string"
    )

    def last_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[int, bytes] = {}
        for batch in batches:
            for where in map(str.encode, batch["place"]):
                to = bisect_right(cuts, where)
                last[to] = max(where, last.get(to, b""))
        if last:
            yield pd.DataFrame({"to": list(last), "place": [x.decode() for x in last.values()]})

    lasts: dict[int, bytes] = {}
    if cuts:
        found = rows.select("place").mapInPandas(last_places, "to int, place string").groupBy("to").agg(F.max("place").alias("place"))
        lasts = {r["to"]: r["place"].encode() for r in found.collect()}

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = defaultdict(list)

            def put(**values) -> None:
                for k, v in values.items():
                    out[k].append(v)

            for page, url, source, at, where in zip(*(batch[c] for c in ("page_id", "url", "html", "host", "place")), strict=True):
                lines, kinds = page_lines(source)
                outside, article = _hashed(lines, kinds), _article(lines, kinds)
                to = bisect_right(cuts, where.encode())
                content = xxhash.xxh3_128_hexdigest(source or "")
                own = dict(place=where, page_id=page, host=at, outside=outside, article=article, content=content)
                put(to=to, ends=False, url=url, lines=lines, kinds=kinds, **own)
                if to and cuts[to - 1] == where.encode():
                    put(to=to - 1, ends=True, url=None, lines=[], kinds=[], **own)
                if to < len(cuts) and lasts[to] == where.encode():
                    put(to=to + 1, ends=True, url=None, lines=[], kinds=[], **own)
            frame = pd.DataFrame(dict(out))
            yield frame.astype({"page_id": "Int64", "article": "Int64"}) if len(frame) else frame

    parsed = rows.mapInPandas(parse, kind)
    parsed = parsed.repartition(len(cuts) + 1, "to").sortWithinPartitions("to", "place", "page_id", "content")
    return parsed.mapInPandas(_difference, "page_id long, url string, text string, lines long, shared long")


def _difference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    before = row = None
    for batch in batches:
        done = []
        for after in batch.itertuples(index=False):
            if row is not None and not row.ends:
                done.append(_main_text(row, _partners(before, row, after)))
            before, row = row, after
        if done:
            yield _results(done)
    if row is not None and not row.ends:
        yield _results([_main_text(row, _partners(before, row, None))])


def _partners(before, row, after) -> list:
    return [x for x in (after, before) if x is not None and x.to == row.to and x.host == row.host and row.host]


def _main_text(row, partners) -> tuple:
    kinds, outside = np.asarray(row.kinds, int), [int(x) for x in row.outside]
    is_open, (places,) = kinds == OPEN, np.nonzero(kinds != ARTICLE)
    has_article = len(places) < len(kinds)
    deleted = np.zeros(len(kinds), bool)
    for partner in partners:
        deleted = np.zeros(len(kinds), bool)
        deleted[places[shared_lines(outside, [int(x) for x in partner.outside])]] = True
        same = not has_article or (pd.notna(partner.article) and row.article == partner.article)
        if not same or (deleted & is_open).sum() <= COPY * max(1, is_open.sum()):
            break
        deleted &= ~is_open
    left = (kinds == ARTICLE) | (is_open & ~deleted)
    text = "\n".join(line for line, stays in zip(row.lines, left, strict=True) if stays)
    return row.page_id, row.url, text, len(kinds), int(deleted.sum())


def _results(done: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(done, columns=["page_id", "url", "text", "lines", "shared"])
    return out.astype({"page_id": "Int64"})
