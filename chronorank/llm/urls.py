"""URL filter: rules by host and path, else the path-template tree of each host."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronorank.llm.common import small_side
from chronorank.shared import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: A segment is a branch of its own with this many pages.
BRANCH_PAGES = 10
#: Limits of ``URLS_SQL`` only: levels of its tree, and the share of its parent's pages that a branch has.
DEPTH, BRANCH_SHARE = 3, 0.05
#: Branches are similar if their blocked shares differ by less than a Hoeffding
#: bound that holds with this probability of error.
ALPHA = 0.05
#: Weight of the host's share in that of a template, and of all pages' in that of a host.
PRIOR = 5.0
#: A template is rejected if the smoothed share of its labelled pages that is pure (allowed) is below this.
LEAST_PURITY = 0.2

_BOUND = math.sqrt(0.5 * math.log(2 / ALPHA))
#: With fewer labelled pages than this no two parts of a node can be told apart.
_LEAST_LABELLED = math.floor(8 * _BOUND**2)
#: Levels after which the pages are written, so that plans of deep trees stay short.
_WRITTEN = 3


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null or without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER), F.regexp_extract(url, parts, 2)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits the host or one of its parents and the beginning of the path, as a struct."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _apart(l1: Column, b1: Column, l2: Column, b2: Column) -> Column:
    gap = F.abs(b1 / l1 - b2 / l2)
    return (l1 > 0) & (l2 > 0) & (gap >= _BOUND * (1 / F.sqrt(l1) + 1 / F.sqrt(l2)))


def _steps(branches: DataFrame, node: list[str]) -> DataFrame:
    """The step down the tree of every row of ``branches`` (node, segment, l, b), one for similar ones of a node.

    The branch with most labelled pages leads; those that can't be told apart
    from it join it, and the others go on in the same way.
    """
    left, groups = branches, None
    while not left.isEmpty():
        row = F.struct("l", "segment", "b")
        leads = left.groupBy(*node).agg(F.max(row).alias("lead"))
        met = left.join(small_side(materialize(leads, "leads")), node)
        apart = _apart(F.col("l"), F.col("b"), F.col("lead.l"), F.col("lead.b"))
        met = materialize(met.withColumn("apart", apart & (F.col("segment") != F.col("lead.segment"))), "met")
        found = met.where("not apart").select(*node, "segment", F.col("lead.segment").alias("lead"))
        groups = found if groups is None else groups.union(found)
        left = met.where("apart").select(*node, "segment", "l", "b")
    if groups is None:
        return branches.select(*node, "segment", F.lit("").alias("step"))
    sizes = groups.groupBy(*node, "lead").agg(F.count("*").alias("size"))
    # no path has a "#", so a segment that looks like a wildcard or a group is told from one
    own = F.concat(F.when(F.col("lead").rlike(r"\A(\*\z|\{)"), "/#").otherwise("/"), "lead")
    step = F.when(F.col("size") > 1, F.concat(F.lit("/{"), "lead", F.lit("}"))).otherwise(own)
    return groups.join(small_side(materialize(sizes, "sizes")), [*node, "lead"]).select(*node, "segment", step.alias("step"))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of ``pages`` (page_id, url).

    Pages that a rule fits have its verdict, and are the labelled ones.  The
    others have that of their template.  Templates grow from the host down: at
    each node, segments that are too rare to be branches become ``*``, and so do
    branches whose labelled pages are blocked about as often as their
    siblings'.  Branches of a node that are blocked about as often as one another
    are one, ``{a}`` for the one of them with most labelled pages; a segment that
    is ``*`` or begins with ``{`` itself is written with ``#`` before it.  This goes on
    down to the end of the longest path, or to where no node has the labels to
    branch.  A template's purity is the allowed share of its labelled pages,
    smoothed by that of its host, and this by that of all pages; with no
    labelled page at all everything is pure.

    Only counts are shuffled: pages are narrowed to host and path and meet
    tables of branches and templates.  Repeated rows count as often as they occur.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = rows.withColumns({"rule": F.col("found.rule"), "given": F.col("found.verdict"), "segments": segments})
    rows = rows.drop("found").withColumn("template", F.lit(""))
    labelled = F.col("given").isNotNull().cast("long")
    blocked = F.coalesce((F.col("given") == "block").cast("long"), F.lit(0))
    counts = [F.count("*").alias("n"), F.sum(labelled).alias("l"), F.sum(blocked).alias("b")]
    node, level = ["host", "template"], 0
    while True:
        rows = rows.withColumn("segment", F.coalesce(F.get("segments", F.lit(level)), F.lit("")))
        children = materialize(rows.groupBy(*node, "segment").agg(*counts), "branches")
        parents = children.groupBy(*node).agg(F.sum("n").alias("n0"), F.sum("l").alias("l0"), F.sum("b").alias("b0"))
        own = children.join(materialize(parents, "nodes"), node).where("segment <> ''")
        # below others, no label differs or there are too few
        own = materialize(own.where((F.col("b0") > 0) & (F.col("b0") < F.col("l0")) & (F.col("l0") >= _LEAST_LABELLED)), "own")
        if own.isEmpty():
            break
        apart = _apart(F.col("l"), F.col("b"), F.col("l0") - F.col("l"), F.col("b0") - F.col("b"))
        branches = materialize(own.where((F.col("n") >= BRANCH_PAGES) & apart).select(*node, "segment", "l", "b"), "branches")
        steps = small_side(materialize(_steps(branches, node), "steps"))
        rows = rows.join(steps, [*node, "segment"], "left")
        step = F.when(F.col("segment") == "", "").otherwise(F.coalesce("step", F.lit("/*")))
        rows = rows.withColumn("template", F.concat("template", step)).drop("step", "segment")
        level += 1
        if level % _WRITTEN == 0:
            rows = materialize(rows, "rows")
    below = F.greatest(F.size("segments") - level, F.lit(0))
    rows = rows.drop("segment").withColumn("template", F.concat("template", F.repeat(F.lit("/*"), below)))
    templates = materialize(rows.groupBy("host", "template").agg(*counts), "templates")
    hosts = templates.groupBy("host").agg(F.sum("l").alias("l0"), F.sum("b").alias("b0"))
    every = templates.agg(F.sum("l").alias("l"), F.sum("b").alias("b")).first()
    general = (every["b"] / every["l"]) if every["l"] else 0.0
    of_host = (F.col("b0") + PRIOR * general) / (F.col("l0") + PRIOR)
    purity = 1 - (F.col("b") + PRIOR * of_host) / (F.col("l") + PRIOR)
    judged = templates.join(materialize(hosts, "hosts"), "host").select("host", "template", purity.alias("purity"))
    rows = rows.join(small_side(materialize(judged, "templates")), ["host", "template"])
    verdict = F.coalesce("given", F.when(F.col("purity") < LEAST_PURITY, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def _level_sql(level: int) -> str:
    before, after = f"r{level}", f"r{level + 1}"
    return f"""
g{level} AS (SELECT *, coalesce(segments[{level + 1}], '') AS segment FROM {before}),
c{level} AS (
  SELECT host, template, segment, count(*) AS n, sum(l)::BIGINT AS l, sum(b)::BIGINT AS b FROM g{level} GROUP BY ALL),
p{level} AS (
  SELECT *, (sum(n) OVER w)::BIGINT AS n0, (sum(l) OVER w)::BIGINT - l AS lr, (sum(b) OVER w)::BIGINT - b AS br
  FROM c{level} WINDOW w AS (PARTITION BY host, template)),
k{level} AS (
  SELECT host, template, segment FROM p{level}
  WHERE n >= {BRANCH_PAGES} AND n >= {BRANCH_SHARE}::DOUBLE * n0 AND l > 0 AND lr > 0 AND segment <> ''
    AND abs(b::DOUBLE / l - br::DOUBLE / lr) >= {_BOUND!r}::DOUBLE * (1 / sqrt(l) + 1 / sqrt(lr))),
{after} AS (
  SELECT page_id, host, path, rule, given, segments, l, b, template ||
    CASE WHEN segment = '' THEN '' WHEN k{level}.host IS NOT NULL THEN '/' || segment ELSE '/*' END AS template
  FROM g{level} LEFT JOIN k{level} USING (host, template, segment))"""


def _rules_sql(of: str) -> str:
    cases = [
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') "
        f"THEN '{r.text if of == 'rule' else r.verdict}'"
        for r in sorted(RULES, key=lambda r: (len(r.text), r.text), reverse=True)
    ]
    return "CASE " + " ".join(cases) + " END"


#: ``judge_urls`` of ``pages`` with the default arguments, where no path is longer than ``DEPTH``, no branch
#: smaller than ``BRANCH_SHARE``, no segment written like a wildcard and no two branches of a node are similar, as in the given tables up to sf0.1.
URLS_SQL = rf"""
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
v AS (SELECT *, {_rules_sql("rule")} AS rule, {_rules_sql("verdict")} AS given FROM u),
r0 AS (
  SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments, '' AS template,
    (given IS NOT NULL)::BIGINT AS l, coalesce((given = 'block')::BIGINT, 0) AS b
  FROM v),{",".join(map(_level_sql, range(DEPTH)))},
t AS (
  SELECT host, template, sum(l)::BIGINT AS l, sum(b)::BIGINT AS b FROM r{DEPTH} GROUP BY ALL),
h AS (SELECT *, (sum(l) OVER w)::BIGINT AS l0, (sum(b) OVER w)::BIGINT AS b0,
  coalesce((sum(b) OVER ())::DOUBLE / nullif((sum(l) OVER ())::DOUBLE, 0), 0) AS general
  FROM t WINDOW w AS (PARTITION BY host)),
q AS (
  SELECT host, template, 1 - (b + {PRIOR}::DOUBLE * ((b0 + {PRIOR}::DOUBLE * general) / (l0 + {PRIOR}::DOUBLE))) /
    (l + {PRIOR}::DOUBLE) AS purity
  FROM h)
SELECT page_id, host, path, rule,
  coalesce(given, CASE WHEN purity < {LEAST_PURITY}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM r{DEPTH} JOIN q USING (host, template)
"""
