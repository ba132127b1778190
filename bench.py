"""Headline queries, timed: prints one JSON line.

``BENCH_SF_DIR``  input folder, ``BENCH_CPUS``  local cores, ``BENCH_RUNS``  timed runs,
``BENCH_QUERIES``  names to run instead of the default list.

Every query is planned and forced with the ``noop`` sink: one warm-up, then the
median of the timed runs.  The ``build_`` times are single runs of the jobs that
write the tables later jobs read (statistics of both collections, hours, routed
items, sentence scores, sentences of judged documents), so the cost of all those
tables is part of the total.  So is ``ingest``: the given tables are files of one
row group, which only one core can read; they are first written again in a file
for each core, as any ingest would.

``shuffle_mb`` are the bytes that a build or one run of a query shuffles.
``growth`` compares the heaviest queries with one run over the folder
``BENCH_SMALL_DIR`` (ten times less by default), if there is one.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from chronorank import get_session
from chronorank.plans import jobs
from chronorank.plans.corpus import Corpus
from chronorank.shared import new_path

HEADLINE = [
    "collection_stats",
    "word_count",
    "kl_scores",
    "kl_scores_routed",
    "rank_docs",
    "route",
    "route_scores",
    "rm3_model",
    "rm3_rerank",
    "rm3_rerank_shallow",
    "sentence_scores",
    "sentence_dump",
    "match_vs_nonmatch",
    "trec_export",
]


HEAVIEST = ["route", "rm3_rerank", "sentence_scores", "sentence_dump"]
BUILDS = ("stats_table", "external_stats", "date_bins", "stored", "out", "pooled")
TABLES = ("documents", "events", "benchmark", "labels", "pages", "conversations")


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = jobs.queries()
    verbose = bool(os.environ.get("BENCH_VERBOSE"))

    given, folder = folder, new_path(spark, "bench-input")
    small = os.environ.get("BENCH_SMALL_DIR", "/root/testdata/sf0.01")

    def shuffled() -> float:
        """MB shuffled so far."""
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite() / 1e6

    def ingest(source: str, target: str) -> None:
        for name in TABLES:
            table = spark.read.parquet(f"{source}/{name}.parquet")
            table.repartition(int(cpus)).write.parquet(f"{target}/{name}.parquet")

    def force(name: str, source: str) -> None:
        registered[name](spark, source).write.format("noop").mode("overwrite").save()

    seconds: dict[str, float] = {}
    shuffle_mb: dict[str, float] = {}

    def measure(name: str, action) -> float:
        before, took = shuffled(), timed(action)
        shuffle_mb[name] = round(shuffled() - before, 1)
        if verbose:
            print(name, took, shuffle_mb[name], file=sys.stderr, flush=True)
        return took

    spark.read.parquet(f"{given}/documents.parquet").write.format("noop").mode("overwrite").save()
    seconds["ingest"] = measure("ingest", lambda: ingest(given, folder))
    corpus = Corpus(spark, folder)
    for table in BUILDS:
        name = f"build_{table.removesuffix('_table')}"
        seconds[name] = measure(name, getattr(corpus, table))
    for name in names:
        force(name, folder)
        seconds[name] = statistics.median(measure(name, lambda: force(name, folder)) for _ in range(runs))
    growth: dict[str, float] = {}
    if os.path.isdir(small) and os.path.realpath(small) != os.path.realpath(given):
        less = new_path(spark, "bench-small")
        ingest(small, less)
        for table in BUILDS:
            getattr(Corpus(spark, less), table)()
        growth = {name: round(seconds[name] / timed(lambda: force(name, less)), 2) for name in HEAVIEST if name in seconds}
    print(
        json.dumps(
            {
                "metric": "total of median query times and one build of the written tables",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "shuffle_mb": shuffle_mb,
                "growth": growth,
                "sf": os.path.basename(given.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
