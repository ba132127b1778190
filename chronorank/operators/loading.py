"""The load job: routes items, stores them, and keeps rejected ones with a reason."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronorank.functions import ids as I
from chronorank.operators import routing as R
from chronorank.operators.matching import tokens_of, topic_matcher
from chronorank.operators.stats import CollectionStats
from chronorank.operators.topics import Topics
from chronorank.shared import fits, materialize, side
from chronorank.sources.items import FILE_BYTES, plan_slots, write_items

# Why an item is not stored.
NO_BODY, NO_TEXT, TOO_LARGE = "no body", "no text", "too large"
REJECTED = ["stream_id", "source", "n_bytes", "reason"]


def item_bytes(items: DataFrame) -> Column:
    """Bytes of all values of an item; nested ones count in their JSON form."""
    sizes = []
    for field in items.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("struct", "array", "map"):
            sizes.append(F.octet_length(F.to_json(field.name)))
        elif kind in ("string", "binary"):
            sizes.append(F.octet_length(field.name))
        else:
            sizes.append(F.lit(8))
    return sum((F.coalesce(size, F.lit(0)) for size in sizes), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Loader:
    """Everything items are routed by, prepared once.

    ``match`` is an expression, so an item keeps its row while it is routed: no
    join brings items and topics, or items and their routes, together.
    """

    match: Callable[[Column], Column]
    date_bins: DataFrame
    small_bins: bool
    limit: int = R.SIZE_LIMIT
    file_bytes: int = FILE_BYTES

    def judged_items(self, items: DataFrame) -> DataFrame:
        """Items as they come, timed and judged by all of their values."""
        timed = R.item_times(items).withColumn("clean_visible", F.col("body.clean_visible"))
        return self.judged(timed, F.col("body").isNotNull(), item_bytes(items))

    def judged(self, items: DataFrame, has_body: Column, n_bytes: Column, text: str = "clean_visible") -> DataFrame:
        """Items with ``n_bytes`` and ``reason``, which is null for those to be stored.

        An item without body, without visible text, or of ``limit`` bytes or
        more is rejected, for the first of these reasons.
        """
        empty = F.coalesce(F.length(text), F.lit(0)) == 0
        reason = F.when(~has_body, NO_BODY).when(empty, NO_TEXT).when(F.col("n_bytes") >= self.limit, TOO_LARGE)
        return items.withColumn("n_bytes", n_bytes.cast("long")).withColumn("reason", reason)

    def routed(self, judged: DataFrame, text: str = "clean_visible") -> DataFrame:
        """Judged and timed items with ``query_id``, ``date_bin`` and ``rowkey``; all null for rejected ones.

        An item without timestamp or with an unknown hour goes to bin -1.
        """
        kept = F.col("reason").isNull()
        best = self.match(tokens_of(text))[0]["query_id"]
        matched = judged.withColumn("query_id", best).withColumn("query_id", F.when(kept, F.col("query_id")))
        binned = matched.join(side(self.date_bins, self.small_bins), "hour", "left")
        return binned.withColumn("date_bin", F.when(kept, F.coalesce("bin", F.lit(-1)))).drop("bin").withColumn(
            "rowkey", I.row_key(F.col("query_id"), F.col("date_bin"), F.col("stream_id"))
        )

    def load(
        self,
        routed: DataFrame,
        path: str,
        rejected: str | None = None,
        mode: str = "errorifexists",
        finish: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    ) -> None:
        """Store routed items below ``path`` and the narrow rows of rejected ones below ``rejected``.

        Items are routed in one pass, into a table that holds both kinds apart.
        Sizes of its (query, hour) cells give the files; then accepted items
        move once, straight to theirs, and ``finish`` derives the rest there.
        """
        both = materialize(routed.withColumn("accepted", F.col("reason").isNull()), "routed-items", ("accepted",))
        if rejected:
            both.where(~F.col("accepted")).select(*REJECTED).write.mode(mode).parquet(rejected)
        self.place(both.where("accepted").drop("accepted", "reason"), path, mode, finish)

    def place(
        self,
        accepted: DataFrame,
        path: str,
        mode: str = "errorifexists",
        finish: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    ) -> None:
        """Move a written table of accepted items, with ``n_bytes``, to the files below ``path``."""
        placement = plan_slots(accepted.select("query_id", "date_bin", "n_bytes"), self.file_bytes)
        write_items(accepted.drop("n_bytes"), path, mode, placement, finish)


def make_loader(topics: Topics, stats: CollectionStats, date_bins: DataFrame, **settings: int) -> Loader:
    return Loader(topic_matcher(topics, stats, 1, "route"), date_bins, fits(date_bins), **settings)


def load_items(
    items: DataFrame,
    topics: Topics,
    stats: CollectionStats,
    date_bins: DataFrame,
    path: str,
    rejected: str | None = None,
    mode: str = "errorifexists",
    **settings: int,
) -> None:
    """Load items as they come from chunks (``stream_id``, ``stream_time``, ``source``, ``body``, ...)."""
    loader = make_loader(topics, stats, date_bins, **settings)
    loader.load(loader.routed(loader.judged_items(items)), path, rejected, mode)
