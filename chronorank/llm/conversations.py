"""Repair of conversation structure by weighted interval parsing.

The language of good conversations is ``(s?(ua)+)?`` over the initials of the
roles.  Its grammar in Chomsky normal form has a nonterminal for each pair of
states ``p``, ``q``: the texts that lead from ``p`` to ``q``, with the rules
``pq -> pr rq``.  A cell holds, for each nonterminal, the least (cost, audit) of
the edits that turn the rows of a span into such a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronorank.llm.common import neighbours, small_side
from chronorank.shared import materialize

# Costs of the edits, and what keeping a truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing read, system read, user read, assistant read; where a conversation may end.
STATES, FINAL = 4, (0, 3)
STEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
LEGAL = ("su", "ua", "au")
#: Rows of a span that is parsed as one; longer ones are joined from their halves.
SPAN_ROWS = 8
#: Rows of a conversation that a task takes whole, and of a piece of a longer one.
WHOLE_ROWS = 1_024
#: Pieces of a conversation that one round joins.
FAN_IN = 16

WHITE = " \t\n\x0b\x0c\r"
#: A cell: least (cost, audit) by (from, to).
Cell = dict[tuple[int, int], tuple[int, str]]


def _least(cell: Cell, pq: tuple[int, int], value: tuple[int, str]) -> None:
    if pq not in cell or value < cell[pq]:
        cell[pq] = value


def joined(left: Cell, right: Cell) -> Cell:
    """The rules ``pq -> pr rq`` for two adjacent spans.

    Audits of one span and cost are never the start of one another, as a longer
    one would have further insertions; so the least parts make the least whole.
    """
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(STATES):
            if (r, q) in right:
                more, rest = right[r, q]
                _least(out, (p, q), (cost + more, audit + rest))
    return out


def _insertions() -> Cell:
    """Closure of the empty span under insertions of user and assistant rows."""
    cell: Cell = {(p, p): (0, "") for p in range(STATES)}
    for (initial, p), q in STEPS.items():
        if initial != "s":
            _least(cell, (p, q), (INSERT, "I"))
    while (wider := joined(cell, cell)) != cell:
        cell = wider
    return cell


EMPTY = _insertions()


@lru_cache(maxsize=None)
def row_cell(symbol: str) -> Cell:
    """A row, with what may be inserted around it.

    ``symbol`` is ``x`` for a row that must go; else the initial of its role (or
    ``o``), in upper case if the row is truncated.  There are nine of them.
    """
    cell: Cell = {(p, p): (DELETE, "D") for p in range(STATES)}
    if symbol != "x":
        more = TRUNCATED if symbol.isupper() else 0
        for (initial, p), q in STEPS.items():
            if initial != "s":
                _least(cell, (p, q), (REROLE + more, "R"))
            if initial == symbol.lower():
                _least(cell, (p, q), (more, "K"))
    return joined(joined(EMPTY, cell), EMPTY)


@lru_cache(maxsize=50_000)
def span_cell(symbols: str) -> Cell:
    """Cell of the rows ``symbols``, of which there are at most ``SPAN_ROWS``; all splits of all spans, by length."""
    n = len(symbols)
    cells = {(i, i + 1): row_cell(s) for i, s in enumerate(symbols)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell: Cell = {}
            for k in range(i + 1, i + length):
                for pq, value in joined(cells[i, k], cells[k, i + length]).items():
                    _least(cell, pq, value)
            cells[i, i + length] = cell
    return cells[0, n] if n else EMPTY


def parse(symbols: str) -> Cell:
    """Cell of any number of rows.

    As nonterminals are pairs of states, a span's cell comes from any one split
    of it; so longer spans are joined in a balanced way, level by level.
    """
    cells = [span_cell(symbols[at : at + SPAN_ROWS]) for at in range(0, len(symbols), SPAN_ROWS)]
    return _reduced(cells)


def _reduced(cells: list[Cell]) -> Cell:
    while len(cells) > 1:
        pairs = [joined(*cells[at : at + 2]) for at in range(0, len(cells) - 1, 2)]
        cells = pairs + cells[len(cells) - len(cells) % 2 :]
    return cells[0] if cells else EMPTY


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(cell[0, q] for q in FINAL if (0, q) in cell)


class Repair:
    """Repaired ``role:text`` lines of a conversation, hashed row by row."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0
        self.digest = hashlib.sha256()
        self.first = True

    def _line(self, role: str, text: str, initial: str) -> None:
        self.state = STEPS[initial, self.state]
        line = f"{role}:{text}" if self.first else f"\n{role}:{text}"
        self.first = False
        self.digest.update(line.encode("utf-8", "replace"))

    def _made(self, text: str) -> None:
        role = "assistant" if self.state == 2 else "user"
        self._line(role, text, role[0])

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._made("")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._line(role, text, role[:1])
        elif edit == "R":
            self._made(text)

    def sha256(self) -> str:
        self._insert()
        return self.digest.hexdigest()


def _or_space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after damage.

    The remainder by 20 of the CRC-32 of ``conv_id:turn`` says what happens: 0
    drops the row, 1 empties its text, 2 takes its full stops, exclamation and
    question marks, 3 repeats it, 4 makes it the user's.  Nulls are read as a
    space; ``conv_id`` and ``turn`` themselves stay null.
    """
    kind = F.pmod(F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn"))), F.lit(20))
    rows = conversations.select("conv_id", "turn", _or_space("role").alias("role"), _or_space("text").alias("text"), kind.alias("kind"))
    rows = rows.where("kind != 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return rows.drop("copy")


def _symbol() -> Column:
    """What a row is to the grammar, before duplicates are known (see ``row_cell``)."""
    trimmed = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    whole = F.substring(trimmed, -1, 1).isin(".", "!", "?")
    return F.when(trimmed == "", "x").when(whole, initial).otherwise(F.upper(initial))


#: A conversation's key and the order of its rows, both without nulls.
KEY = ["no_id", "conv_id"]
ORDER = ["has_turn", "turn", "role", "text"]
REPORT = (
    "no_id boolean, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def _rows(conversations: DataFrame) -> DataFrame:
    return damaged(conversations).select(
        F.col("conv_id").isNull().alias("no_id"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("conv_id"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")).alias("turn"),
        "role",
        "text",
        _symbol().alias("symbol"),
    )


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _gaps(turns: list[int]) -> int:
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reports of conversations whose rows stand together, in order."""
    for rows in neighbours(batches, KEY):
        if not len(rows):
            continue
        no_id, conv_id = (rows[name].to_numpy() for name in KEY)
        heads = np.flatnonzero(np.r_[True, (conv_id[1:] != conv_id[:-1]) | (no_id[1:] != no_id[:-1])])
        turns = [turn if known else None for known, turn in zip(rows["has_turn"].tolist(), rows["turn"].tolist(), strict=True)]
        lines = list(zip(rows["role"], rows["text"], rows["symbol"], strict=True))
        out = []
        for start, end in zip(heads.tolist(), [*heads[1:].tolist(), len(rows)], strict=True):
            talk = lines[start:end]
            seen: set[tuple[str, str]] = set()
            symbols, duplicate = "", 0
            for role, text, symbol in talk:
                again = symbol != "x" and (role, text) in seen
                seen.add((role, text))
                duplicate += again
                symbols += "x" if again else symbol
            cost, audit = cheapest(parse(symbols))
            repair = Repair(audit)
            for role, text, _ in talk:
                repair.row(role, text)
            blank = sum(symbol == "x" for _, _, symbol in talk)
            truncated = sum(map(str.isupper, symbols))
            out.append(
                (
                    no_id[start], conv_id[start], _gaps([t for t in turns[start:end] if t is not None]), blank, duplicate,
                    truncated, _illegal([role[:1] for role, _, _ in talk]), cost, audit, repair.sha256(),
                )
            )
        yield pd.DataFrame(out, columns=[field.split()[0] for field in REPORT.split(", ")])


def repair_conversations(conversations: DataFrame, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``conversations`` (conv_id, turn, role, text) are damaged first (``damaged``).
    Rows stand in the order of their turns, null ones first; rows of one turn by
    role, then text.  A row's fault is blank, duplicate (role and text stood
    before) or truncated.  ``cost`` and ``audit`` are those of the cheapest
    edits, the first in ASCII of equally cheap ones, and ``repaired_sha256``
    tells the text they make.  Faults, ``gaps`` and ``illegal`` adjacent pairs are
    counted before the repair.

    Null ids are one conversation.  A conversation without rows, as damage may
    leave it, has zeros, an empty audit and the hash of the empty text; an empty
    table has no conversations.  Other columns are ignored.

    Conversations of up to ``whole_rows`` rows are parsed by the task that gets
    them.  Longer ones are cut into pieces by position, wherever these lie; a
    cell for each piece is joined with its neighbours' in rounds.  Only their
    audit (a value of the result) and the running hash meet in one task, which
    streams their rows.
    """
    rows = _rows(conversations)
    long = rows.groupBy(*KEY).count().where(F.col("count") > whole_rows).select(*KEY)
    long = materialize(long, "long_conversations")
    hint = small_side(long)
    short = rows.join(hint, KEY, "left_anti").repartition(*KEY).sortWithinPartitions(*KEY, *ORDER)
    reports = short.mapInPandas(_whole, REPORT)
    if not long.isEmpty():
        reports = reports.unionByName(_repair_long(rows.join(hint, KEY, "left_semi"), whole_rows))
    given = conversations.select(
        F.col("conv_id").isNull().alias("no_id"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("conv_id")
    ).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return given.join(reports, KEY, "left").select(
        F.when(~F.col("no_id"), F.col("conv_id")).alias("conv_id"),
        *(F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


# conversations of any length

CELL = "pq array<int>, cost array<long>, audit array<string>, first string, last string, illegal long"
PIECE = ["no_id", "conv_id", "part", "block"]
PIECE_SCHEMA = f"no_id boolean, conv_id long, part long, block long, {CELL}"


def _packed(cell: Cell) -> tuple[list[int], list[int], list[str]]:
    return [p * STATES + q for p, q in cell], [cost for cost, _ in cell.values()], [audit for _, audit in cell.values()]


def _unpacked(pq: list[int], cost: list[int], audit: list[str]) -> Cell:
    return {divmod(int(at), STATES): (int(c), a) for at, c, a in zip(pq, cost, audit, strict=True)}


def _parse_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for piece in rows.itertuples(index=False):
            initials = list(piece.initials)
            cell = _packed(parse("".join(piece.symbols)))
            out.append((*piece[:4], *cell, initials[0], initials[-1], _illegal(initials)))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in PIECE_SCHEMA.split(", ")])


def _join_pieces(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
    pieces = pieces.sort_values("block")
    cells = [_unpacked(*packed) for packed in zip(pieces["pq"], pieces["cost"], pieces["audit"], strict=True)]
    borders = zip(pieces["last"], pieces["first"].iloc[1:], strict=False)
    illegal = int(pieces["illegal"].sum()) + sum(a + b not in LEGAL for a, b in borders)
    row = (*key, *_packed(_reduced(cells)), pieces["first"].iat[0], pieces["last"].iat[-1], illegal)
    return pd.DataFrame([row], columns=[f.split()[0] for f in PIECE_SCHEMA.split(", ")])


def _joined_blocks(pieces: DataFrame, name: str) -> DataFrame:
    """One piece for each conversation and part, from rounds that join up to ``FAN_IN`` adjacent blocks."""
    pieces = materialize(pieces, name)
    while pieces.agg(F.max("block")).first()[0] > 0:
        wider = F.floor(F.col("block") / FAN_IN).alias("wider")
        grouped = pieces.groupBy(*KEY, "part", wider)
        pieces = materialize(grouped.applyInPandas(_join_pieces, PIECE_SCHEMA), name)
    return pieces


def _hash_repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes of repaired conversations, row by row; the first row of each has its audit."""
    key, repair = None, None
    for rows in batches:
        out = []
        for no_id, conv_id, role, text, audit in zip(*(rows[c] for c in [*KEY, "role", "text", "audit"]), strict=True):
            if audit is not None:
                if repair:
                    out.append((*key, repair.sha256()))
                key, repair = (no_id, conv_id), Repair(audit)
            repair.row(role, text)
        yield pd.DataFrame(out, columns=[*KEY, "repaired_sha256"])
    if repair:
        yield pd.DataFrame([(*key, repair.sha256())], columns=[*KEY, "repaired_sha256"])


def _repair_long(rows: DataFrame, piece_rows: int) -> DataFrame:
    rows = materialize(rows, "long_rows")  # ranges are sampled from the stored rows
    placed = rows.repartitionByRange(*KEY, *ORDER).sortWithinPartitions(*KEY, *ORDER)
    placed = materialize(placed.withColumn("seq", F.monotonically_increasing_id()), "long_placed")
    # lengths keep role and text apart
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("same")
    narrow = placed.select(*KEY, "has_turn", "turn", "symbol", "seq", F.substring("role", 1, 1).alias("initial"), same)
    first = narrow.where("symbol != 'x'").groupBy(*KEY, "same").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    narrow = narrow.join(first.where("n > 1").drop("n"), [*KEY, "same"], "left").withColumns(
        {
            "blank": (F.col("symbol") == "x").cast("long"),
            "duplicate": F.coalesce((F.col("symbol") != "x") & (F.col("seq") > F.col("first")), F.lit(False)).cast("long"),
        }
    )
    narrow = narrow.withColumn("symbol", F.when(F.col("duplicate") == 1, "x").otherwise(F.col("symbol")))
    narrow = materialize(narrow.drop("same", "first"), "long_symbols")
    turn = F.when(F.col("has_turn"), F.col("turn"))
    reports = narrow.groupBy(*KEY).agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"),
        F.sum("blank").alias("blank"),
        F.sum("duplicate").alias("duplicate"),
        F.sum(F.col("symbol").isin("S", "U", "A", "O").cast("long")).alias("truncated"),
        F.min("seq").alias("seq"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("seq", "symbol", "initial")))
    position = F.col("seq").bitwiseAND(F.lit((1 << 33) - 1))
    pieces = narrow.groupBy(
        *KEY, F.shiftright("seq", 33).alias("part"), F.floor(position / piece_rows).alias("block")
    ).agg(ordered.alias("rows"))
    pieces = pieces.select(*PIECE, F.col("rows.symbol").alias("symbols"), F.col("rows.initial").alias("initials"))
    # blocks of a part count from the part's beginning, so that a conversation's first may be any
    pieces = _joined_blocks(pieces.mapInPandas(_parse_pieces, PIECE_SCHEMA), "long_blocks")
    parts = pieces.withColumns({"block": F.col("part"), "part": F.lit(0).cast("long")})
    cells = _joined_blocks(parts, "long_parts")
    # from state 0, the number of a nonterminal is the state it ends in
    ends = F.filter(F.arrays_zip("pq", "cost", "audit"), lambda c: c["pq"].isin(*FINAL))
    best = F.array_min(F.transform(ends, lambda c: F.struct(c["cost"].alias("cost"), c["audit"].alias("audit"))))
    reports = reports.join(cells.select(*KEY, "illegal", best.alias("best")), KEY)
    reports = materialize(reports.select("*", "best.cost", "best.audit").drop("best"), "long_reports")
    streams = placed.select(*KEY, "seq", "role", "text").join(reports.select(*KEY, "seq", "audit"), [*KEY, "seq"], "left")
    streams = streams.repartition(*KEY).sortWithinPartitions(*KEY, "seq").select(*KEY, "role", "text", "audit")
    hashes = streams.mapInPandas(_hash_repaired, "no_id boolean, conv_id long, repaired_sha256 string")
    return reports.drop("seq").join(hashes, KEY)
