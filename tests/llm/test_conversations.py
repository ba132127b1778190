"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from chronorank.llm import conversations as C

GOOD = re.compile(r"(s?(ua)+)?")


def symbols_of(rows):
    """Fault of each row, by definition."""
    out, seen = [], set()
    for role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def brute(rows):
    """Cheapest (cost, audit) and text, from a shortest-path search that tries every edit at every place."""
    faults = symbols_of(rows)

    def alive(initials):
        return any(GOOD.fullmatch(initials + rest) for rest in ("", "a", "ua"))

    queue = [(0, "", 0, "", ())]
    done = set()
    while queue:
        cost, audit, at, initials, text = heapq.heappop(queue)
        if at == len(rows) and GOOD.fullmatch(initials):
            return cost, audit, "\n".join(text)
        # what follows depends on the state only, which the last two initials and emptiness tell
        state = (at, initials[-1:], len(initials) > 1 or initials[:1] == "u")
        if state in done:
            continue
        done.add(state)
        for role in ("user", "assistant"):
            if alive(initials + role[0]):
                heapq.heappush(queue, (cost + 3, audit + "I", at, initials + role[0], (*text, f"{role}:")))
        if at < len(rows):
            role, line = rows[at]
            more = 3 if faults[at] == "truncated" else 0
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, initials, text))
            if faults[at] not in ("blank", "duplicate"):
                if alive(initials + role[:1]) and role[:1] in ("s", "u", "a"):
                    heapq.heappush(queue, (cost + more, audit + "K", at + 1, initials + role[0], (*text, f"{role}:{line}")))
                for other in ("user", "assistant"):
                    if alive(initials + other[0]):
                        heapq.heappush(queue, (cost + 3 + more, audit + "R", at + 1, initials + other[0], (*text, f"{other}:{line}")))
    raise AssertionError


def damage(rows):
    """(conv_id, turn, role, text) after damage, in order."""
    out = []
    for conv_id, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv_id, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv_id, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def report(conv_id, rows):
    rows = damage(rows)
    lines = [(role, text) for _, _, role, text in rows]
    faults = symbols_of(lines)
    turns = [t for _, t, _, _ in rows if t is not None]
    cost, audit, text = brute(lines)
    return (
        conv_id,
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(lines)),
        cost,
        audit,
        hashlib.sha256(text.encode()).hexdigest(),
    )


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    return sorted((report(conv_id, own) for conv_id, own in groups.items()), key=repr)


def test_cells_against_search():
    draw = random.Random(1)
    for _ in range(3000):
        n = draw.randrange(9)
        rows = [(draw.choice(["system", "user", "assistant", "tool", ""]), draw.choice(["a.", "b.", "c", " ", "d!"])) for _ in range(n)]
        letters = []
        for (role, _), fault in zip(rows, symbols_of(rows), strict=True):
            letter = role[:1] if role[:1] in ("s", "u", "a") and role else "o"
            letters.append("x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
        cost, audit, text = brute(rows)
        assert C.cheapest(C.parse("".join(letters))) == (cost, audit)
        repair = C.Repair(audit)
        for row in rows:
            repair.row(*row)
        assert repair.sha256() == hashlib.sha256(text.encode()).hexdigest()


def test_any_split_gives_the_cell(monkeypatch):
    draw = random.Random(2)
    for _ in range(300):
        symbols = "".join(draw.choice("xsuaoSUAO") for _ in range(draw.randrange(2, 9)))
        cut = draw.randrange(1, len(symbols))
        assert C.joined(C.parse(symbols[:cut]), C.parse(symbols[cut:])) == C.span_cell(symbols)


def given(draw, conversations, longest):
    rows = []
    for conv_id in range(conversations):
        turn = 0
        for _ in range(draw.randrange(1, longest)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = draw.choice(["yes.", "no!", "why?", "cut off", "", " \t\n", None, "tail. \x0b\x0c", f"row {turn}.", "ü é."])
            rows.append((conv_id, turn, role, text))
            turn += draw.choice([0, 1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("whole_rows", [1024, 6])
def test_table_against_search(spark, whole_rows):
    draw = random.Random(4)
    # turns that repeat, null turns and ids, and one conversation with a third of the rows
    rows = given(draw, 60, 12)
    rows += [(None, t, "user", "hm") for t in (1, None, 3)] + [(70, None, "user", "a."), (70, None, "assistant", "b.")]
    rows += [(71, t, ("assistant", "user")[t % 2], f"line {t % 90}{'.' * (t % 3)}") for t in range(150)]
    rows += [(72, 10**18, "user", "far."), (72, -(10**18), "system", "near.")]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert found(C.repair_conversations(df, whole_rows)) == expected(rows)


def test_given_table(spark, folder):
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert found(C.repair_conversations(table)) == expected(rows)


def test_dropped_empty_and_clashing(spark):
    gone = next(i for i in itertools.count() if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    names = "no_id has_turn symbol kind seq part block same first last cost audit copy"
    df = spark.createDataFrame(
        [(gone, 0, "user", "x.", *names.split())],
        "conv_id long, turn long, role string, text string, " + ", ".join(f"{n} string" for n in names.split()),
    )
    got = C.repair_conversations(df)
    assert got.columns == COLUMNS
    assert found(got) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert C.repair_conversations(df.limit(0)).collect() == []


def test_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 300_000 + "."), (1, 1, "assistant", " " * 500_000 + "end")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(C.repair_conversations(df)) == expected(rows)
