"""Operator 11: conversation structure repair.

Every conversation is edited into role initials ``(s?(ua)+)?`` at the least cost, ties
to the sequence of edits that comes first in ASCII order.  ``edits`` is the search:
iterative-deepening A*, that is, a depth-first search that tries Delete, Insert, Keep and
Rerole in this order under rising cost bounds, guided by what the rest must cost at
least, with a table of the states that failed and the budget they failed with;
the first accepting path is the answer.

A conversation may be longer than a task can hold.  Rows are therefore dealt by ranges of
(conversation, turn), so that a long one spans many tasks.  What lies wholly within a
range is searched on the spot.  Of the first and the last conversation of each range
(``plan``) a task tells, for each pair of the grammar's states before and after its piece,
the cheapest cost and which of the ends comes first in ASCII order; ``choose`` picks the
ends along the pieces, of which a conversation has at most one a range.  Pieces are put together
from searches over ``BLOCK`` rows in the same way, so that a search stays small.  A block never
ends with an insertion: so none of its edit strings begins another, and the first in order of the whole is the
first in each block.

Defined results.  Null role and text are one space, null conversation ids are one
conversation, null turns come first.  Rows of one turn are ordered by a digest of role and
text, so that repeated rows stand next to each other; all but the first are duplicates.  A role
that begins with neither s, u nor a fits nowhere.  Texts of rows that must go are not
carried along.  An empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plebis.llm.common import durable, table

SPACE = " \t\n\x0b\x0c\r"
#: Rows of one search, when states before and after have to be tried.
BLOCK = 16
#: Rows of one search from the start of a conversation to its end.
WHOLE = 256
#: Repeated rows are written out in steps of so many.
STEP = 1000
FAR = 1 << 60

# States of the grammar: 0 nothing yet, 1 after s, 2 after u, 3 after a.
STATES = range(4)
USER_NEXT, ACCEPTS = (True, True, False, True), (0, 3)
#: Cost and letters that lead from a state to the end of a conversation.
TAIL = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
#: What a state has seen last, and the neighbours that are not in the grammar ($: the end,
#: 2 and 3: an end in that state).
LAST = "^sua"
CLASH = {x + y for x in LAST for y in "sua$23"} - {"^s", "^u", "^$", "su", "ua", "au", "a$", "u2", "a3"}


def step(state: int, letter: str, code: str) -> tuple[int, int] | None:
    """State and cost after an edit.  A row's code: X must go; else its role's initial, or
    o, as a capital letter if it is truncated."""
    if letter == "D":
        return state, 3
    if letter == "I":
        return (2 if USER_NEXT[state] else 3), 2
    if code == "X":
        return None
    extra = 1 if code.isupper() else 0
    if letter == "R":
        return (2 if USER_NEXT[state] else 3), 2 + extra
    who = code.lower()
    if who == "s" and state == 0:
        return 1, extra
    if who == ("u" if USER_NEXT[state] else "a"):
        return (2 if who == "u" else 3), extra
    return None


def edits(codes: str, start: int, goal: int | None) -> tuple[int, str] | None:
    """The cheapest edits of ``codes`` from ``start``, ASCII-least: to an accepting state
    (goal None; insertions may follow the last row) or to state ``goal`` by a last edit
    that uses up the last row."""
    rest = _least(codes, goal)
    if goal is not None and goal not in _reached(codes, start):
        return None
    bound = rest[0][start]
    while True:
        found, bound = _within(codes, start, goal, rest, bound)
        if found is not None:
            return found


def _least(codes: str, goal: int | None) -> list[list[int]]:
    """For each row and state a cost that the rest takes at least: of each row its own, and an
    edit more for each of the neighbours that cannot both stay as they are, each row counted
    in one pair at most."""
    n = len(codes)
    if goal in (0, 1):  # nothing leads back there, so that one row at most may stay
        return [[3 * (n - i) - 3 * (s < goal and i < n) for s in STATES] for i in range(n + 1)]
    own, pairs, after, first = [0] * (n + 1), [0] * (n + 2), [0] * (n + 1), ["$" if goal is None else str(goal)] * (n + 1)
    for i in range(n - 1, -1, -1):
        c = codes[i]
        own[i] = own[i + 1] + (3 if c == "X" else 2 * (c in "oO") + c.isupper())
        if c == "X":
            pairs[i], after[i], first[i] = pairs[i + 1], after[i + 1], first[i + 1]
        else:
            first[i], after[i] = c.lower(), pairs[i + 1]
            pairs[i] = max(pairs[i + 1], (first[i] + first[i + 1] in CLASH) + after[i + 1])
    return [[own[i] + 2 * max(pairs[i], (LAST[s] + first[i] in CLASH) + after[i]) for s in STATES] for i in range(n + 1)]


def _within(codes: str, start: int, goal: int | None, rest: list[list[int]], bound: int) -> tuple[tuple[int, str] | None, int]:
    """One round: the first accepting path of at most ``bound``, or the next bound."""
    n, beyond = len(codes), FAR
    failed: dict[tuple[int, int], int] = {}  # (row, state): the largest budget it failed with
    path: list[tuple[int, int, int, Iterator[str], str]] = [(0, start, 0, iter("DIKR"), "")]
    while path:
        i, state, spent, letters, _ = path[-1]
        if i == n and (state in ACCEPTS if goal is None else state == goal):
            return (spent, "".join(x[4] for x in path)), bound
        ways = letters if i < n or goal is None else iter(())
        for letter in ways:
            if i == n and letter != "I":
                continue
            after = step(state, letter, codes[i] if i < n else "")
            if after is None:
                continue
            to, cost = after
            j = i if letter == "I" else i + 1
            total = spent + cost
            if total + rest[j][to] > bound:
                beyond = min(beyond, total + rest[j][to])
            elif failed.get((j, to), -1) < bound - total:
                path.append((j, to, total, iter("DIKR"), letter))
                break
        else:
            failed[i, state] = max(failed.get((i, state), -1), bound - spent)
            path.pop()
    return None, beyond


def _reached(codes: str, start: int) -> set[int]:
    at = {start}
    for code in codes:
        if at & {0, 1, 3}:
            at.add(2)
        if 2 in at:
            at.add(3)
            at.add(2)
        at = {to for s in at for x in "DKR" if (to := (step(s, x, code) or (None,))[0]) is not None}
    return at


Ends = tuple[tuple[int, str] | None, ...]


@lru_cache(maxsize=1 << 14)
def ends(codes: str) -> Ends:
    """For each state before and after (4 * before + after) the cheapest edits of a block."""
    return tuple(edits(codes, p, q) for p in STATES for q in STATES)


def onward(first: Ends, then: Ends) -> Ends:
    """Two neighbouring pieces as one."""
    out = []
    for p in STATES:
        for q in STATES:
            ways = [(a[0] + b[0], a[1], b[1]) for m in STATES if (a := first[4 * p + m]) and (b := then[4 * m + q])]
            best = min(ways, default=None)
            out.append(best and (best[0], best[1] + best[2]))
    return tuple(out)


def piece(codes: str) -> Ends:
    """``ends`` of any length: neighbouring blocks are put together pair by pair."""
    parts = [ends(codes[i : i + BLOCK]) for i in range(0, len(codes), BLOCK)]
    while len(parts) > 1:
        parts = [onward(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


@lru_cache(maxsize=1 << 14)
def _searched(codes: str) -> tuple[int, str]:
    return edits(codes, 0, None)


def whole(codes: str) -> tuple[int, str]:
    """The answer for a conversation: its cost and its edits."""
    if len(codes) <= WHOLE:
        return _searched(codes)
    way = piece(codes)
    return min((way[q][0] + TAIL[q][0], way[q][1] + TAIL[q][1]) for q in STATES if way[q])


def roles(letters: str, state: int, given: Iterator[str]) -> Iterator[tuple[str, str | None, str]]:
    """(letter, role, initial of the row) of each edit, from ``state``; ``given`` yields
    the initials of the rows.  Deleted rows have no role, kept ones keep theirs."""
    for letter in letters:
        who = "" if letter == "I" else next(given)
        name = None
        if letter in "IR":
            name = "user" if USER_NEXT[state] else "assistant"
            state = 2 if USER_NEXT[state] else 3
        elif letter == "K":
            state = {"s": 1, "u": 2, "a": 3}[who]
        yield letter, name, who


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The damage of the trial, by the checksum of ``conv:turn``; the four columns alone."""
    rows = rows.select(*[rows[c] for c in (conv, turn, role, text)])
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)]
    kind = F.crc32(F.concat_ws(":", *named)) % 20
    hurt = rows.select(
        conv,
        turn,
        F.when(kind == 4, "user").otherwise(F.coalesce(role, F.lit(" "))).alias(role),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(F.coalesce(text, F.lit(" ")), "[.!?]", "")).otherwise(F.coalesce(text, F.lit(" "))).alias(text),
        kind.alias("__kind"),
    ).where("__kind != 0")
    copies = F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hurt.withColumn("__copy", F.explode(copies)).drop("__kind", "__copy")


def ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with their first fault, dealt by ranges of conversation and turn and in order
    within: conv, turn, role, text, who (initial), fault, code, part and k (place in part)."""
    named = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    # Repeated rows meet as counts.
    merged = named.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    told = merged.withColumn("said", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    firsts = told.groupBy(F.col("conv").alias("c"), F.col("said").alias("s")).agg(F.min("turn").alias("first"), F.bool_or(F.col("turn").isNull()).alias("unplaced"))
    joined = told.join(firsts, told["conv"].eqNullSafe(firsts["c"]) & (told["said"] == firsts["s"]))
    later = F.when(F.col("unplaced"), F.col("turn").isNotNull()).otherwise(F.col("turn") != F.col("first"))
    steps = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / STEP)))
    within = F.explode(F.sequence(F.col("__step") * STEP, F.least(F.col("copies"), (F.col("__step") + 1) * STEP) - 1))
    each = joined.withColumn("__step", steps).withColumn("copy", within)
    bare = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(bare == "", "blank").when(later | (F.col("copy") > 0), "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    )
    initial = F.substring("role", 1, 1)
    who = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    gone = F.col("fault").isin("blank", "duplicate")
    judged = each.select("conv", "turn", "said", "copy", "role", "text", who.alias("who"), fault.alias("fault"))
    slim = judged.select(
        "conv", "turn", "said", "copy", "role", "who", "fault",
        F.when(gone, F.lit("")).otherwise(F.col("text")).alias("text"),
        F.when(gone, "X").when(F.col("fault") == "truncated", F.upper("who")).otherwise(F.col("who")).alias("code"),
    )
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "said", "copy"]
    dealt = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # the part above 33 bits, the place in it below
    return durable(dealt.select("conv", "turn", "role", "who", "fault", "text", "code", F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("k")))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], bool, bool]]:
    """The rows of each conversation of a part, and whether it is the part's first or last."""
    rows = (r for b in batches for r in b.to_pylist())
    held, first = None, True
    for _, run in groupby(rows, lambda r: r["conv"]):
        if held is not None:
            yield held, first, False
            first = False
        held = list(run)
    if held is not None:
        yield held, first, True


def _told(run: list[dict]) -> dict:
    """What a run of rows tells of its conversation."""
    turns = [r["turn"] for r in run if r["turn"] is not None]
    who = "".join(r["who"] for r in run)
    return {
        "conv": run[0]["conv"], "part": run[0]["part"], "k": run[0]["k"], "turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None),
        **{f: sum(r["fault"] == f for r in run) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(who[i : i + 2] not in ("su", "ua", "au") for i in range(len(who) - 1)), "head": who[0], "last": who[-1],
    }


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)


def _written(schema: pa.Schema, rows: Iterator[dict], most: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _types(rows: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def plan(rows: DataFrame) -> DataFrame:
    """Of every run of a conversation in a part: its counts, and either cost and audit
    (it lies wholly within) or, for each pair of states, cost, order and edits."""
    ddl, kind = _types(rows)
    schema = pa.schema([
        ("conv", kind), ("part", pa.int32()), ("k", pa.int64()), ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
        ("truncated", pa.int64()), ("illegal", pa.int64()), ("head", pa.string()), ("last", pa.string()), ("gaps", pa.int64()), ("open", pa.bool_()), ("cost", pa.int64()),
        ("audit", pa.string()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("audits", pa.list_(pa.string())), ("whos", pa.string()),
    ])

    def each(run: list[dict], at_edge: bool) -> dict:
        codes = "".join(r["code"] for r in run)
        told = _told(run) | {"open": at_edge}
        if not at_edge:
            cost, audit = whole(codes)
            return told | {"gaps": _gaps(told["low"], told["high"], told["turns"]), "cost": cost, "audit": audit}
        found = piece(codes)
        ranks = []
        for p in STATES:
            own = [x[1] if x else "~" for x in found[4 * p : 4 * p + 4]]
            ranks += [sorted(own).index(x) for x in own]
        return told | {"costs": [x[0] if x else FAR for x in found], "ranks": ranks, "audits": [x[1] if x else "" for x in found], "whos": "".join(r["who"] for r in run)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _written(schema, (each(r, first or last) for r, first, last in _runs(batches)))

    columns = "part int, k long, turns long, low long, high long, blank long, duplicate long, truncated long, illegal long, head string, last string, gaps long, open boolean, cost long, audit string, costs array<long>, ranks array<int>, audits array<string>, whos string"
    return rows.select("conv", "turn", "who", "fault", "code", "part", "k").mapInArrow(run, f"conv {ddl}, {columns}")


def choose(pieces: DataFrame) -> DataFrame:
    """Pieces of conversations that may span parts, at most two a part: the state before and
    after each on the way that is cheapest and first in order, and in the row of the
    first piece the counts of the conversation.  Only costs and orders are read here."""
    ddl, kind = _types(pieces)
    schema = pa.schema([
        ("conv", kind), ("part", pa.int32()), ("before", pa.int32()), ("after", pa.int32()), ("tail", pa.string()),
        *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    ])

    def solved(pieces: list[dict]) -> Iterator[dict]:
        left = [[TAIL[q][0] for q in STATES]]  # cost from each state to the end
        for x in reversed(pieces):
            left.append([min(x["costs"][4 * p + q] + left[-1][q] for q in STATES) for p in STATES])
        left.reverse()
        state, seen = 0, pieces[0]
        told = {c: sum(x[c] for x in pieces) for c in ("blank", "duplicate", "truncated", "illegal")}
        told["cost"] = left[0][0]
        told["illegal"] += sum(a["last"] + b["head"] not in ("su", "ua", "au") for a, b in zip(pieces, pieces[1:]))
        placed = [x for x in pieces if x["turns"]]
        distinct = sum(x["turns"] for x in placed) - sum(a["high"] == b["low"] for a, b in zip(placed, placed[1:]))
        told["gaps"] = _gaps(placed[0]["low"], placed[-1]["high"], distinct) if placed else 0
        for i, x in enumerate(pieces):
            least = left[i][state]
            to = min((q for q in STATES if x["costs"][4 * state + q] + left[i + 1][q] == least), key=lambda q: x["ranks"][4 * state + q])
            yield {"conv": x["conv"], "part": x["part"], "before": state, "after": to, "tail": TAIL[to][1] if i + 1 == len(pieces) else ""} | (told if x is seen else {})
            state = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        return _written(schema, (x for _, own in groupby(rows, lambda r: r["conv"]) for x in solved(list(own))))

    near = pieces.drop("audits", "audit", "whos").repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "part")
    return near.mapInArrow(run, f"conv {ddl}, part int, before int, after int, tail string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")


TURNS = "part int, k long, role string, text string"


def _turn_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("conv", kind), ("part", pa.int32()), ("k", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def within(rows: DataFrame) -> DataFrame:
    """The repaired turns of conversations that lie wholly within a part, in order."""
    ddl, kind = _types(rows)
    schema = _turn_schema(kind)

    def turns(run: list[dict]) -> Iterator[dict]:
        own = iter(run)
        r = run[0]
        for letter, name, _ in roles(whole("".join(x["code"] for x in run))[1], 0, (x["who"] for x in run)):
            if letter != "I":
                r = next(own)
            if letter != "D":
                yield {"conv": run[0]["conv"], "part": r["part"], "k": r["k"], "role": name or r["role"], "text": "" if letter == "I" else r["text"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        return _written(schema, (x for _, own in groupby(rows, lambda r: r["conv"]) for x in turns(list(own))))

    return rows.select("conv", "role", "text", "who", "code", "part", "k").mapInArrow(run, f"conv {ddl}, {TURNS}")


def across(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The repaired turns of conversations that may span parts, in order within each.
    Edits meet rows by conversation, part and place, so that a long one stays spread."""
    ddl, kind = _types(chosen)
    schema = pa.schema([("conv", kind), ("part", pa.int32()), ("k", pa.int64()), ("before", pa.list_(pa.string())), ("gone", pa.bool_()), ("name", pa.string()), ("after", pa.list_(pa.string()))])

    def spelled(r: dict) -> Iterator[dict]:
        k, before, held = r["k"], [], None
        for letter, name, _ in roles(r["audit"], r["before"], iter(r["whos"])):
            if letter == "I":
                before.append(name)
                continue
            if held:
                yield held
            held = {"conv": r["conv"], "part": r["part"], "k": k, "before": before, "gone": letter == "D", "name": name, "after": []}
            k, before = k + 1, []
        yield held | {"after": before}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _written(schema, (x for b in batches for r in b.to_pylist() for x in spelled(r)))

    edit = chosen.select("conv", "part", "k", "before", "audit", "whos").mapInArrow(run, f"conv {ddl}, part int, k long, before array<string>, gone boolean, name string, after array<string>")
    rows, edit = rows.alias("r"), edit.alias("e")
    met = rows.join(edit, F.col("r.conv").eqNullSafe(F.col("e.conv")) & (F.col("r.part") == F.col("e.part")) & (F.col("r.k") == F.col("e.k")))
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    own = F.when(F.col("gone"), F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(turn(F.coalesce("name", "r.role"), F.col("r.text"))))
    added = lambda c: F.transform(c, lambda x: turn(x, F.lit("")))
    spread = met.select(F.col("r.conv").alias("conv"), F.col("r.part").alias("part"), F.col("r.k").alias("k"), F.posexplode(F.concat(added("before"), own, added("after"))).alias("i", "t"))
    return spread.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "part", "k", "i").select("conv", "part", "k", "t.role", "t.text")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """Two results: a report of every conversation that has rows (conv, gaps, blank, duplicate,
    truncated, illegal, cost, audit), and the repaired turns (conv, part, k, role, text) as
    tables that are each in order within their partitions and share no conversation."""
    dealt = ordered(rows, conv, turn, role, text)
    pieces = durable(plan(dealt))
    edges = pieces.where("open")
    picks = durable(choose(edges))
    same = F.col("p.conv").eqNullSafe(F.col("c.conv")) & (F.col("p.part") == F.col("c.part"))
    chosen = edges.alias("p").join(picks.alias("c"), same).select(
        F.col("p.conv").alias("conv"), F.col("p.part").alias("part"), F.col("p.k").alias("k"), F.col("c.before").alias("before"),
        F.concat(F.get("p.audits", F.col("c.before") * 4 + F.col("c.after")), F.col("c.tail")).alias("audit"),
        F.col("p.whos").alias("whos"),
    )
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    parts = F.array_sort(F.collect_list(F.struct("part", "audit")))
    audits = chosen.groupBy("conv").agg(F.array_join(F.transform(parts, lambda x: x["audit"]), "").alias("audit"))
    told = picks.where(F.col("cost").isNotNull()).alias("t").join(audits.alias("a"), F.col("t.conv").eqNullSafe(F.col("a.conv")))
    spanning = told.select(F.col("t.conv").alias("conv"), *[F.col(f"t.{c}").alias(c) for c in counts], F.col("a.audit").alias("audit"))
    report = pieces.where("not open").select("conv", *counts, "audit").unionByName(spanning)
    # Two runs a part at most.
    at, d = F.broadcast(edges.select("conv", "part").alias("b")), dealt.alias("d")
    edge = F.col("d.conv").eqNullSafe(F.col("b.conv")) & (F.col("d.part") == F.col("b.part"))
    return report, [within(d.join(at, edge, "left_anti")), across(d.join(at, edge).select("d.*"), chosen)]


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, of turns that are in order within
    their partitions; a conversation flows by and is never held."""
    ddl, kind = _types(turns)
    schema = pa.schema([("conv", kind), ("repaired_sha256", pa.string())])

    def each(rows: Iterator[dict]) -> Iterator[dict]:
        for conv, own in groupby(rows, lambda r: r["conv"]):
            digest, lead = hashlib.sha256(), ""
            for r in own:
                digest.update(f"{lead}{r['role']}:{r['text']}".encode())
                lead = "\n"
            yield {"conv": conv, "repaired_sha256": digest.hexdigest()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _written(schema, each(r for b in batches for r in b.to_pylist()))

    return turns.select("conv", "role", "text").mapInArrow(run, f"conv {ddl}, repaired_sha256 string")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    report, (inside, spanning) = repair(damage(given))
    hashes = digests(inside).unionByName(digests(spanning))
    every = given.select(F.col("conv_id")).distinct().alias("g")
    joined = every.join(report.alias("r"), F.col("g.conv_id").eqNullSafe(F.col("r.conv")), "left").join(hashes.alias("h"), F.col("g.conv_id").eqNullSafe(F.col("h.conv")), "left")
    number = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(0)).cast("long").alias(c)
    return joined.select(
        "g.conv_id",
        *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("r.audit", F.lit("")).alias("audit"),
        F.coalesce("h.repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
