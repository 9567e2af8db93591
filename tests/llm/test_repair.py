import hashlib
import heapq
import random
import re
import zlib

from plebis.llm import repair

COLUMNS = "conv_id long, turn long, role string, text string"


def cheapest(codes, accept=True):
    """Uniform-cost search over whole edit strings, written apart from the operator."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, letters, i, s = heapq.heappop(heap)
        if i == len(codes) and s in (0, 3):
            return cost, letters
        if (i, s) in done:
            continue
        done.add((i, s))
        heapq.heappush(heap, (cost + 2, letters + "I", i, 3 if s == 2 else 2))
        if i < len(codes):
            c = codes[i]
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, s))
            if c != "X":
                extra = c.isupper()
                heapq.heappush(heap, (cost + 2 + extra, letters + "R", i + 1, 3 if s == 2 else 2))
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, c.lower()))
                if to:
                    heapq.heappush(heap, (cost + extra, letters + "K", i + 1, to))


def expected(rows):
    """The contract for one conversation's rows, before damage."""
    out = []
    for conv, turn, role, text in rows:
        blank = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
    seen, codes, faults = set(), "", []
    for _, role, text in out:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        who = role[:1] if role[:1] in ("s", "u", "a") else "o"
        codes += "X" if fault in ("blank", "duplicate") else who.upper() if fault else who
        faults.append(fault)
    cost, audit = cheapest(codes)
    lines, i, before = [], 0, ""
    for letter in audit:
        role, text = ("", "") if letter == "I" else out[i][1:]
        i += letter != "I"
        if letter == "D":
            continue
        if letter in "IR":
            role = "assistant" if before[:1] == "u" else "user"
        lines.append(f"{role}:{text}")
        before = role
    turns = [t for t, _, _ in out if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(out, out[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def compared(spark, rows, tmp_path, name="conversations"):
    spark.createDataFrame(rows, COLUMNS).write.mode("overwrite").parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in repair.op11_repair(spark, str(tmp_path)).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    for conv, own in by.items():
        assert got[conv] == expected(own), conv
    return got


def test_search_against_uniform_cost():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 5, 8, 12, 20, 40] * 25:
        codes = "".join(rng.choices("suaoUAX", (1, 8, 8, 1, 1, 1, 3), k=n))
        assert repair.edits(codes, 0, None) == cheapest(codes), codes
        if n:
            way = repair.piece(codes)
            assert min((w[0] + repair.TAIL[q][0], w[1] + repair.TAIL[q][1]) for q in range(4) if (w := way[q])) == cheapest(codes), codes


def test_blocks_of_long_conversations():
    rng = random.Random(2)
    for n in (49, 200, 1000):
        codes = "".join(rng.choices("uasUAoX", (8, 8, 1, 1, 1, 1, 2), k=n))
        assert repair.whole(codes) == cheapest(codes)


def test_conversations_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 14)):
            role = rng.choice(["user", "assistant"] * 5 + ["system", "tool", "", None, "unit"])
            text = rng.choice(["Yes.", "No", "A long answer!", " \t", "", None, "Why?\n", "é🙂.", f"text {rng.randint(0, 9)}. "])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    compared(spark, rows + rows[:40], tmp_path)


def test_a_long_conversation_over_many_ranges(spark, tmp_path):
    rng = random.Random(4)
    hot = [(7, t, "user" if t % 2 else "assistant", rng.choice([f"turn {t}.", "again."])) for t in range(3000)]
    same = [(9, 1, "user", "copy.")] * 2500
    rest = [(100 + k, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for k in range(200) for t in range(6)]
    got = compared(spark, hot + same + rest, tmp_path)
    assert got[9][2] >= 2499 and len(got[7][6]) > 2500


def test_empty_and_odd_tables(spark, tmp_path):
    assert compared(spark, [], tmp_path) == {}
    rows = [(1, None, None, None), (2, 5, "user", "a."), (2, -5, "assistant", "b.")]
    compared(spark, rows, tmp_path)
    wide = spark.createDataFrame([(1, 1, "user", "hello.", "x", 5)], COLUMNS + ", conv string, part int")
    report, turns = repair.repair(wide)
    assert report.collect()[0]["audit"] == "KI" and sum(t.count() for t in turns) == 2
