"""Repair of conversations against ways spelled out one by one."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

from veilframe.llm import conversation_repair, queries

SCHEMA = "conv_id long, turn long, role string, text string"
FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def checksum(role, text):
    return hashlib.sha256(f"{len(role)}:{role}:{len(text)}:{text}".encode()).digest()[:16]


def in_order(rows, damage):
    """The rows of each conversation after damage, in order."""
    found = {}
    for conv, turn, role, text in rows:
        mine = found.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        times = 1
        if damage:
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(name.encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            times = {0: 0, 3: 2}.get(kind, 1)
        mine += [(turn, role, text)] * times
    for mine in found.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], checksum(r[1], r[2])))
    return found


def faults(rows):
    seen, marks = set(), []
    for _, role, text in rows:
        last = text.rstrip(" \t\n\v\f\r")[-1:]
        mark = "b" if not last else "d" if (role, text) in seen else "t" if last not in ".!?" else ""
        seen.add((role, text))
        marks.append(mark)
    return marks


def edit(rows, marks, audit):
    """Cost and rows after an audit, None if it does not apply."""
    state, cost, at, out = "", 0, 0, []
    for letter in audit:
        if letter == "I":
            state, cost = NEXT[state], cost + 3
            out.append(f"{NAME[state]}:")
            continue
        _, role, text = rows[at]
        mark, at = marks[at], at + 1
        if letter == "D":
            cost += 4
            continue
        if mark in ("b", "d"):
            return None
        cost += 3 * (mark == "t")
        if letter == "K":
            if not (role[:1] == "s" and state == "" or role[:1] == NEXT[state]):
                return None
            state = role[0]
        else:
            state, cost, role = NEXT[state], cost + 3, NAME[NEXT[state]]
        out.append(f"{role}:{text}")
    return (cost, out) if at == len(rows) and state in ("", "a") else None


def spelled_out(rows, marks):
    """The best audit by trying all with up to two inserts in a gap."""
    gaps = ["", "I", "II"]
    best = None
    for parts in itertools.product([g + e for g in gaps for e in "DKR"], repeat=len(rows)):
        for end in gaps:
            audit = "".join(parts) + end
            found = edit(rows, marks, audit)
            if found and (best is None or (found[0], audit) < best):
                best = (found[0], audit)
    return best


def by_tuples(rows, marks):
    """The best audit by (cost, letters) from the end."""

    def inserts(best):
        best = dict(best)
        for _ in range(3):
            for q in NEXT:
                cost, letters = best[NEXT[q]]
                best[q] = min(best[q], (cost + 3, "I" + letters))
        return best

    far = (10**9, "")
    best = inserts({"": (0, ""), "a": (0, ""), "s": far, "u": far})
    for (_, role, _), mark in zip(reversed(rows), reversed(marks), strict=True):
        then = {}
        for q in NEXT:
            ways = [(best[q][0] + 4, "D" + best[q][1])]
            if mark not in ("b", "d"):
                more = 3 * (mark == "t")
                first = role[:1]
                if first == "s" and q == "" or first == NEXT[q]:
                    ways.append((best[first][0] + more, "K" + best[first][1]))
                ways.append((best[NEXT[q]][0] + 3 + more, "R" + best[NEXT[q]][1]))
            then[q] = min(ways)
        best = inserts(then)
    return best[""]


def brute(rows, damage=True):
    found = {}
    for conv, mine in in_order(rows, damage).items():
        marks = faults(mine)
        cost, audit = by_tuples(mine, marks)
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        lines = "\n".join(edit(mine, marks, audit)[1])
        found[conv] = (
            gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit,
            hashlib.sha256(lines.encode()).hexdigest(),
        )
    return found


def results(df):
    rows = df.collect()
    found = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in rows}
    assert len(found) == len(rows)
    return found


def strange(seed, n, hot=None):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "", None, "tool", "User", "user", "assistant"]
    texts = [None, "", " \n", "Hi.", "Yes", "No!  ", "é?", "\xa0", " "]
    rows = []
    for _ in range(n):
        conv = draw.choice([None, hot, hot, draw.randrange(60)] if hot is not None else [None, *range(60)])
        turn = draw.choice([None, *range(-3, 10)]) if conv != hot else draw.randrange(-50, 10**6)
        text = draw.choice([*texts, str(draw.random()) + draw.choice(".!x")])
        rows.append((conv, turn, draw.choice(roles), text))
    return rows


def test_tables_of_ways_against_all_audits():
    draw = random.Random(1)
    for _ in range(150):
        rows = [(i, draw.choice(["user", "assistant", "system", "x"]), draw.choice(["a.", "b", "", "c!"])) for i in range(draw.randrange(1, 4))]
        marks = faults(rows)
        table = conversation_repair.block_table(
            [
                (conversation_repair.INITIAL.get(r[1][:1], -1), m in ("b", "d"), m == "t")
                for r, m in zip(rows, marks, strict=True)
            ]
        )
        assert conversation_repair.best_of(table) == spelled_out(rows, marks) == by_tuples(rows, marks)


def test_joined_tables_equal_one_table():
    draw = random.Random(2)
    for n in (2, 9, 40):
        rows = [(draw.randrange(-1, 4), draw.random() < 0.2, draw.random() < 0.2) for _ in range(n)]
        rows = [(-1 if r[0] == 0 else r[0], *r[1:]) for r in rows]
        whole = conversation_repair.block_table(rows)
        parts = [conversation_repair.block_table(rows[i : i + 3]) for i in range(0, n, 3)]
        assert conversation_repair.joined(parts) == whole
        assert conversation_repair.joined([conversation_repair.joined(parts[:1]), *parts[1:]]) == whole


def test_special_rows(spark):
    rows = strange(3, 900)
    assert results(conversation_repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(rows, False)
    damaged = conversation_repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(4), damage=True)
    assert results(damaged) == brute(rows)


def test_hot_conversation_over_many_partitions(spark):
    rows = strange(4, 2500, hot=7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = results(conversation_repair.repair(df, damage=True))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == brute(rows)
    assert len(found[7][6]) > 800


def test_lost_conversations_empty_tables_and_clashing_columns(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, gone, "user", "Hi.", "x", 1)], f"{SCHEMA}, audit string, n int")
    found = results(conversation_repair.repair(df, damage=True))
    assert found == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    empty = conversation_repair.repair(spark.createDataFrame([], SCHEMA), damage=True)
    assert empty.columns == ["conv_id", *FIELDS] and empty.count() == 0


def test_large_keys_stay_exact(spark):
    rows = [(2**60 + 1, 2**61 + 1, "user", "Hi."), (2**60 + 1, None, "user", "Ho."), (None, 1, "user", "x")]
    assert results(conversation_repair.repair(spark.createDataFrame(rows, SCHEMA))) == brute(rows, False)


def test_query(spark, sf_dir):
    rows = queries.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()
    assert results(queries.op12_conversation_repair(spark, sf_dir)) == brute([tuple(r) for r in rows])
