"""Faults, cheapest edits and repaired rows against plain searches."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from segmint.llm import conversation_repair as cr

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def moves(codes):
    """Least (cost, audit) of all edits from each row to the end, so strings
    are compared whole. Three inserts at one place never pay."""

    def ok(tail, role):
        return {"": role in "su", "s": role == "u", "u": role == "a", "a": role == "u"}[tail]

    after = {}  # (tail, inserts) -> least (cost, audit) from the next row on
    for i in range(len(codes), -1, -1):
        now = {}
        for inserts in (2, 1, 0):
            for tail in ("", "s", "u", "a"):
                found = [(0, "")] if i == len(codes) and tail in ("", "a") else []
                if inserts < 2:
                    found += [(now[role, inserts + 1][0] + 5, "I" + now[role, inserts + 1][1]) for role in "ua" if ok(tail, role)]
                if i < len(codes):
                    initial, must, cut = codes[i]
                    edits = [("D", 2, tail)]
                    if not must:
                        edits += [("K", 5 * cut, initial)] if initial in ("s", "u", "a") and ok(tail, initial) else []
                        edits += [("R", 1 + 5 * cut, role) for role in "ua" if ok(tail, role)]
                    found += [(after[to, 0][0] + cost, edit + after[to, 0][1]) for edit, cost, to in edits]
                now[tail, inserts] = min(found, default=(10**9, "~"))
        after = now
    return after["", 0]


def code(initial, must, cut):
    return {"s": 1, "u": 2, "a": 3}.get(initial, 0) + (4 if must else 8 if cut else 0)


def test_cheapest_and_least_edits_of_short_conversations():
    kinds = [(r, False, c) for r in "suax" for c in (False, True)] + [("u", True, False)]
    cases = [c for n in range(4) for c in itertools.product(kinds, repeat=n)]
    rng = random.Random(1)
    cases += [tuple(rng.choice(kinds) for _ in range(rng.randrange(4, 40))) for _ in range(1500)]
    for case in cases:
        rows = [({"s": "system", "u": "user", "a": "assistant", "x": "tool"}[r], f"t{k}") for k, (r, _, _) in enumerate(case)]
        audit, cost, out = cr.repair_rows(bytes(code(*c) for c in case), rows)
        assert (cost, audit) == moves(case), case
        assert LEGAL.match("".join(r[0] for r, _ in out))
        assert [t for _, t in out if t] == [t for (_, t), e in zip(rows, audit.replace("I", "")) if e != "D"]


def test_segments_chain_to_the_same_repair(spark, monkeypatch):
    """Cut anywhere, into segments of any number, the repair is the same."""
    rng = random.Random(2)
    rows, expected = [], {}
    for conv in range(60):
        case = [(rng.choice("suuaax"), rng.random() < 0.1, rng.random() < 0.2) for _ in range(rng.randrange(1, 60))]
        expected[conv] = moves(tuple(case))
        for turn, (r, must, cut) in enumerate(case):
            role = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}[r]
            rows.append((conv, turn, role, " " if must else f"text {turn}" + ("" if cut else "."), 1))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int")
    for size in (1, 3, 20_000):
        monkeypatch.setattr(cr, "SEGMENT_ROWS", size)
        got = {r["conv_id"]: (r["cost"], r["audit"]) for r in cr.digests(cr.repair(cr.faults(df))).collect()}
        assert got == expected


def test_tree_stays_small_where_states_agree():
    search = cr.Survivors()
    held = out = 0
    for k in range(20_000):
        out += len(search.push(2 + k % 2))
        held = max(held, search.held)
    assert held < 30 and out > 19_990
    # all rows must go: the edits of one state are the start of the others'
    search = cr.Survivors()
    for _ in range(5000):
        search.push(4)
    assert search.held < 30


def brute(rows):
    """(conv_id, turn, role, text) rows -> digest rows of the contract."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        convs[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = []
    for conv, items in convs.items():
        items.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, case, counts = set(), [], [0, 0, 0]
        for _, role, text in items:
            bare = text.strip(" \t\n\x0b\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            case.append((role[:1], fault in (0, 1), fault == 2))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(items, items[1:]))
        turns = {t for t, _, _ in items if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = moves(tuple(case))
        names, tail, left, lines = {"u": "user", "a": "assistant"}, "", iter(items), []
        for e in audit:
            row = next(left) if e != "I" else None
            if e == "D":
                continue
            tail = row[1][0] if e == "K" else "a" if tail == "u" else "u"
            lines.append((row[1] if e == "K" else names[tail]) + ":" + (row[2] if row else ""))
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [2, 20_000])
def test_conversations_against_a_plain_search(spark, monkeypatch, size):
    monkeypatch.setattr(cr, "SEGMENT_ROWS", size)
    rng = random.Random(3)
    texts = ["Yes.", "No", "Why?", " ", "", None, "long text. with\nlines!\n ", "ok.", "é…", "\t\n"]
    roles = ["user", "assistant", "assistant", "user", "system", "tool", None, "", "sam", "Unknown"]
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randrange(0, 14)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(roles), rng.choice([*texts, f"t{turn}.", f"u{turn}."])))
    rows += rows[:40] + [(7000, t, "user", "hi.") for t in (5, 5, 5, None, None)] + [(7001, None, "system", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, copies string")
    assert got(cr.repair_conversations(df.repartition(3))) == brute(rows)


def test_one_conversation_over_many_tasks(spark, monkeypatch, request):
    monkeypatch.setattr(cr, "SEGMENT_ROWS", 50)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    request.addfinalizer(lambda: spark.conf.set(key, "true"))
    spark.conf.set(key, "false")  # the table is small; range partitions stay apart
    rows = [(1, t, "user" if t % 3 else "assistant", f"m{t % 400}.") for t in range(3000)] + [(2, 0, "user", "a" * 3_000_000), (2, 1, "assistant", "b.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    parts = cr.repair(cr.faults(cr.damage(df)))
    assert parts.where("conv_id = 1").select("part").distinct().count() > 1
    assert got(cr.repair_conversations(df)) == brute(rows)
    lines = [f"{r['role']}:{r['text']}" for r in cr.repaired_rows(parts).where("conv_id = 1").orderBy("place").collect()]
    assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == next(r[-1] for r in brute(rows) if r[0] == 1)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair_conversations(df).collect() == []
