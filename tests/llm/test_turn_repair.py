"""Repair of conversations against a plain search over all states, and its edges."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loadlens.llm import turn_repair
from loadlens.llm.queries import op11_turn_repair

SPACES = " \t\n\v\f\r"


def cheapest(rows):
    """(cost, audit, lines) of rows (role, text, fault) by keeping the best edits of every state as text."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def offer(table, state, way):
        if state not in table or way[:2] < table[state][:2]:
            table[state] = way

    def inserts(table):
        for _ in range(3):
            for state, (cost, audit, lines) in list(table.items()):
                new = after[state][-1]
                role = {"u": "user", "a": "assistant"}[new]
                offer(table, new, (cost + 5, audit + "I", (*lines, f"{role}:")))
        return table

    for role, text, fault in rows:
        table = {}
        for state, (cost, audit, lines) in inserts(dict(best)).items():
            offer(table, state, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if role[:1] and role[:1] in after[state]:
                offer(table, role[0], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            for new in ("user", "assistant"):
                if new[0] in after[state]:
                    offer(table, new[0], (cost + 1 + more, audit + "R", (*lines, f"{new}:{text}")))
        best = table
    ends = inserts(dict(best))
    return min((ends[s] for s in ("", "a") if s in ends), key=lambda w: w[:2])


def plain_report(rows, ids):
    """The report of rows (conv_id, turn, role, text) that are already damaged."""
    out = {}
    for c in ids:
        mine = [(t, " " if r is None else r, " " if x is None else x) for i, t, r, x in rows if i == c]
        mine.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2]))
        seen, faults, marked = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in mine:
            body = text.strip(SPACES)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            marked.append((role, text, fault))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = cheapest(marked)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[c] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)
    return out


def plain_damage(rows):
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        lot = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if lot == 1:
            text = ""
        if lot == 2:
            text = re.sub("[.!?]", "", text)
        if lot == 4:
            role = "user"
        yield from [(c, t, role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def told(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_edits_against_all_ways():
    draw = random.Random(5)
    fault = {"x": "blank"}
    for _ in range(3000):
        kinds = "".join(draw.choice("xsuaoSUAOuaua") for _ in range(draw.randrange(0, 14)))
        name = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
        rows = [(name[k.lower()], "t", fault.get(k) or ("truncated" if k.isupper() else None)) for k in kinds]
        edits = "".join(turn_repair.edits_of(kinds + turn_repair.END))
        assert edits == cheapest(rows)[1], kinds


def test_a_long_conversation_meets_at_borders():
    draw = random.Random(6)
    kinds = "".join(draw.choice("xsuaoSUAOuauauaua") for _ in range(20_000))
    whole = turn_repair.edits_of(kinds + turn_repair.END)
    assert len(whole) == len(kinds) + 1
    # Costs across the halves add up to those across the whole.
    left, right = turn_repair.across(kinds[:7001]), turn_repair.across(kinds[7001:])
    for end in (2, 3):
        assert turn_repair.across(kinds)[end][0] == min(left[s][0] + right[4 * s + end][0] for s in range(4))
    # States are few, whatever the length.
    assert len(turn_repair.FORWARD) < 2000


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(op11_turn_repair(spark, sf)) == plain_report(list(plain_damage(rows)), {r[0] for r in rows})


@pytest.mark.parametrize("slice_bytes", [turn_repair.SLICE_BYTES, 300])
def test_hot_conversation_and_odd_rows(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(turn_repair, "SLICE_BYTES", slice_bytes)
    draw = random.Random(7)
    rows = [(7, i // 2, draw.choice(["user", "assistant", "system", "tool", "u", "", None]), draw.choice(["Yes.", "No", "", f"{i}?", None])) for i in range(300)]
    rows += [(8, None, "user", "Hi."), (8, None, "user", "Hi."), (8, 3, "assistant", "Ho!\t"), (8, 9, "assistant", "Ho!\t")]
    rows += [(None, 1, "user", "a."), (None, 2, None, "b."), (9, 0, "user", "é" * 200_000 + "."), (10, 1, "a", "x."), (10, 1, "a", "x.")]
    rows += [(11, 5, "user", "q.")] * 40 + [(12, -3, "assistant", " \n")]
    schema = "conv_id long, turn long, role string, text string"
    table = spark.createDataFrame(rows, schema).repartition(3)
    table = table.withColumn("kind", F.lit(1)).withColumn("slice", F.lit("x")).withColumn("_same", F.lit(2)).withColumn("n", F.lit(0))
    ids = {r[0] for r in rows}
    assert told(turn_repair.report(table)) == plain_report(rows, ids)
    hurt = turn_repair.damaged(table)
    assert told(turn_repair.report(hurt, every=table)) == plain_report(list(plain_damage(rows)), ids)
    lines = {}
    for r in sorted(turn_repair.repaired(table).collect(), key=lambda r: (r.slice, r.place)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for c, want in plain_report(rows, ids).items():
        assert hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == want[-1]


def test_empty_table_and_dropped_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.report(empty).count() == 0 and turn_repair.repaired(empty).count() == 0
    every = spark.createDataFrame([(1,), (1,), (None,)], "conv_id long")
    zero = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert told(turn_repair.report(empty, every=every)) == {1: zero, None: zero}
