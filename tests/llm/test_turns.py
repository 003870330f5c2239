import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from undertext.llm import turns

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, edits, repaired rows) of rows (role, text, fault), over all lists of edits."""

    @functools.cache
    def go(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def then(rest, price, edit, *kept):
            if rest:
                found.append((rest[0] + price, edit + rest[1], kept + rest[2]))

        if inserted < 3:
            then(go(i, NEXT[state], inserted + 1), 2, "I", (NAMES[NEXT[state]], ""))
        if i < len(rows):
            role, text, fault = rows[i]
            then(go(i + 1, state, 0), 3, "D")
            if fault not in ("blank", "duplicate"):
                if role[:1] and (role[0] == NEXT[state] or role[0] == "s" and not state):
                    then(go(i + 1, role[0], 0), fault == "truncated", "K", (role, text))
                then(go(i + 1, NEXT[state], 0), 2 + (fault == "truncated"), "R", (NAMES[NEXT[state]], text))
        return min(found, default=None)

    return go(0, "", 0)


def expected(rows):
    """rows: (conv_id, turn, role, text). A dictionary of what the contract wants."""
    one = lambda x: " " if x is None else str(x)
    by_conv = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r)):
        out = by_conv.setdefault(conv, [])
        how, role, text = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20, one(role), one(text)
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(turn, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    found = {}
    for conv, out in by_conv.items():
        out.sort(key=lambda r: ((r[0] is not None, r[0] or 0), r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in out:
            shown = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [t for t, *_ in out if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum((a[1][:1], b[1][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(out, out[1:]))
        cost, audit, kept = cheapest(tuple((r, t, f) for (_, r, t), f in zip(out, faults)))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        found[conv] = (gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return found


def told(df):
    rows = df.collect()
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    got = told(turns.op13_conversation_repair(spark, sf))
    assert got == expected([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])
    letters = set("".join(r[6] for r in got.values()))
    assert letters == set("DIKR") and any(r[4] for r in got.values())


def test_odd_rows(spark, tmp_path):
    rng = random.Random(7)
    pool = [None, "", " ", "Yes.", "No", "Why? \n", "end!x", "é.", "no. \x0b"]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(12)]), rng.choice([None, "", "system", "user", "user", "assistant", "tool"]), rng.choice(pool)) for _ in range(700)]
    rows += [(1000, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(3000)] + [(1001, 5, "user", "Same.")] * 400 + [(1002, None, None, None)]
    rows += rows[:40]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("conv", F.lit(1)).withColumn("fault", F.lit("z")).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    short = [r for r in rows if r[0] not in (1000, 1001)]
    got = told(turns.op13_conversation_repair(spark, str(tmp_path)))
    want = expected(short)
    assert {k: v for k, v in got.items() if k in want} == want and set(got) == {r[0] for r in rows}


def test_scratch_files_give_the_same_edits(monkeypatch):
    rng, edits = random.Random(2), turns.Edits()
    rows = [(i, True, rng.randint(0, 3), rng.choice(["user", "assistant", "system", "x"]), "t") for i in range(700)]
    audits = []
    for spill in (1 << 22, 64):
        monkeypatch.setattr(turns, "SPILL", spill)
        conversation = turns.Conversation(edits, "c")
        for r in rows:
            conversation.add(*r)
        audits.append(conversation.row())
    assert audits[0] == audits[1] and len(audits[0][-2]) >= 700


def test_all_edits_of_short_conversations():
    rng, edits = random.Random(3), turns.Edits()
    names = ["", "blank", "duplicate", "truncated"]
    for _ in range(3000):
        rows = [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), rng.choice("abc"), rng.randint(0, 3)) for _ in range(rng.randint(0, 8))]
        conversation = turns.Conversation(edits, "c")
        for i, (role, text, fault) in enumerate(rows):
            conversation.add(i, True, fault, role, text)
        cost, audit, kept = cheapest(tuple((r, t, names[f]) for r, t, f in rows))
        assert conversation.row()[-3:] == (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_empty_table(spark, tmp_path, kind):
    spark.createDataFrame([], f"conv_id {kind}, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert turns.op13_conversation_repair(spark, str(tmp_path)).collect() == []
