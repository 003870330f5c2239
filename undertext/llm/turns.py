"""Conversations repaired to a legal order of roles, by the cheapest edits, in one sorted stream.

A repaired conversation is empty or has roles by the pattern s?(ua)+ of their initials. Rows are kept, given the role of user or
assistant, or deleted, and rows without text may be inserted anywhere; each edit has a price (`PRICES`), and of the
cheapest lists of edits the least one counts.

Rows are dealt by conversation and sorted by turn, and each task passes over them once, from batch to batch. It carries, for
each of the four states of the pattern, the price of the cheapest edits so far that end in it, and which of two states' edits
come first; both are relative, so few such tables exist, and what a row does to a table is looked up after its first
time. For each row, two bytes tell what was looked up; the edits are read back from these at the conversation's end.
Beyond `SPILL` bytes they lie in a scratch file of the task, as Spark's own sorts do, which is gone with the task and
written anew if an executor is lost. The texts of repaired rows are hashed on the way, state by state, so no text is held.
A conversation is one task's work however long it is, as its edits follow from all rows in order; its memory is bounded by
`SPILL` and its list of edits, a byte a row.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertext.llm.common import BLANKS, table

#: Of edits: delete, insert, rerole; and what a truncated row that stays adds.
PRICES = {"D": 3, "I": 2, "K": 0, "R": 2}
TRUNCATED = 1
#: Of each state (nothing yet, system, user, assistant): the state after a user's or an assistant's row, and after a system row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = {USER: b"user:", ASSISTANT: b"assistant:"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
FINE, BLANK, DUPLICATE, CUT, GONE = range(5)
#: Bytes of looked-up numbers that a conversation holds in memory.
SPILL = 1 << 22
#: A relation of two lists of edits: the first is less, the second is less; else how many insertions the second has more at its end.
LESS, MORE = -99, 99
FOUND = "conv string, n_rows bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def related(relation: int, a: str, b: str) -> int:
    """The relation of two lists of edits, when edits a and b are added to them."""
    if relation in (LESS, MORE):
        return relation
    a, b = "I" * max(0, -relation) + a, "I" * max(0, relation) + b
    if a.startswith(b) or b.startswith(a):
        return len(b) - len(a)
    return LESS if a < b else MORE


class Edits:
    """Tables of states and what rows do to them. A table: for each state its price above the least, or None, and the relations of each state's edits to each other's."""

    def __init__(self):
        self.numbers: dict = {}
        self.steps: list = []
        self.first, self.begun = self.closed({START: (0, START, "")}, ((0,) * 4,) * 4)[:2]

    def closed(self, best: dict, relations: tuple) -> tuple:
        """A table, with insertions, from best: state to (price, state before, edits added); also that dictionary and the least price."""

        def better(x, y):
            return x[0] < y[0] or x[0] == y[0] and self.less(relations, x, y)

        for _ in range(3):
            for state, (price, before, added) in list(best.items()):
                new = (price + PRICES["I"], before, added + "I")
                if NEXT[state] not in best or better(new, best[NEXT[state]]):
                    best[NEXT[state]] = new
        # What can follow a system row can follow an assistant's, and at the beginning too but for a system row, which would be deleted.
        for state, more in ((SYSTEM, 0), (START, PRICES["D"])):
            if state in best and best[state][0] > best[ASSISTANT][0] + more:
                del best[state]
        least = min(x[0] for x in best.values())
        prices = tuple(best[s][0] - least if s in best else None for s in range(4))
        new = tuple(tuple(related(relations[best[s][1]][best[t][1]], best[s][2], best[t][2]) if s in best and t in best else 0 for t in range(4)) for s in range(4))
        return (prices, new), best, least

    @staticmethod
    def less(relations: tuple, x: tuple, y: tuple) -> bool:
        found = related(relations[x[1]][y[1]], x[2], y[2])
        return found == LESS or found != MORE and found > 0

    def step(self, key: tuple) -> int:
        """The number of what a row (its initial, whether it must go, whether it is truncated) does to a table."""
        (prices, relations), initial, must_go, cut = key
        best: dict = {}
        for state in (s for s in range(4) if prices[s] is not None):
            after = [(state, "D", 0)]
            if not must_go:
                after.append((NEXT[state], "R", TRUNCATED * cut))
                kept = INITIALS.get(initial)
                if kept is not None and kept == (NEXT[state] if kept != SYSTEM else SYSTEM if state == START else None):
                    after.append((kept, "K", TRUNCATED * cut))
            for to, edit, more in after:
                new = (prices[state] + PRICES[edit] + more, state, edit)
                if to not in best or new[0] < best[to][0] or new[0] == best[to][0] and self.less(relations, new, best[to]):
                    best[to] = new
        table_, best, least = self.closed(best, relations)
        moves = tuple((s, *best[s][1:]) for s in sorted(best))
        self.steps.append((table_, least, moves, {s: (before, added) for s, before, added in moves}))
        self.numbers[key] = len(self.steps) - 1
        return self.numbers[key]


class Conversation:
    """What a task carries of the conversation that it is in."""

    def __init__(self, edits: Edits, name: str | None):
        self.edits, self.name = edits, name
        self.rows, self.counts, self.illegal, self.last = 0, [0] * 5, 0, None
        self.low = self.high = self.at = None
        self.turns = 0
        self.table, self.cost = edits.first, 0
        self.hashes: dict = {s: None for s in edits.begun}
        for state, (_, _, added) in edits.begun.items():
            self.hashes[state] = self.inserted(None, START, len(added))
        self.path, self.file = array("H"), None

    @staticmethod
    def inserted(hash_, state: int, times: int):
        for _ in range(times):
            state = NEXT[state]
            hash_ = Conversation.added(hash_, ROLES[state])
        return hash_

    @staticmethod
    def added(hash_, row: bytes):
        if hash_ is None:
            return hashlib.sha256(row)
        hash_.update(b"\n" + row)
        return hash_

    def add(self, turn: int, has_turn: bool, fault: int, role: str, text: str) -> None:
        if fault == GONE:
            return
        if has_turn:
            if turn != self.at:
                self.turns, self.at, self.high = self.turns + 1, turn, turn
            self.low = turn if self.low is None else self.low
        initial = role[:1]
        if self.rows and (self.last, initial) not in LEGAL:
            self.illegal += 1
        self.rows, self.last = self.rows + 1, initial
        self.counts[fault] += 1
        key = (self.table, initial if initial in INITIALS else "", fault in (BLANK, DUPLICATE), fault == CUT)
        number = self.edits.numbers.get(key)
        if number is None:
            number = self.edits.step(key)
        self.table, more, moves, _ = self.edits.steps[number]
        self.cost += more
        body, hashes = text.encode(errors="surrogatepass"), {}
        for state, before, added in moves:
            hash_, edit = self.hashes[before], added[0]
            hash_ = hash_ and hash_.copy()
            after = before
            if edit == "R":
                after = NEXT[before]
                hash_ = self.added(hash_, ROLES[after] + body)
            elif edit == "K":
                after = INITIALS[initial]
                hash_ = self.added(hash_, role.encode(errors="surrogatepass") + b":" + body)
            hashes[state] = self.inserted(hash_, after, len(added) - 1)
        self.hashes = hashes
        self.path.append(number)
        if 2 * len(self.path) >= SPILL:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.path.tobytes())
            self.path = array("H")

    def audit(self, state: int) -> str:
        """The edits that lead to a state, read back from the last row on."""
        out, steps = [], self.edits.steps
        left = self.file.tell() // SPILL if self.file else 0
        while True:
            part = []
            for number in reversed(self.path):
                state, added = steps[number][3][state]
                part.append(added[::-1])
            out.append("".join(part))
            if not left:
                break
            left -= 1
            self.file.seek(left * SPILL)
            self.path = array("H", self.file.read(SPILL))
        out.append(self.edits.begun[state][2])
        return "".join(out)[::-1]

    def row(self) -> tuple:
        prices, relations = self.table
        ends = [s for s in (START, ASSISTANT) if prices[s] is not None]
        state = ends[0] if len(ends) == 1 or (prices[ends[0]], not Edits.less(relations, (0, ends[0], ""), (0, ends[1], ""))) <= (prices[ends[1]], False) else ends[1]
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        audit, hash_ = self.audit(state), self.hashes[state] or hashlib.sha256()
        return (self.name, self.rows, gaps, *self.counts[BLANK : CUT + 1], self.illegal, self.cost + prices[state], audit, hash_.hexdigest())


def streaming(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row each conversation, from rows sorted by conversation and turn."""
    edits, now = Edits(), None
    names = [c.split()[0] for c in FOUND.split(", ")]
    for batch in batches:
        done = []
        for conv, *row in zip(*(batch[c].tolist() for c in ("conv", "turn", "has_turn", "fault", "role", "text"))):
            if now is None or conv != now.name:
                if now is not None:
                    done.append(now.row())
                now = Conversation(edits, conv)
            now.add(*row)
        if done:
            yield pd.DataFrame(done, columns=names)
    if now is not None:
        yield pd.DataFrame([now.row()], columns=names)


def faulty(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, role, text, gone), dealt by conversation, with fault: the first that a row has. Rows that are gone have no other and repeat nothing."""
    shown = F.btrim("text", F.lit(BLANKS))
    # Dealt by conversation, rows need no further exchange for this window.
    earlier = F.row_number().over(Window.partitionBy("conv", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    cut = ~F.substring(shown, -1, 1).isin(".", "!", "?")
    fault = F.when(F.col("gone"), GONE).when(shown == "", BLANK).when(earlier, DUPLICATE).when(cut, CUT).otherwise(FINE)
    return rows.repartition("conv").withColumn("fault", fault)


def repair(rows: DataFrame) -> DataFrame:
    """(conv, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation in rows (conv string, turn bigint, role, text, gone boolean).

    Rows count in order of turn, nulls first, those of one turn by role and text. A null conv is a conversation of its
    own; null roles and texts are one space; rows that are gone only name their conversation. Conversations without
    rows have zeros, no edits and the hash of nothing. An empty table gives no rows.
    """
    known = rows.withColumn("role", F.coalesce("role", F.lit(" "))).withColumn("text", F.coalesce("text", F.lit(" ")))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == DUPLICATE]  # of equal rows, the first is none
    sorted_ = faulty(known).sortWithinPartitions(*order).select("conv", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("has_turn"), "fault", "role", "text")
    return sorted_.mapInPandas(streaming, FOUND)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, gone) of conversations (conv_id, turn, role, text), damaged by the CRC-32 of conv_id and turn."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    role = F.when(how == 4, "user").otherwise(known("role"))
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    rows = conversations.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (how == 0).alias("gone"), F.when(how == 3, 2).otherwise(1).alias("times"))
    return rows.select(*rows.columns[:-1], F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")


def op13_conversation_repair(spark, sf_dir) -> DataFrame:
    """A row each conversation of the table, damaged as the contract says; see repair for nulls and empty tables."""
    conversations = table(spark, sf_dir, "conversations")
    kind = dict(conversations.dtypes)["conv_id"]
    found = repair(damaged(conversations))
    return found.select(F.col("conv").cast(kind).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "n_rows")
