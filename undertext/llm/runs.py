"""Runs of repeated words, by longest common extensions in suffix trees.

A run is a maximal stretch of words with a smallest period q that is long enough (`LEAST` words and `TIMES` periods).
Words become numbers by their first place in the document. Runs can lie only where the same words come back at short
distances, so zones that hold all runs are found by array first (`zones` has the reason that none is missed). In each
zone, Ukkonen's algorithm makes the suffix tree of the words and that of their reversal. The Euler tour of a tree is
kept as one entry for each two neighbouring leaves, the depth of the shallowest node between them; a table of minima over
it gives the lowest common ancestor of any two leaves, and so their longest common extension, in constant time. Every
run has a Lyndon root (of the order of words or of its opposite) that is the longest Lyndon word at its place, so the
longest Lyndon words of both orders are all candidates: each is extended to the right in the one tree and to the left
in the other.

Documents are dealt to tasks as the table is read. A document takes memory for its own zones only, about 0.3 kB a word
of a zone.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertext.llm.common import blank_split, let, table

#: The least words and periods of a run.
LEAST, TIMES = 6, 4
#: Documents that are worked on at once.
AT_ONCE = 500
FOUND = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"


def stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches where mask holds."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def next_gaps(words: np.ndarray) -> np.ndarray:
    """The distance to the next place of the same word; a number above all distances where there is none."""
    order = np.argsort(words, kind="stable")
    gaps = np.full(len(words), len(words) + 1)
    same = words[order[1:]] == words[order[:-1]]
    gaps[order[:-1][same]] = np.diff(order)[same]
    return gaps


def zones(words: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint stretches of words that hold every run whole.

    In a run of period q, each word but the last q comes back after q words, so its next place is no further away. For q
    above r / 2 and up to r, a run thus lies in a stretch of at least (TIMES - 1) * q words whose next places are at
    most r away, and in the r words behind it. Words that come back in time before or behind a run belong to the same stretch.
    """
    if len(words) < LEAST:
        return []
    gaps, found, r = next_gaps(words), [], 1
    while TIMES * (r // 2 + 1) <= len(words):
        begin, end = stretches(gaps <= r)
        long = end - begin >= max((TIMES - 1) * (r // 2 + 1), LEAST - 1 if r == 1 else 0)
        found += zip(begin[long].tolist(), np.minimum(end[long] + r, len(words)).tolist())
        r *= 2
    merged: list[tuple[int, int]] = []
    for begin, end in sorted(found):
        if merged and begin <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((begin, end))
    return merged


def suffix_tree(s: list[int], width: int) -> tuple[array, array, dict[int, int]]:
    """Ukkonen's tree of s, whose last number occurs nowhere else; all are below width. The node x is reached by s[begin[x]:stop[x]]; children by node * width + first number."""
    begin, stop, link, child = array("q", [0]), array("q", [0]), array("q", [0]), {}
    n, node, edge, length, left = len(s), 0, 0, 0, 0
    for i, c in enumerate(s):
        left, made = left + 1, 0
        while left:
            if not length:
                edge = i
            key = node * width + s[edge]
            down = child.get(key)
            if down is None:
                child[key] = len(begin)
                begin.append(i), stop.append(n), link.append(0)
                if made:
                    link[made], made = node, 0
            else:
                at = begin[down]
                if length and length >= (span := stop[down] - at):
                    edge, length, node = edge + span, length - span, down
                    continue
                if s[at + length] == c:
                    length += 1
                    if made:
                        link[made] = node
                    break
                fork = len(begin)
                begin.append(at), stop.append(at + length), link.append(0)
                begin.append(i), stop.append(n), link.append(0)
                begin[down] = at + length
                child[key], child[fork * width + c], child[fork * width + s[at + length]] = fork, fork + 1, down
                if made:
                    link[made] = fork
                made = fork
            left -= 1
            if node:
                node = link[node]
            elif length:
                length, edge = length - 1, i - left + 1
    return begin, stop, child


class Extensions:
    """Longest common extensions of the places of a list of numbers from 1 up, by its suffix tree."""

    def __init__(self, words: list[int], orders: bool):
        """orders: whether the ranks of suffixes are wanted, in the order of numbers and in the opposite one. What begins a longer one comes before it in both."""
        self.n = len(words)
        width = max(words) + 1
        begin, stop, child = suffix_tree([*words, 0], width)
        keys = np.fromiter(child.keys(), dtype=np.int64, count=len(child))
        nodes = np.fromiter(child.values(), dtype=np.int64, count=len(child))
        order = np.argsort(keys)
        keys, nodes = keys[order], nodes[order]
        above = np.zeros(len(begin), dtype=np.int64)
        above[nodes] = keys // width
        span = np.frombuffer(stop, dtype=np.int64) - np.frombuffer(begin, dtype=np.int64)
        first = np.searchsorted(keys, np.arange(len(begin) + 1) * width)
        tour = self.tour(nodes.tolist(), first.tolist())
        depth = np.zeros(len(begin), dtype=np.int64)
        for part in self.levels(above, tour):
            depth[part] = depth[above[part]] + span[part]
        leaf = first[:-1] == first[1:]
        at = np.flatnonzero(leaf[tour])
        self.rank = self.ranks(depth[tour[at]])
        # Between two neighbouring leaves, the tour goes up to the parent of what it visits next.
        self.minima = [depth[above[tour[at[:-1] + 1]]].astype(np.int32)]
        while (half := 1 << (len(self.minima) - 1)) * 2 <= len(self.minima[0]):
            self.minima.append(np.minimum(self.minima[-1][:-half], self.minima[-1][half:]))
        if orders:
            back = np.where(keys % width == 0, 0, width - keys % width) + keys // width * width
            turned = self.tour(nodes[np.argsort(back)].tolist(), first.tolist())
            self.opposite = self.ranks(depth[turned[leaf[turned]]])

    def ranks(self, depths: np.ndarray) -> np.ndarray:
        """Of each place, from the depths of leaves in their order; the empty suffix is the last place."""
        rank = np.empty(self.n + 1, dtype=np.int64)
        rank[self.n + 1 - depths] = np.arange(len(depths))
        return rank

    @staticmethod
    def tour(nodes: list[int], first: list[int]) -> np.ndarray:
        """Nodes in the order in which they are first visited."""
        seen, waiting = array("q"), [0]
        while waiting:
            node = waiting.pop()
            seen.append(node)
            waiting += nodes[first[node] : first[node + 1]][::-1]
        return np.frombuffer(seen, dtype=np.int64)

    @staticmethod
    def levels(above: np.ndarray, tour: np.ndarray) -> Iterator[np.ndarray]:
        """The nodes below the root, in groups whose parents come in groups before. Parents stand before children in the tour."""
        level = array("q", bytes(8 * len(above)))
        parents = above.tolist()
        for node in tour.tolist()[1:]:
            level[node] = level[parents[node]] + 1
        level = np.frombuffer(level, dtype=np.int64)
        order = np.argsort(level, kind="stable")
        return (x for x in np.split(order, np.flatnonzero(np.diff(level[order])) + 1)[1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on are those from b on; a and b differ and are n at most."""
        low, high = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
        step = np.log2(high - low).astype(np.int64)
        out = np.empty(len(low), dtype=np.int64)
        for k in np.unique(step).tolist():
            of = step == k
            out[of] = np.minimum(self.minima[k][low[of]], self.minima[k][high[of] - (1 << k)])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next place with a smaller rank: where the longest Lyndon word that begins at a place ends."""
    out, waiting, ranks = array("q", bytes(8 * len(rank))), [], rank.tolist()
    for i in range(len(ranks) - 1, -1, -1):
        own = ranks[i]
        while waiting and ranks[waiting[-1]] > own:
            waiting.pop()
        out[i] = waiting[-1] if waiting else len(ranks)
        waiting.append(i)
    return np.frombuffer(out, dtype=np.int64)


def zone_runs(words: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the runs of a zone, by start and period."""
    numbers = (np.unique(words, return_inverse=True)[1] + 1).tolist()
    n, ahead = len(numbers), Extensions(numbers, orders=True)
    pairs = []
    for rank in (ahead.rank, ahead.opposite):
        end = next_smaller(rank)[:n]
        begin = np.flatnonzero(end < n)
        pairs.append(np.stack([begin, end[begin]]))
    a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
    right = ahead.common(a, b)
    # The first root of a run begins within its first period, so TIMES - 2 whole periods at least follow the root.
    some = right >= (TIMES - 2) * (b - a)
    a, b, right = a[some], b[some], right[some]
    if not len(a):
        return np.empty((0, 3), dtype=np.int64)
    behind = Extensions(numbers[::-1], orders=False)
    start = a - behind.common(n - a, n - b)
    length, period = b + right - start, b - a
    keep = length >= np.maximum(LEAST, TIMES * period)
    return np.unique(np.stack([start, length, period], axis=1)[keep], axis=0)[:, [0, 1, 2]]


def find_runs(words: list) -> np.ndarray:
    """Rows (start, length, period) of all runs of a list of words, by start and then period."""
    if len(words) < LEAST:
        return np.empty((0, 3), dtype=np.int64)
    first: dict = {}
    numbers = np.fromiter(map(first.setdefault, words, count()), dtype=np.int64, count=len(words))
    parts = [zone_runs(numbers[a:b]) + np.array([a, 0, 0]) for a, b in zones(numbers)]
    if not parts:
        return np.empty((0, 3), dtype=np.int64)
    rows = np.concatenate(parts)
    return rows[np.lexsort([rows[:, 2], rows[:, 0]])]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, without those that any run holds after its first period."""
    if len(runs):
        deep = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(deep, runs[:, 0] + runs[:, 2], 1)
        np.add.at(deep, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(deep)[:-1] == 0).tolist()]
    return b" ".join(words)


def searching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            piece = batch.slice(at, AT_ONCE)
            words = [(t or b"").split() for t in piece["text"].to_pylist()]
            found = list(map(find_runs, words))
            offsets = np.append(0, np.cumsum([len(f) for f in found])).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in np.concatenate(found).T], names=["start", "length", "period"])
            columns = [piece["doc_id"], pa.array(map(len, words), pa.int64()), pa.ListArray.from_arrays(offsets, runs), pa.array(map(collapsed, words, found), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of docs (doc_id, text): its runs by start and then period, and its text without repetition, words joined by one space.

    Words lie between ASCII white space, in whole texts of any length. Null text has no words; repeated rows and null
    ids are rows like others; an empty table gives no rows; other columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(searching, FOUND).withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of docs, where one document in ten goes over into repetition from some word on; chosen by the CRC-32 of doc_id, so a null doc_id is none of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(words, a + i % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " "))

    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(let(blank_split(F.col("text")), repeated), F.col("text"))).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir) -> DataFrame:
    """The runs of all documents, with the planted ones, as numbers and digests: a row each row, as periodic_runs has it; without runs, the four columns of the strongest are null."""
    r = periodic_runs(planted(table(spark, sf_dir, "documents")))
    # Quotients of whole numbers below 2 ** 26 are equal as doubles only where they are equal.
    best = F.array_min(F.transform("runs", lambda x: F.struct((-x["length"] / x["period"]).alias("k"), x["start"].alias("start"), x["period"].alias("period"), x["length"].alias("length"))))
    line = lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))
    told = r.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
    return told.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
