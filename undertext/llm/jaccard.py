"""Exact n-gram Jaccard join by vertical partitioning.

The global order of n-grams (that of their 64-bit hashes) is cut into fragments, and each fragment is worked on apart.

Candidates: of a set's n-grams in the global order, the runs of RUN consecutive ones are looked at. A link leaves so
few n-grams that only one of the two sets has, that among the first runs of each, as many as `runs` says, at least one
is common to both (see there). Runs go to the fragment in which they begin. There, sets with an equal run are tied
to one of them, which makes a row a set and not a row a pair; sets that are tied, directly or not, form a group.

Counts: sets of a group are laid against each other in blocks, each of which is one row for each of PARTS fragments of
its sets. Each fragment's overlaps of a block pair are counted apart, as an array with a place for each pair of sets,
and the arrays are summed for each block pair. Links follow from the sums, and components from the links. Equal sets are one
set from the start, however many copies there are. A group of k different sets is k / BLOCK blocks, so that it has
(k / BLOCK) ** 2 rows and its comparison k ** 2 counts; all else grows with the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertext.llm.common import NAME, discard, free_memory, matching, named_rows, shared_folder, small_batches, stored, table

#: Fragments for which overlaps are counted apart.
PARTS = 4
#: Sets in a block, and n-grams that are laid out for it at a time.
BLOCK, WIDE = 1024, 1024
#: Fragments by which runs are dealt: so many at least, twice the shuffle partitions, and one for so many documents.
FRAGMENTS, A_FRAGMENT = 256, 10_000
#: Runs that a task holds before it deals them, and texts that it reads at once.
HELD, TEXTS = 250_000, 500
#: Bytes of text whose words are hashed at once.
AT_ONCE = 1 << 18

_rng = np.random.default_rng(5)
_byte = _rng.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_byte[:, 65:91] = _byte[:, 97:123]  # A-Z as a-z
_blank = np.zeros(256, dtype=bool)
_blank[[9, 10, 11, 12, 13, 32]] = True
_STEPS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: list[tuple[np.ndarray, np.ndarray]] = []
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For both steps, the powers from 0 to size at least, and their inverses modulo 2**64. A table is kept for AT_ONCE bytes; a longer text gets one of its own."""
    up = lambda step, n: np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(n, step, dtype=np.uint64))])
    if size > AT_ONCE:
        return [(up(s, size), up(pow(s, -1, 1 << 64), size)) for s in _STEPS]
    if not _powers:
        _powers[:] = [(up(s, AT_ONCE), up(pow(s, -1, 1 << 64), AT_ONCE)) for s in _STEPS]
    return _powers


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, lower-cased in ASCII, and where each text's words begin (and the last one's end)."""
    texts = pa.concat_arrays([texts.cast(pa.large_binary()).fill_null(b"")])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    word = ~_blank[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    borders = offsets[(offsets > 0) & (offsets < len(raw))]
    first[borders] = word[borders]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[borders - 1] = word[borders - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = []
    for values, (up, down) in zip(_byte, powers(len(raw))):
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values[raw] * up[: len(raw)])])
        sums.append((total[end] - total[begin]) * down[begin])
    return mix(sums[0] + mix(sums[1] + (end - begin).astype(np.uint64))), np.searchsorted(begin, offsets)


def gram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's set: the sorted distinct hashes of its n-word shingles; a shorter text is one shingle, one without words none."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < len(texts):  # AT_ONCE bytes at a time, one text at least
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
        words, begin = word_hashes(texts.slice(at, until - at))
        whole = np.full(max(0, len(words) - n + 1), n, dtype=np.uint64)
        for k in range(n):
            whole = mix(whole * _SPREAD + words[k : len(words) - n + 1 + k])
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(whole[a : b - n + 1]))
            elif b > a:
                one = np.full(1, b - a, dtype=np.uint64)
                for w in words[a:b]:
                    one = mix(one * _SPREAD + w)
                out.append(one)
            else:
                out.append(whole[:0].copy())
        at = until
    return out


def run_length(num: int, den: int) -> int:
    """N-grams in a run: the longer, the fewer sets meet by chance and the more runs a set has."""
    return min(4, max(1, (6 * den // 10) // (den - num))) if num < den else 4


def runs(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the set, n-gram with which the run begins, hash of the run) for the first runs of each set.

    Let t = num / den, m the run length, and x and y two sets that link, of which a n-grams are in x alone and b in y
    alone. In the global order, x and y agree on a run of x unless one of the a is in it (each is in m runs at most)
    or one of the b falls inside it (each falls inside m - 1 at most). Linking means a + t b <= (1 - t) |x|, so at most
    m a + (m - 1) b <= m (1 - t) |x| runs of x differ, as m - 1 <= m t; the same holds for y. Before the first run
    that both have, all runs of either differ, so it is among the first m (1 - t) |x| + 1 runs of x and likewise of y.
    Marks after the last n-gram let a run begin with each n-gram.
    """
    m = run_length(num, den)
    sizes = np.array([len(g) for g in sets], dtype=np.int64)
    take = np.minimum(sizes, m * (den - num) * sizes // den + 1)
    flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
    of = np.repeat(np.arange(len(sets)), take)
    start = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(take) + take, take) + np.arange(len(of))
    end = np.cumsum(sizes)[of]
    sig = np.zeros(len(of), dtype=np.uint64)
    for j in range(m):
        there = start + j < end
        sig = mix(sig * _SPREAD + np.where(there, flat[np.where(there, start + j, 0)], (start + j - end + 1).astype(np.uint64)))
    return of, flat[start], sig


def fragment(begin: np.ndarray, num: int, den: int, fragments: int) -> np.ndarray:
    """The fragment of the global order that an n-gram lies in. A set's first runs begin with its lowest n-grams, so the order's beginning, where nearly all lie, is cut into nine tenths of the fragments."""
    dense = min(1.0, 1.2 * run_length(num, den) * (den - num) / den)
    x = begin.astype(np.float64) / 2.0**64
    share = np.where(x < dense, 0.9 * x / dense, 0.9 + 0.1 * (x - dense) / (1.0 - dense)) if dense < 1 else x
    return np.minimum((share * fragments).astype(np.int32), fragments - 1)


def fingerprint(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


ROWS = "frag int, doc_id bigint, h bigint, h2 bigint, n bigint, node binary, key bigint, keys binary, sigs binary"
ROW_KINDS = [("frag", pa.int32()), ("doc_id", pa.int64()), ("h", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("key", pa.int64()), ("keys", pa.binary()), ("sigs", pa.binary())]


def key_of(node: bytes) -> int:
    return int.from_bytes(node[:8], "little", signed=True)


def filled(kinds: list, count: int, **columns) -> pa.RecordBatch:
    """A batch of count rows; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(count, t) for k, t in kinds], names=[k for k, _ in kinds])


def signing(n: int, num: int, den: int, fragments: int) -> Callable:
    """From texts: a row each with its set's size and name (frag below 0), and parcels of runs by fragment."""

    def parcels(held: list) -> pa.RecordBatch:
        frag, key, sig = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(frag, kind="stable")
        found, begin = np.unique(frag[order], return_index=True)
        ends = [*begin[1:].tolist(), len(order)]
        cut = lambda x: [x[order[a:b]].tobytes() for a, b in zip(begin.tolist(), ends)]
        return filled(ROW_KINDS, len(found), frag=found, keys=cut(key), sigs=cut(sig))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        held, size, row = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                piece = batch.slice(at, TEXTS)
                sets = gram_sets(piece["text"], n)
                nodes = [fingerprint(g) if len(g) else None for g in sets]
                fresh = [i for i, x in enumerate(nodes) if x is not None and x not in met and not met.add(x)]
                of, begin, sig = runs([sets[i] for i in fresh], num, den)
                keys = np.array([key_of(nodes[i]) for i in fresh], dtype=np.int64)[of]
                held.append((fragment(begin, num, den, fragments), keys, sig))
                size += len(of)
                spread = [-1 - k * 7919 % (1 << 20) for k in range(row, row + piece.num_rows)]
                row += piece.num_rows
                yield filled(ROW_KINDS, piece.num_rows, frag=spread, doc_id=piece["doc_id"], h=piece["h"], h2=piece["h2"], n=[len(g) for g in sets], node=nodes, key=[x and key_of(x) for x in nodes])
                if size >= HELD:
                    yield parcels(held)
                    held, size = [], 0
        if size:
            yield parcels(held)
        met, held = set(), []
        free_memory()

    return run


SIGNED = "doc_id bigint, h bigint, h2 bigint, n bigint, node binary, key bigint, a bigint, b bigint"
SIGNED_KINDS = [("doc_id", pa.int64()), ("h", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]


def tying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as they are; for each fragment's runs, in one go, ties (a, b) of sets with an equal run to the least of them."""

    def ties(keys: list, sigs: list) -> pa.RecordBatch:
        key, sig = np.frombuffer(b"".join(keys), dtype=np.int64), np.frombuffer(b"".join(sigs), dtype=np.uint64)
        order = np.lexsort((key, sig))
        key, sig = key[order], sig[order]
        begin = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        least = np.repeat(key[begin], np.diff(np.append(begin, len(sig))))
        tied = np.unique(np.stack([key, least], axis=1)[key != least], axis=0)
        return filled(SIGNED_KINDS, len(tied), a=tied[:, 0], b=tied[:, 1])

    now, keys, sigs = None, [], []
    for batch in batches:
        rows = batch.filter(pc.less(batch["frag"], 0))
        if rows.num_rows:
            yield filled(SIGNED_KINDS, rows.num_rows, **{k: rows[k] for k in ("doc_id", "h", "h2", "n", "node", "key")})
        parcels = batch.filter(pc.greater_equal(batch["frag"], 0))
        for frag, key, sig in zip(*(parcels[k].to_pylist() for k in ("frag", "keys", "sigs"))):
            if frag != now and keys:
                yield ties(keys, sigs)
                keys, sigs = [], []
            now = frag
            keys.append(key)
            sigs.append(sig)
    if keys:
        yield ties(keys, sigs)
    keys, sigs = [], []
    free_memory()


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, comp) of every node in a link (a, b): comp is the least node reachable. Labels spread and jump until they rest."""
    edges = stored(links.union(links.select("b", "a")).distinct(), f"{folder}/edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), f"{folder}/labels0")
    for i in range(1, 64):
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        spread = labels.join(near, "node").select("node", "comp", F.least("comp", "m").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("up"))
        new = stored(spread.join(jump, "to").select("node", F.least("to", "up").alias("comp"), (F.least("to", "up") < F.col("comp")).alias("moved")), f"{folder}/labels{i}")
        discard(links.sparkSession, f"{folder}/labels{i - 1}")
        labels = new.select("node", "comp")
        if new.where("moved").isEmpty():
            discard(links.sparkSession, f"{folder}/edges")
            return labels
    raise RuntimeError("components did not settle")


def cutting(n: int) -> Callable:
    """(node, segments): a text's set cut into PARTS fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(k << 64) // PARTS for k in range(1, PARTS)], dtype=np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                sets = [g for g in gram_sets(batch["text"].slice(at, TEXTS), n) if len(g)]
                cut = [[s.tobytes() for s in np.split(g, np.searchsorted(g, edges))] for g in sets]
                columns = [pa.array([fingerprint(g) for g in sets], pa.binary()), pa.array(cut, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "segments"])
        free_memory()

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set on the left shares with each on the right."""
    ids, at, met = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    place = np.where(met > 1, np.cumsum(met > 1) - 1, -1)[at]  # an n-gram of one set alone is in no overlap
    row = np.repeat(np.arange(len(left) + len(right)), [len(g) for g in (*left, *right)])
    out, shared = np.zeros((len(left), len(right)), dtype=np.int64), int((met > 1).sum())
    for low in range(0, shared, WIDE):
        here = (place >= low) & (place < low + WIDE)
        laid = np.zeros((len(left) + len(right), min(WIDE, shared - low)), dtype=np.float32)
        laid[row[here], place[here] - low] = 1
        out += (laid[: len(left)] @ laid[len(left) :].T).astype(np.int64)
    return out


def grouped(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], rest: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that are equal in the columns by, with the columns rest of each."""
    now, rows = None, []
    for batch in batches:
        for key, row in zip(zip(*(batch[k].to_pylist() for k in by)), zip(*(batch[k].to_pylist() for k in rest))):
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append(row)
    if rows:
        yield now, rows


PACKED = "comp bigint, block bigint, frag int, nodes array<binary>, facts binary, segments array<binary>"


def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block and fragment, from its sets' rows in their order; facts: n and c of each."""
    names, kinds = [c.split()[0] for c in PACKED.split(", ")], [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.binary(), pa.list_(pa.binary())]
    for (comp, block, frag), rows in grouped(batches, ("comp", "block", "frag"), ("node", "n", "c", "segment")):
        rows = [r for i, r in enumerate(rows) if not i or r[0] != rows[i - 1][0]]  # a row that occurs twice gives its set twice
        columns = [comp, block, frag, [r[0] for r in rows], np.array([r[1:3] for r in rows], dtype=np.int64).tobytes(), [r[3] for r in rows]]
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], names=names)
    rows = columns = None
    free_memory()


COUNTED = "comp bigint, lo bigint, hi bigint, frag int, nodes array<binary>, facts binary, width int, overlaps binary"


def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block pair and fragment, the overlaps of its sets' segments: rows of the lower block by columns of the higher."""
    names = [c.split()[0] for c in COUNTED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.binary(), pa.int32(), pa.binary()]
    for (comp, lo, hi, frag), sides in grouped(batches, ("comp", "lo", "hi", "frag"), ("block", "nodes", "facts", "segments")):
        x, y = ([np.frombuffer(g, dtype=np.uint64) for g in next(r[3] for r in sides if r[0] == side)] for side in (lo, hi))
        found = overlaps(x, y)
        width = 2 if found.max(initial=0) < 1 << 16 else 4
        told = (pa.array([None], kinds[4]), pa.array([None], kinds[5]))
        if frag == 0:
            whole = {r[0]: r for r in sides}
            parts = [np.column_stack([np.full(len(r[1]), r[0] == lo), np.full(len(r[1]), r[0] == hi), np.frombuffer(r[2], dtype=np.int64).reshape(-1, 2)]) for r in whole.values()]
            told = (pa.array([[x for r in whole.values() for x in r[1]]], kinds[4]), pa.array([np.concatenate(parts).astype(np.int64).tobytes()], kinds[5]))
        columns = [[comp], [lo], [hi], [frag], *told, [width], [found.astype(f"<u{width}").tobytes()]]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
    x = y = found = sides = whole = parts = told = columns = None
    free_memory()


def least_reachable(yes: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the least position that each can reach."""
    label = np.arange(len(yes))
    while True:
        new = np.minimum(label, np.where(yes, label[None, :], len(yes)).min(axis=1, initial=len(yes)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def summing(num: int, den: int, pairs: bool) -> Callable:
    """Sums each block pair's overlaps over the fragments. Gives (a, b) of every link, or (node, linked, to): the number of rows linked there, and a node reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lo, hi), rows in grouped(batches, ("comp", "lo", "hi"), ("frag", "nodes", "facts", "width", "overlaps")):
            nodes, facts = rows[0][1], np.frombuffer(rows[0][2], dtype=np.int64).reshape(-1, 4)
            x, y = np.flatnonzero(facts[:, 0]), np.flatnonzero(facts[:, 1])
            o = sum(np.frombuffer(r[4], dtype=f"<u{r[3]}").astype(np.int64) for r in rows).reshape(len(x), len(y))
            n, c = facts[:, 2], facts[:, 3]
            yes = o * den >= (n[x][:, None] + n[y][None, :] - o) * num
            if lo == hi:
                np.fill_diagonal(yes, False)
            if pairs:
                i, j = np.nonzero(np.triu(yes) if lo == hi else yes)
                ab = [sorted((nodes[a], nodes[b])) for a, b in zip(x[i].tolist(), y[j].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in ab], pa.binary()) for k in (0, 1)], names=["a", "b"])
                continue
            whole = yes if lo == hi else np.zeros((len(nodes), len(nodes)), dtype=bool)
            if lo < hi:
                whole[np.ix_(x, y)], whole[np.ix_(y, x)] = yes, yes.T
            if not yes.any():
                continue
            linked, to = whole @ c, least_reachable(whole)
            some = np.flatnonzero(linked).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in some], pa.binary()), pa.array(linked[some], pa.int64()), pa.array([nodes[to[i]] for i in some], pa.binary())], names=["node", "linked", "to"])
        rows = o = yes = whole = None
        free_memory()

    return run


def blocks(members: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The members with their block; and (comp, block, other) of the blocks that are held against each other.

    Groups of more than a block's sets are cut by size, so that links lie within a class or between neighbours, and by hash.
    """
    width = F.log(F.lit(1.01 * den / num))  # a little over the ratio of sizes, so that no rounding sets linked sizes two classes apart
    sized = members.withColumn("cls", F.when(F.col("k") <= BLOCK, F.lit(0).cast("long")).otherwise(F.floor(F.log(F.col("n").cast("double")) / width)))
    ladder = sized.groupBy("comp", "cls").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    named = lambda cls, part: F.shiftleft(cls, 32) + part
    own = sized.join(ladder, ["comp", "cls"]).select("comp", "node", "n", "c", named(F.col("cls"), F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block"))
    there = ladder.select("comp", "cls", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    near = ladder.select("comp", F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)).alias("cls"), F.col("cls").alias("o_cls"), F.col("parts").alias("o_parts"))
    pairs = there.join(near, ["comp", "cls"]).withColumn("o_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_parts") - 1)))
    return own, pairs.select("comp", named(F.col("cls"), F.col("part")).alias("block"), named(F.col("o_cls"), F.col("o_part")).alias("other"))


def similar(docs: DataFrame, n: int, num: int, den: int, pairs: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, h2, n, node) of every row, and what summing gives for the different sets that link.

    A set is cut from the text of one owner, found by its id and its text's hashes, so that null ids and ids with
    several texts are owners like others.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = named_rows(docs, ("text",), "text")
    parcels = texts.mapInArrow(signing(n, num, den, max(FRAGMENTS, 2 * partitions, docs.count() // A_FRAGMENT)), ROWS).repartition(partitions, "frag").sortWithinPartitions("frag")
    with small_batches(spark):
        signed = stored(parcels.mapInArrow(tying, SIGNED), f"{folder}/signed")
    rows = signed.where("n is not null").drop("a", "b")
    groups = components(signed.where("a is not null").select("a", "b"), f"{folder}/groups")

    owner = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "h2")).alias("o")
    nodes = rows.where("node is not null").groupBy("node").agg(owner, F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("key").alias("key"))
    met = stored(nodes.join(groups.select(F.col("node").alias("key"), "comp"), "key").select("comp", "node", "n", "c", "o.doc_id", "o.h", "o.h2"), f"{folder}/met")
    sizes = met.groupBy("comp").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    members = stored(met.join(sizes, "comp"), f"{folder}/members")
    owned = matching(texts, members, members.count(), "left_semi")
    cut = owned.select("text").mapInArrow(cutting(n), "node binary, segments array<binary>")
    own, against = blocks(members, num, den)
    dealt = own.join(cut, "node").select("comp", "block", "node", "n", "c", F.posexplode("segments").alias("frag", "segment"))
    packed = dealt.repartition("comp", "block", "frag").sortWithinPartitions("comp", "block", "frag", "node").mapInArrow(packing, PACKED)
    keyed = packed.join(against, ["comp", "block"]).select("comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "frag", "block", "nodes", "facts", "segments")
    laid = keyed.repartition("comp", "lo", "hi", "frag").sortWithinPartitions("comp", "lo", "hi", "frag", "block")
    counts = laid.mapInArrow(counting, COUNTED).repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi", "frag")
    found = counts.mapInArrow(summing(num, den, pairs), "a binary, b binary" if pairs else "node binary, linked bigint, to binary")
    with small_batches(spark):
        written = stored(found, f"{folder}/found")
    for name in ("groups", "met", "members"):
        discard(spark, f"{folder}/{name}")
    return rows, written


def in_components(rows: DataFrame, found: DataFrame, folder: str) -> DataFrame:
    """The rows with comp: the same for all that are reachable by links, null for a set without words."""
    comps = components(found.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")), folder)
    return rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def joined(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of docs (doc_id, text).

    Two rows link when their shingle sets' overlap is at least num / den of their union; n_links is the number of other
    rows that a row links with, its copies among them. Null and blank texts have empty sets and link with nothing:
    component_id is their own doc_id. Repeated rows link like copies. Null ids link too, but never name a component
    that has an id. Other columns are left out. An empty table gives no rows.
    """
    rows, found = similar(docs, n, num, den)
    named = in_components(rows, found, shared_folder(docs.sparkSession))
    least = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("first"))
    copies = rows.where("node is not null").groupBy("node").agg((F.count(F.lit(1)) - 1).alias("copies"))
    totals = copies.join(found.groupBy("node").agg(F.sum("linked").alias("linked")), "node", "left")
    links_ = totals.select("node", (F.col("copies") + F.coalesce("linked", F.lit(0))).alias("n_links")).where("n_links > 0")
    first = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("first"))
    whole = named.join(least, "comp", "left").join(links_, "node", "left")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), first.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def links(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) of every row, node naming its distinct set, and (a, b) of every link between different sets, a < b."""
    rows, found = similar(docs, n, num, den, True)
    return rows.select("doc_id", "n", "node"), found


def op5_ngram_jaccard(spark, sf_dir) -> DataFrame:
    """The whole documents table, as joined gives it; see there for nulls, repeated rows and empty tables."""
    return joined(table(spark, sf_dir, "documents"))


def stage(spark, docs, sf_dir) -> DataFrame:
    """One row of each group of five-word shingle sets with a similarity of 0.8 or more: that with the least id.

    Of repeated rows one stays, an id's texts are told apart, and of rows without ids one stays where no other row of
    its group has an id. Null and blank texts link with nothing and all stay. All columns are carried, whatever their names.
    """
    folder = shared_folder(spark)
    rows, found = similar(docs, 5, 80, 100)
    named = in_components(rows.where("node is not null"), found, folder)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), *NAME)).alias("first")
    first = named.groupBy("comp").agg(least, F.count(F.lit(1)).alias("k")).where("k > 1").select("comp", "first")
    stays = F.struct(*NAME).eqNullSafe(F.struct(*[f"first.{c}" for c in NAME]))
    told = named.join(first, "comp").groupBy(*NAME).agg(F.count(F.lit(1)).alias("k"), F.first(stays).alias("stays"))
    gone = stored(told.where("not stays or k > 1"), f"{folder}/gone")  # other rows than a group's first, and firsts that are repeated
    count, held = gone.count(), named_rows(docs, ("text",), F.struct("*").alias("row"))
    one = matching(held, gone.where("stays"), count, "left_semi").groupBy(*NAME).agg(F.first("row").alias("row"))
    return matching(held, gone, count, "left_anti").select("row.*").union(one.select("row.*"))
