import collections
import itertools
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from undertext.llm import jaccard


def shingles(text, n):
    w = brute.WORD.findall((text or "").translate(brute.FOLD))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset({tuple(w)} if w else ())


def test_jaccard_counts_every_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    texts = [None, "", "one", "alone in the world"]
    for k in range(60):
        words = [f"g{i}" for i in range(400)]
        for j in range(k % 5):
            words[(k * 7 + j * 16) % 400] = f"v{k}"
        texts.append(" ".join(words))
    texts += texts[-3:] * 2
    rows = list(enumerate(texts))
    sets = [shingles(t, 3) for t in texts]
    want, pairs = collections.Counter(), set()
    for i, j in itertools.combinations(range(len(rows)), 2):
        o = len(sets[i] & sets[j])
        if o and 100 * o >= 90 * len(sets[i] | sets[j]):
            want.update((i, j))
            pairs |= {frozenset((sets[i], sets[j]))} if sets[i] != sets[j] else set()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.joined(df).collect()
    assert sorted(tuple(r)[:3] for r in got) == brute.jaccard(rows)
    assert {r.doc_id: r.n_links for r in got} == {i: want[i] for i, _ in rows}
    assert len(pairs) > 500
    named, between = jaccard.links(df)
    by_node = {r.node: sets[r.doc_id] for r in named.collect() if r.node is not None}
    found = between.collect()
    assert len(found) == len(pairs) and {frozenset((by_node[r.a], by_node[r.b])) for r in found} == pairs


def test_jaccard_survivors_go_by_row(spark):
    def near(name, changed=()):
        return " ".join(f"v{i}" if i in changed else f"{name}{i}" for i in range(150))

    a, b, c, d = (near(x) for x in "abcd")
    rows = [(1, a), (1, a), (2, near("a", [3])), (5, b), (3, near("b", [5])), (5, c), (None, c), (None, d), (None, d), (None, near("d", [9])), (None, None), (7, ""), (7, "")]
    kept = jaccard.stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    kept = sorted(map(tuple, kept), key=str)
    ds = [r for r in kept if r[1] and "d7 " in r[1]]
    assert len(ds) == 1 and ds[0][0] is None
    assert sorted((r for r in kept if r not in ds), key=str) == sorted([(1, a), (3, near("b", [5])), (5, c), (None, None), (7, ""), (7, "")], key=str)


def test_jaccard_null_ids_link_and_bridge(spark):
    def words(changed):
        return " ".join(f"v{i}" if i in changed else f"g{i}" for i in range(150))

    rows = [(1, words({10, 40})), (2, words({20, 50})), (None, words(()))]  # 1 and 2 link through the null id alone
    got = {(r.doc_id, r.component_id) for r in jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (None, 1)}


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100), (1, 1, 2), (2, 1, 1)])
def test_jaccard_of_small_and_borderline_sets(spark, n, num, den):
    rng = random.Random(n)
    texts = []
    for k in range(150):  # families of one to forty words with words changed, put in and left out
        words = [f"f{k}w{i}" for i in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 11, 20, 40]))]
        for _ in range(rng.randrange(2, 7)):
            copy = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 6)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = rng.choice([[], [f"x{rng.randrange(9)}"]])
                copy = copy or ["x"]
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    got = sorted(tuple(r)[:3] for r in jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string"), n, num, den).collect())
    assert got == brute.jaccard(rows, n, num, den)


def test_jaccard_of_two_thousand_near_copies(spark):
    rng = random.Random(3)
    base = [f"g{i}" for i in range(120)]
    texts = []
    for k in range(2000):
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(120)] = f"v{rng.randrange(50)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    got = sorted(map(tuple, jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert [r[:3] for r in got] == brute.jaccard(rows)
    sets = [shingles(t, 3) for t in texts]
    for i in range(0, 2000, 97):
        assert got[i][3] == sum(100 * len(sets[i] & s) >= 90 * len(sets[i] | s) for j, s in enumerate(sets) if j != i)


def test_words_are_split_and_folded_as_the_contract_says():
    texts = [None, "", " \n", "a", "a b", "A\x0bB\tc\r\n d ", "É é x\xa0y\x85z \x1c q", "end", "of the text"]
    hashes, at = jaccard.word_hashes(pa.array(texts))
    names = {}
    for i, t in enumerate(texts):
        words = brute.WORD.findall((t or "").translate(brute.FOLD))
        assert len(words) == at[i + 1] - at[i]
        for w, h in zip(words, hashes[at[i] : at[i + 1]].tolist()):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("k", [1, 1000, 2000, 8000])
def test_rows_of_a_group_grow_with_its_blocks_alone(spark, k):
    members = spark.range(k).select(F.lit(1).cast("long").alias("comp"), F.col("id").cast("string").cast("binary").alias("node"), (F.lit(100) + F.col("id") % 3).alias("n"), F.lit(1).cast("long").alias("c"), F.lit(k).cast("long").alias("k"))
    own, pairs = jaccard.blocks(members, 90, 100)
    n_blocks = own.select("block").distinct().count()
    assert own.count() == k and n_blocks <= -(-k // jaccard.BLOCK) + 3 and pairs.count() <= n_blocks**2
    assert {(r.block, r.other) for r in pairs.collect()} >= {(r.block, r.block) for r in own.select("block").distinct().collect()}


def test_fragments_share_the_first_runs_evenly():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in rng.integers(20, 400, 3000)]
    _, begin, sig = jaccard.runs(sets, 90, 100)
    place = jaccard.fragment(begin, 90, 100, 256)
    sizes = np.bincount(place, minlength=256)
    assert sig.dtype == np.uint64 and place.min() >= 0 and place.max() <= 255 and sizes.max() < 3 * len(place) / 256
    assert (np.diff(jaccard.fragment(np.sort(begin), 90, 100, 256)) >= 0).all()
    assert set(jaccard.fragment(np.array([0, (1 << 64) - 1], dtype=np.uint64), 1, 2, 7).tolist()) == {0, 6}
