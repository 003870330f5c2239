import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from undertext.llm import runs


def all_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j + 1 if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = brute.WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = all_runs(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def told(df):
    return sorted((repr(r.doc_id), (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)) for r in df.collect())


def test_small_alphabets_against_all_periods():
    rng = random.Random(5)
    for _ in range(1500):
        w = [rng.randint(0, rng.choice([0, 1, 2, 4])) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            root = [rng.randint(0, 2) for _ in range(rng.randint(1, 9))]
            w[rng.randint(0, len(w)) :] = root * rng.randint(2, 6) + [rng.randint(0, 2) for _ in range(rng.randint(0, 5))]
        assert [tuple(r) for r in runs.find_runs(w).tolist()] == all_runs(w)


def test_whole_table(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = told(runs.op11_periodic_runs(spark, sf))
    assert got == sorted((repr(r.doc_id), expected(r.doc_id, r.text)) for r in docs.collect())
    assert {n > 0 for _, (n, *_) in got} == {True, False}


ODD = [None, "", " \n", "a", "x x x x x", "x\tx x x\x0bx x", "é é é é é é é é", "a b a b a b a b", "a b " * 5000, " ".join(f"w{i}" for i in range(3000)) + " end" * 7]


@pytest.mark.parametrize("ids", [range(len(ODD)), [None] * len(ODD), [10] * len(ODD)])
def test_odd_texts(spark, tmp_path, ids):
    rows = list(zip(ids, ODD)) * 2
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("z")).write.parquet(f"{tmp_path}/documents.parquet")
    short = [r for r in rows if len(r[1] or "") < 15000]
    got = told(runs.op11_periodic_runs(spark, str(tmp_path)))
    want = sorted((repr(i), expected(i, t)) for i, t in short)
    assert len(got) == len(rows) and all(x in got for x in want)
    whole = [r for r in runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_words == 10000]
    assert all([tuple(x) for x in r.runs] == [(0, 10000, 2)] and r.collapsed == "a b" for r in whole) and len(whole) == 2


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert runs.op11_periodic_runs(spark, str(tmp_path)).collect() == []
