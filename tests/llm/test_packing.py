import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from undertext.llm import packing


def held(lengths, room):
    """Bins as lists of lengths, after checks of places."""
    found = {}
    for size, number, offset, free in zip(lengths, *packing.best_two_fit(lengths, room)):
        found.setdefault(number, []).append((offset, size, free))
    for items in found.values():
        at = 0
        for offset, size, free in sorted(items):
            assert offset == at
            at += size
        assert all(free == room - at >= 0 for *_, free in items)
    return found


def test_two_pieces_fit_better_than_the_smallest():
    bins = held([6, 3, 2, 2], 10)  # greedily 6 + 3; 6 + 2 + 2 fills the bin
    assert sorted(sorted(s for _, s, _ in b) for b in bins.values()) == [[2, 2, 6], [3]]
    assert len(held([6, 3, 2], 10)) == 2  # the single piece of 2 is no pair
    assert held([], 10) == {}


def test_no_worse_than_first_fit_decreasing():
    rng = random.Random(4)
    for _ in range(300):
        room = rng.choice([10, 64, 2048])
        lengths = [rng.randint(1, max(1, int(room * rng.choice([0.2, 0.5, 1])))) for _ in range(rng.randint(0, 150))]
        bins = []
        for x in sorted(lengths, reverse=True):
            i = next((i for i, free in enumerate(bins) if free >= x), None)
            if i is None:
                bins.append(room - x)
            else:
                bins[i] -= x
        assert len(held(lengths, room)) <= len(bins) + len(bins) // 20


def checked(rows, docs):
    """rows of the query against the library's ids of docs (doc_id, text), repeated rows included."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        ends = list(range(len(ids), 0, -2048))[::-1]
        want += [(doc_id, n, a, b - a, zlib.crc32(ids[a:b])) for n, (a, b) in enumerate(zip([0, *ends], ends))]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in places.values():
        ends = [0]
        for offset, length in sorted(items):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    return len(places), -(-sum(w[3] for w in want) // 2048)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    n, least = checked(packing.op12_best_fit_packing(spark, sf).collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert n <= least * 1.01 + 1


LONG = " ".join(f"w{i}" for i in range(4000))
ODD = [(1, None), (2, ""), (3, "a b"), (None, "a b"), (None, None), (3, "a b"), (4, LONG), (4, LONG), (5, "é <|endoftext|> 中文"), *[(10 + i, "x " * (37 * i % 900)) for i in range(150)]]


@pytest.mark.parametrize("a_shard", [20, 8192])
def test_odd_rows_and_sequences(spark, a_shard):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("shard", F.lit("z")).withColumn("length", F.lit(3))
    pieces, places = packing.pack(spark, docs, a_shard=a_shard)
    rows = places.collect()
    n, least = checked(rows, ODD)
    assert n <= least + max(1, len(rows) // a_shard)
    whole = packing.sequences(pieces, places).collect()
    assert len(whole) == n
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.ids_crc32))
    for r in whole:
        assert [(o, zlib.crc32(np.frombuffer(b, dtype=f"<u{w}").astype("<u4"))) for o, w, b in zip(r.offsets, r.widths, r.ids)] == sorted(by_sequence[r.sequence_id])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert packing.op12_best_fit_packing(spark, str(tmp_path)).collect() == []
