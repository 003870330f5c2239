import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from undertext.llm import common, jaccard, tokens, tokenstore

PATH = public_tokenizers.path("byte_bpe_50k.json")
KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_workers_get_small_batches_of_long_texts(spark, tmp_path):
    def batch_bytes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["bytes", "n"])

    texts = spark.range(0, 64, 1, 1).selectExpr("repeat(cast(id % 10 as string), 1 << 19) as text")
    with common.small_batches(spark):
        found = common.stored(texts.mapInArrow(batch_bytes, "bytes bigint, n bigint"), f"file://{tmp_path}/b").collect()
    assert sum(r.n for r in found) == 64
    assert max(r.bytes for r in found) <= common.BATCH + (1 << 20)


def test_the_size_of_batches_is_put_back_and_that_of_the_session_holds(spark):
    with common.small_batches(spark):
        assert spark.conf.get(KEY) == str(common.BATCH)
    assert spark.conf.get(KEY, None) is None
    spark.conf.set(KEY, "12345678")
    try:
        with common.small_batches(spark):
            assert spark.conf.get(KEY) == "12345678"
        assert spark.conf.get(KEY) == "12345678"
    finally:
        spark.conf.unset(KEY)


def held_at_most(call, *given):
    tracemalloc.start()
    try:
        call(*given)
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_encoder_and_shingles_hold_little_beside_a_batch(monkeypatch):
    texts = pa.array(["some words of a text, again and again. " * 100] * 2500)  # 10 MB
    encode = tokens.ByteLevelEncoder(PATH)
    encode(texts.slice(0, 1))
    monkeypatch.setattr(jaccard, "_powers", [])
    assert held_at_most(encode, texts) < 40
    assert held_at_most(lambda: jaccard.gram_sets(texts, 5)) < 40


def test_stores_are_written_and_sets_signed_in_small_batches(spark, tmp_path, monkeypatch):
    seen = []
    for module in (tokenstore, jaccard):
        monkeypatch.setattr(module, "stored", lambda df, folder, *by: seen.append(df.sparkSession.conf.get(KEY, None)) or common.stored(df, folder, *by))
    docs = spark.createDataFrame([(1, "one text"), (2, "one text"), (3, None)], "doc_id long, text string")
    tokenstore.write_store(docs, PATH, 2, f"file://{tmp_path}/s")
    assert seen[0] == str(common.BATCH)
    seen.clear()
    assert jaccard.joined(docs).count() == 3
    assert seen[0] == str(common.BATCH) and seen.count(str(common.BATCH)) == 2


def test_overlaps_of_two_whole_blocks_hold_little():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 6000, 100, dtype=np.uint64)) for _ in range(2 * jaccard.BLOCK)]
    left, right = sets[: jaccard.BLOCK], sets[jaccard.BLOCK :]
    out = []
    assert held_at_most(lambda: out.append(jaccard.overlaps(left, right))) < 45
    for i, j in ((0, 0), (5, 900), (1023, 1023)):
        assert out[0][i, j] == len(np.intersect1d(left[i], right[j]))


def test_workers_give_memory_back_after_comparing(monkeypatch):
    freed = []
    monkeypatch.setattr(jaccard, "free_memory", lambda: freed.append(1))
    for work in (jaccard.packing, jaccard.counting, jaccard.summing(80, 100, False)):
        assert list(work(iter(()))) == []
    assert len(freed) == 3
