import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from undertext.llm import lm

PATH = public_tokenizers.path("piece_bpe_32k.model")


def uses(rows):
    batch = pa.RecordBatch.from_pydict({"word": [w for w, _ in rows], "c": pa.array([c for _, c in rows], pa.int64())})
    (out,) = lm.expected(PATH)(iter([batch]))
    return {k: u for k, u in zip(out["piece"].to_pylist(), out["uses"].to_pylist()) if k >= 0}


def test_bytes_are_learnt():
    _, bytes_, _ = lm.vocabulary(PATH)
    got = uses([("\U00012345", 7)])
    assert [got[bytes_[b]] for b in "\U00012345".encode()] == pytest.approx([7.0 * n for n in (1, 1, 1, 1)])


def test_no_word_is_too_long_or_too_rare():
    _, bytes_, _ = lm.vocabulary(PATH)
    rare = "\U00012345" * 300
    assert uses([(rare, 2)])[bytes_[0xF0]] == pytest.approx(600)
    whole = uses([("ab" * 300, 1)])
    pieces, _, _ = lm.vocabulary(PATH)
    length = {i: len(p) for p, i in pieces.items()}
    assert sum(length[k] * u for k, u in whole.items() if k in length) == pytest.approx(601)


def test_logarithms_agree_with_plain_sums(monkeypatch):
    pieces, bytes_, p = lm.vocabulary(PATH)
    text = lm.MARK + "internationally\U00012345x"
    plain, logs = {}, {}
    lm.add_uses(text, 3, plain, pieces, bytes_, p)
    monkeypatch.setattr(lm, "PLAIN", 0)
    lm.add_uses(text, 3, logs, pieces, bytes_, p)
    assert plain == pytest.approx(logs) and len(plain) > 20


def splits(text, pieces, bytes_, p):
    """Every segmentation of text by plain recursion: the sum of their probabilities."""
    if not text:
        return 1.0
    total = sum(p[pieces[text[:n]]] * splits(text[n:], pieces, bytes_, p) for n in range(1, len(text) + 1) if pieces.get(text[:n], -1) >= 0)
    if pieces.get(text[0], -1) < 0:
        spelt = 1.0
        for b in text[0].encode():
            spelt *= p[bytes_[b]]
        total += spelt * splits(text[1:], pieces, bytes_, p)
    return total


WORDS = ["a", "the", "nation", "internat", "caf\u00e9", "x\U00012345y", "\U00012345", "\u0434\u0430", "zq9", "-", "\0", "ab" * 95, "ab" * 150, "\U00012345" * 60]


def test_lattices_against_enumeration_and_the_plain_recursion():
    pieces, bytes_, p = lm.vocabulary(PATH)
    got = lm.lattice_log10(WORDS, PATH, np.array(p))
    for word, x in zip(WORDS, got):
        assert x == pytest.approx(lm.log10_word(word, pieces, bytes_, p))
        if len(word) < 10:
            assert 10**x == pytest.approx(splits(lm.MARK + word, pieces, bytes_, p))


def test_uses_by_array_and_by_word():
    pieces, bytes_, p = lm.vocabulary(PATH)
    want = {}
    for i, w in enumerate(WORDS):
        lm.add_uses(lm.MARK + w, i + 1, want, pieces, bytes_, p)
    assert uses([(w, i + 1) for i, w in enumerate(WORDS)]) == pytest.approx(want)


def test_score_of_a_small_corpus_step_by_step(spark):
    """The whole model anew in plain Python, with every segmentation listed."""
    rows = [(i, t) for i, t in enumerate(["a cat sat", "A cat ran on", "", None, "the cat  the mat", "on on \u00e9", "a dog", "new words here", "cat", "mat ran"])] + [(None, "a cat")]
    got = {r.doc_id: r for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    assert len(got) == len(rows)
    pieces, bytes_, first = lm.vocabulary(PATH)
    held = {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 == 2}
    lower = lambda t: (t or "").lower().split()
    c, ends = Counter(w for i, t in rows if i not in held for w in lower(t)), sum(i not in held for i, _ in rows)
    p, before = first, None
    for _ in range(lm.STEPS):
        use = {}
        for w in c:
            lm.add_uses(lm.MARK + w, c[w], use, pieces, bytes_, p)
        like = sum(c[w] * math.log10(splits(lm.MARK + w, pieces, bytes_, p)) for w in c)
        p = [(use.get(i, 0.0) + first[i]) / (sum(use.values()) + 1) for i in range(len(first))]
        if before is not None and like - before < lm.REST * abs(before):
            break
        before = like
    once, twice = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    d = once / (once + 2 * twice) if once and twice else 0.75
    n, v = sum(c.values()) + ends + 1, len(c) + 1
    for i, t in rows:
        end, by_lattice = math.log10((ends + 1 - d) / n), {w: splits(lm.MARK + w, pieces, bytes_, p) for w in lower(t)}
        assert got[i].score == pytest.approx(end + sum(math.log10(by_lattice[w]) for w in lower(t))) and got[i].held_out is (i in held)
        assert got[i].word_score == pytest.approx(end + sum(math.log10(max(c[w] - d, 0) / n + d * v / n * by_lattice[w]) for w in lower(t)))


def test_nothing_to_learn_from(spark):
    assert lm.scored(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    i = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = lm.scored(spark.createDataFrame([(i, "one two")], "doc_id long, text string"), PATH).collect()
    assert r.held_out and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score)


def test_no_sum_underflows():
    pieces, bytes_, p = lm.vocabulary(PATH)
    words = ["\U00012345" * 190, "\U00012345" * 500]
    got = lm.lattice_log10(words, PATH, np.array(p) * 1e-3)
    assert got[0] < -2000 and got[1] / got[0] == pytest.approx(500 / 190, rel=0.01)


def test_fitted_weights_hold_out_better_than_the_first(spark):
    """Held-out words of the documents are likelier under fitted weights, and known words under the word unigram too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in lm.scored(docs, PATH).collect() if r.held_out]
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = [(r, (texts[r.doc_id] or "").encode().lower().decode().split()) for r in rows]
    first = lm.lattice_log10([w for _, ws in words for w in ws], PATH, np.array(lm.vocabulary(PATH)[2])).sum()
    assert sum(r.score for r in rows) > 0.85 * first and sum(r.word_score for r in rows) > sum(r.score for r in rows)
    assert sum(r.score for r in rows) / sum(r.n_tokens for r in rows) > -5.4
