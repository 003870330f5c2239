import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from undertext.llm import tokens, tokenstore

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = ["a", "bc", "'s", "'ll", "'re", "'v", "'", "'t", "r", "e", "the", " ", " ", "  ", "\n", "\t", "\r\n", "é", "ñ", "ß", "1", "23", ".", "!?", "|", "_"]
ODD = ["中文", " ", "　", "\x1c", "\x7f", "\x85", "​", "ª", "²", "×", "÷", "Ⅷ", "١", "🙂", "\0", "<|endoftext|>"]


class Counted:
    """The library's model, with the pre-tokens that it was asked for."""

    def __init__(self, model):
        self.model, self.asked = model, []

    def tokenize(self, word):
        self.asked.append(word)
        return self.model.tokenize(word)


@pytest.mark.parametrize("alphabet", [PLAIN, PLAIN + ODD, PLAIN + [" "] * 20 + ["'"] * 8, PLAIN + ["中", "　"] * 8])
def test_texts_are_split_as_by_the_library(alphabet):
    rng = random.Random(7)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(18))) for _ in range(4000)] + [None, "", " ", "  ", "\n", "'", "'s", "'r", "x'", "x'r", "x'l"]
    library = tokens.library(PATH)
    for kind in (pa.string(), pa.large_string()):
        for text, ids in zip(texts[1:], tokens.ByteLevelEncoder(PATH)(pa.array(texts, kind).slice(1)), strict=True):
            assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_pre_tokens_that_come_back_are_asked_for_once(monkeypatch):
    """Also where a worker has met more than it remembers: what several batches had is kept."""
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    encode = tokens.ByteLevelEncoder(PATH)
    encode.model = Counted(encode.model)
    for n in range(20):
        texts = [f"common words stay, rare ones such as x{'abcdefghij'[n % 10] * (k + n + 2)} go" for k in range(10)]
        assert [x.tolist() for x in encode(pa.array(texts))] == [tokens.library(PATH).encode(t, add_special_tokens=False).ids for t in texts]
    assert encode.model.asked.count("Ġcommon") + encode.model.asked.count("common") == 1
    assert encode.model.asked.count("Ġwords") == 1


def test_bytes_that_are_no_utf8_raise():
    broken = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, 2], dtype=np.int32)), pa.py_buffer(b"a\x80")])
    with pytest.raises(ValueError):
        tokens.ByteLevelEncoder(PATH)(broken)


def test_chunks_of_streams_end_to_end_are_those_of_each():
    rng = np.random.default_rng(3)
    streams = [rng.integers(0, top, size).astype("<u2") for top in (40, 50_000) for size in (1, 2, 3, 127, 128, 129, 3000, 9000, 40_000)]
    ends = np.cumsum([len(x) for x in streams]).tolist()
    found = tokenstore.cuts(np.concatenate(streams), ends)
    for ids, own, start in zip(streams, found, [0, *ends]):
        assert [x - start for x in own] == tokenstore.cuts(ids, [len(ids)])[0]
        sizes = np.diff([start, *own])
        assert sizes.sum() == len(ids) and sizes.max() <= tokenstore.MOST and (sizes[:-1] >= tokenstore.LEAST).all()


def test_crcs_of_equal_lengths_take_one_multiplication_each(monkeypatch):
    bodies = [bytes([k]) * 4600 for k in range(50)]
    tokenstore.crc_of_joined(0, 0, 4600)
    calls, times = [], tokenstore._times
    monkeypatch.setattr(tokenstore, "_times", lambda a, b: calls.append(1) or times(a, b))
    for a, b in zip(bodies, bodies[1:]):
        assert tokenstore.crc_of_joined(zlib.crc32(a), zlib.crc32(b), 4600) == zlib.crc32(a + b)
    assert len(calls) == len(bodies) - 1
