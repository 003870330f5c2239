"""Token counts by rank-synchronous merging of arrays.

A batch's distinct pre-tokens lie end to end in one array of symbol ids. In every round, each pre-token finds the
lowest rank among its neighbouring pairs, and all places of that pair merge at once, in all pre-tokens together.
A merge's rank lies above those that made its parts, so no pair that such a round creates could have gone before the
rest of it: the result is that of merging one pair at a time. Where a pair overlaps itself, places count from the
left. Once no pair has a rank, the symbols that are left are counted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertext.llm.common import table
from undertext.llm.tokens import PLAIN, REMEMBERED, library, require, special_strings

#: The pre-token pattern of the published vocabulary, over the lower-cased characters of PLAIN.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: The settings of files with that pattern.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [SPLIT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
LIMIT = 2048
NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[int, str]:
    """The printable stand-ins of the byte-level alphabet: printable Latin-1 stands for itself, the rest from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class MergeTable:
    """Symbols and ranked merges of a vocabulary file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end, vocabulary = model.get("end_of_word_suffix") or "", model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        letters = byte_letters()
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocabulary[letters[b] + end] for b in range(256)], dtype=np.int64)
        self.bytes_of = {c: b for b, c in letters.items()}
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order
        self.made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that are left of each non-empty pre-token."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        left = sizes.copy()
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[raw[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        while len(symbols) > 1:
            rank = np.where(owner[1:] == owner[:-1], self.ranks(symbols[:-1], symbols[1:]), NONE)
            rank = np.append(rank, NONE)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            wide = np.diff(np.append(first, len(symbols)))
            active = np.repeat(lowest != NONE, wide)
            hit = (rank == np.repeat(lowest, wide)) & active
            if not hit.any():
                break
            place = np.flatnonzero(hit)
            run = np.flatnonzero(np.append(True, np.diff(place) != 1))
            offset = np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))
            place = place[offset % 2 == 0]
            symbols[place] = self.made[rank[place]]
            np.subtract.at(left, owner[place], 1)
            keep = active
            keep[place + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return left


class TokenCounter:
    """Counts of whole texts, as the library's encode(text, add_special_tokens=False) has them."""

    def __init__(self, path: str):
        self.tokenizer, self.table = library(path), MergeTable(path)
        require(path, self.tokenizer, normalizer=NORMALIZER, pre_tokenizer=PRE_TOKENIZER)
        self.special = special_strings(self.tokenizer)
        self.known: dict[str, int] = {}

    def split(self, text: str) -> tuple[int, list[str]]:
        """Special strings in the text, and its pre-tokens; those of the slow way begin with a zero character."""
        if PLAIN.fullmatch(text) and not (self.special and self.special.search(text)):
            return 0, WORDS.findall(text.lower())
        parts = self.special.split(text) if self.special else [text]
        normal = [self.tokenizer.normalizer.normalize_str(p) for p in parts if p]
        return len(parts) - 1, ["\0" + w for p in normal for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(p)]

    def bytes_of(self, word: str) -> bytes:
        return bytes(self.table.bytes_of[c] for c in word[1:]) if word[0] == "\0" else word.encode()

    def __call__(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [self.split(t) for t in texts]
        new = list(set(chain.from_iterable(w for _, w in split)).difference(self.known))
        if new:
            self.known.update(zip(new, self.table.counts([self.bytes_of(w) for w in new]).tolist()))
        get = self.known.__getitem__
        return [n + sum(map(get, words)) for n, words in split]


_counters: dict[str, TokenCounter] = {}


def counting(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = TokenCounter(path)
        count = _counters[path]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                texts = [t or "" for t in piece["text"].to_pylist()]
                n = count(texts)
                columns = [piece["doc_id"], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs (doc_id, text).

    path: a byte-level BPE vocabulary file with word ends, whose texts are split as WORDS does; others raise. Null text is empty and has no tokens; special strings in a
    text are one token each; repeated rows and null ids are counted like others; an empty table gives no rows.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(counting(path, limit), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op4_token_counts(spark, sf_dir) -> DataFrame:
    """The whole documents table, as token_counts gives it; see there for nulls, repeated rows and empty tables."""
    return token_counts(table(spark, sf_dir, "documents"))
