"""Encoders that remember pre-tokens, for use inside tasks.

The texts of a batch lie end to end as bytes. Where pre-tokens begin follows from the classes of neighbouring bytes, by
array; their distinct ones are found by Arrow, and the library's model encodes those that the worker has not met. Ids
are then laid out by array. Between two spaces that surely begin pre-tokens, a stretch with any character beyond
printable ASCII and Latin letters goes to the library as it is; texts with a special string do so as a whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from undertext.llm.common import free_memory

#: Texts made of these only are split without the library.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: Fixed value: the setting of files whose texts are split as by `beginnings`.
BYTE_LEVEL_SETTING = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: How byte-level vocabularies write bytes that are not printable, numbered from 256 in ascending order.
SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
CHARACTERS = np.array([0, *(SHOWN.get(b, b) for b in range(1, 256))], dtype="<u4")  # 0, which no pre-token has, stands between them
#: Bytes of text that are worked on at once, one text at least.
AT_ONCE = 1 << 20
#: Beyond this number a worker forgets pre-tokens, at first those that only one batch had; only speed depends on it.
REMEMBERED = 400_000
#: Classes of the bytes of PLAIN: its letters beyond ASCII are C3 and a byte from 80 on, without the two signs 97 and B7.
OTHER, LETTER, DIGIT, MARK, BLANK, SPACE = range(6)
CLASS = np.zeros(256, dtype=np.uint8)
CLASS[0x21:0x7F] = MARK
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = LETTER
CLASS[0x30:0x3A], CLASS[[9, 10, 13]], CLASS[0x20] = DIGIT, BLANK, SPACE

_open: dict[str, object] = {}


def library(path: str):
    """The tokenizer of a file, opened once a worker."""
    if path not in _open:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _open[path] = Tokenizer.from_file(path)
    return _open[path]


def require(path: str, tokenizer, **parts) -> None:
    """Raises where a tokenizer's normalizer or pre_tokenizer isn't the one that is split by here."""
    for name, wanted in parts.items():
        part = getattr(tokenizer, name)
        if (part and json.loads(part.__getstate__())) != wanted:
            raise ValueError(f"{path}: texts are not split as by its {name}")


def special_strings(tokenizer) -> re.Pattern | None:
    found = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
    return re.compile("|".join(sorted(found, key=len, reverse=True))) if found else None


def laid_out(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[b : b + n] for each b and n of begin and size, joined."""
    ends = np.cumsum(size)
    kind = np.int32 if len(flat) < 1 << 30 else np.int64
    at = np.repeat((begin - ends + size).astype(kind), size)
    at += np.arange(len(at), dtype=kind)
    return flat[at]


def beginnings(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens of texts begin; raw: their bytes end to end, offsets: where each begins, and the end of all.

    The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?digits| ?marks|\\s+(?!\\S)|\\s+ from left to right. So a pre-token begins
    where the class changes, but behind a space. White space ahead of other characters gives up its last one, and all of
    it stays together at the end of a text. An apostrophe takes letters along unless marks or a space stand before it.
    """
    if not len(raw):
        return np.empty(0, dtype=np.int64)
    kind = CLASS[raw]
    first = np.zeros(len(raw) + 3, dtype=bool)
    first[offsets] = True
    begins = np.empty(len(raw), dtype=bool)
    begins[0] = True
    np.logical_and(kind[1:] != kind[:-1], kind[:-1] != SPACE, out=begins[1:])
    white = np.flatnonzero(kind >= BLANK)
    begins[white] = ~(kind[white - 1] >= BLANK) | ~first[white + 1] & ~(kind[np.minimum(white + 1, len(raw) - 1)] >= BLANK)
    begins |= first[: len(raw)]
    quotes = np.flatnonzero(raw == 0x27)
    quotes = quotes[begins[quotes] & ~first[quotes + 1]]
    if len(quotes):
        after, then = raw[quotes + 1], np.where(first[quotes + 2], 0, raw[np.minimum(quotes + 2, len(raw) - 1)])
        one = np.isin(after, np.frombuffer(b"stmd", dtype=np.uint8))
        two = (after == 0x72) & (then == 0x65) | (after == 0x76) & (then == 0x65) | (after == 0x6C) & (then == 0x6C)
        begins[quotes[one | two] + 1] = False
        ends = np.append(quotes[one] + 2, quotes[two] + 3)
        begins[ends[ends < len(raw)]] = True
    odd = kind == OTHER
    if odd.any():
        spaces = np.flatnonzero(kind == SPACE)
        visible = np.append((raw > 0x20) & (raw < 0x7F), False)
        sure = spaces[visible[spaces - 1] & (spaces > 0) & ~first[spaces] | visible[spaces + 1] & ~first[spaces + 1]]
        stretch = np.union1d(sure, np.flatnonzero(first[: len(raw)]))
        held = np.logical_or.reduceat(odd, stretch)
        begins &= ~np.repeat(held, np.diff(np.append(stretch, len(raw))))
        begins[stretch] = True
    return np.flatnonzero(begins)


def strings_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings, end to end, and where each begins, with the end of all; none may be null."""
    _, ends, data = words.buffers()
    offsets = np.frombuffer(ends, dtype=np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, dtype=np.int32)
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class ByteLevelEncoder:
    """The ids of whole texts, as the library's encode(text, add_special_tokens=False) has them."""

    def __init__(self, path: str):
        self.tokenizer = library(path)
        require(path, self.tokenizer, normalizer=None, pre_tokenizer=BYTE_LEVEL_SETTING)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.begin, self.size, self.batches = np.empty(0, dtype=self.kind), *(np.empty(0, dtype=np.int64) for _ in range(3))
        free_memory()

    def forget_some(self) -> None:
        """Keeps the pre-tokens that more than one batch had, unless they are too many."""
        often = np.flatnonzero(self.batches > 1)
        if len(often) > REMEMBERED // 2:
            return self.forget()
        words = list(self.place)  # in the order of their places
        self.place = dict(zip(map(words.__getitem__, often.tolist()), range(len(often))))
        self.flat, self.size = laid_out(self.flat, self.begin[often], self.size[often]), self.size[often]
        self.begin, self.batches = np.cumsum(self.size) - self.size, np.ones(len(often), dtype=np.int64)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """An array of ids for each text; null is empty."""
        texts, out = texts.fill_null(""), []
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
            out += self.some(texts.slice(at, until - at).cast(pa.string()))
            at = until
        return out

    def some(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.place) > REMEMBERED:
            self.forget_some()
        texts.validate(full=True)  # bytes that are no UTF-8 raise, as in the library
        whole = np.zeros(len(texts), dtype=bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        raw, offsets = strings_of(texts.filter(pa.array(~whole)) if whole.any() else texts)
        begin = beginnings(raw, offsets)
        words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(raw)).astype(np.int32)), pa.py_buffer(raw)])
        found = words.dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn([w for w in distinct if w not in self.place])
        places = np.fromiter(map(self.place.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        self.batches[places] += 1
        places = places[found.indices.to_numpy()]
        sizes = self.size[places]
        ids, ends = laid_out(self.flat, self.begin[places], sizes), np.append(0, np.cumsum(sizes))[np.searchsorted(begin, offsets)].tolist()
        simple = iter(zip(ends[:-1], ends[1:]))
        if not whole.any():
            return [ids[a:b] for a, b in simple]
        return [np.array(self.tokenizer.encode(t.as_py(), add_special_tokens=False).ids, dtype=self.kind) if w else ids[slice(*next(simple))] for t, w in zip(texts, whole.tolist())]

    def learn(self, words: list[bytes]) -> None:
        """Remembers the ids of new pre-tokens and odd stretches."""
        if not words:
            return
        raw, sizes = np.frombuffer(b"".join(words), dtype=np.uint8), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        odd = np.logical_or.reduceat(CLASS[raw] == OTHER, np.cumsum(sizes) - sizes).tolist()
        for keys, call in (([w for w, o in zip(words, odd) if not o], self.pre_tokens), ([w for w, o in zip(words, odd) if o], self.stretches)):
            if keys:
                self.keep(keys, call(keys))

    def keep(self, keys: list[bytes], got: list[list[int]]) -> None:
        ids, sizes = np.fromiter(chain.from_iterable(got), dtype=self.kind), np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        self.place.update(zip(keys, range(len(self.place), len(self.place) + len(keys))))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat, self.size = np.concatenate([self.flat, ids]), np.concatenate([self.size, sizes])
        self.batches = np.append(self.batches, np.zeros(len(keys), dtype=np.int64))

    def pre_tokens(self, keys: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens, whose bytes the library's model takes as characters."""
        shown = CHARACTERS[np.frombuffer(b"\0".join(keys), dtype=np.uint8)].tobytes().decode("utf-32-le").split("\0")
        return [[t.id for t in found] for found in map(self.model.tokenize, shown)]

    def stretches(self, keys: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([k.decode() for k in keys], add_special_tokens=False)]


def encoder(path: str) -> ByteLevelEncoder:
    key = f"encoder:{path}"
    if key not in _open:
        _open[key] = ByteLevelEncoder(path)
    return _open[key]
