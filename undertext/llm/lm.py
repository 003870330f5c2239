"""Language-model scoring by the marginal likelihood of a subword lattice.

The pieces and first weights are those of an existing vocabulary (weight falls with the piece's rank). Expectation
maximisation over every training word, by its count, fits the weights, step after step, until a step lifts the words'
likelihood by less than REST of itself. A word's probability over all its segmentations is the sum of the forward
recursion, in logarithms. A text's score adds its words and one end token. The base is the word unigram with add-one
smoothing; word_score is a word unigram with absolute discounting (d follows from the numbers of words seen once and
twice) that spells words by the lattice with what is left.

Words are counted once for the whole corpus. Each tile of documents (a part of an input split, bounded in bytes) asks
for its own distinct words, and its documents are scored against that dictionary, so no token is joined by itself.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertext.llm.common import blank_split, lower_ascii, shared_folder, stored, table

FOLDS, HELD = 7, 2
PLAIN, TINY = 200, 1e-120
#: Fitting rests at a step that gains less than this share of the likelihood, or after so many steps.
REST, STEPS = 0.004, 12
#: Bytes of words that are gathered, and their characters worked on at once.
GATHER, CHARS = 1 << 21, 1 << 17
#: Bytes of an input file in one tile.
TILE = 16 << 20
MARK = "▁"
_lattices: dict[str, tuple[dict[str, int], list[int], list[float]]] = {}
_tables: dict[str, Table] = {}


def vocabulary(path: str) -> tuple[dict[str, int], list[int], list[float]]:
    """Pieces to ids (-1: only the beginning of a piece), the ids of the byte pieces, and first probabilities from the scores' order."""
    if path not in _lattices:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        order = sorted(range(size), key=lambda i: (-sp.get_score(i), i))
        weight = [0.0] * size
        for rank, i in enumerate(order):
            weight[i] = 1.0 / (rank + 10)
        total = sum(weight)
        bytes_ = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        skip = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        pieces = {sp.id_to_piece(i): i for i in range(size) if i not in skip}
        for piece in list(pieces):
            for j in range(1, len(piece)):
                pieces.setdefault(piece[:j], -1)
        _lattices[path] = pieces, bytes_, [w / total for w in weight]
    return _lattices[path]


def arcs_from(text: str, i: int, pieces: dict[str, int], bytes_: list[int], p: list[float]) -> list[tuple[int, int, float]]:
    """(end, piece, probability) of what may begin at i; a character without a piece is spelt in bytes (piece -1)."""
    out = []
    for j in range(i + 1, len(text) + 1):
        k = pieces.get(text[i:j])
        if k is not None and k >= 0:
            out.append((j, k, p[k]))
        elif j == i + 1:
            out.append((j, -1, math.prod(p[bytes_[b]] for b in text[i].encode())))
        if k is None:
            break
    return out


@dataclass(frozen=True)
class Table:
    """The pieces and their beginnings as a tree: node is entered from parent by a character; found by an open hash table."""

    keys: np.ndarray  # parent << 21 | character
    nodes: np.ndarray
    shift: int
    piece: np.ndarray  # a node's piece, -1 without one
    longest: int

    def steps(self, parents: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The nodes behind parents by chars, -1 where there is none."""
        wanted = parents << 21 | chars
        at = slots(wanted, self.shift)
        out = np.full(len(wanted), -1, dtype=np.int64)
        left = np.arange(len(wanted))
        while len(left):
            met = self.keys[at]
            same = met == wanted
            out[left[same]] = self.nodes[at[same]]
            on = ~same & (met >= 0)
            left, wanted, at = left[on], wanted[on], at[on] + 1 & len(self.keys) - 1
        return out


def slots(keys: np.ndarray, shift: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(shift)).astype(np.int64)


def tree(path: str) -> Table:
    if path not in _tables:
        pieces, _, _ = vocabulary(path)
        number = {"": 0} | {text: i for i, text in enumerate(sorted(pieces), 1)}
        bits = (4 * len(number)).bit_length()
        keys, nodes = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int64)
        all_keys = np.array([number[t[:-1]] << 21 | ord(t[-1]) for t in pieces], dtype=np.int64)
        for key, at, text in zip(all_keys.tolist(), slots(all_keys, 64 - bits).tolist(), pieces):
            while keys[at] >= 0:
                at = at + 1 & (1 << bits) - 1
            keys[at], nodes[at] = key, number[text]
        piece = np.full(len(number), -1, dtype=np.int64)
        piece[[number[t] for t in pieces]] = list(pieces.values())
        _tables[path] = Table(keys, nodes, 64 - bits, piece, max(map(len, pieces)))
    return _tables[path]


class Lattices:
    """The lattices of words of one length, as an array (word, position) of pieces for each length of arc.

    Characters without a piece are numbered from size on, and spelt[number - size] has their byte pieces; -1: no arc.
    """

    def __init__(self, texts: list[str], path: str):
        t, (_, bytes_, first) = tree(path), vocabulary(path)
        self.size, self.spelt = len(first), []
        self.shape = len(texts), len(texts[0])
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        place = np.arange(len(chars)) % self.shape[1]
        at, node, self.arcs = np.arange(len(chars)), np.zeros(len(chars), dtype=np.int64), []
        for n in range(1, min(t.longest, self.shape[1]) + 1):
            inside = place[at] + n <= self.shape[1]
            at, node = at[inside], node[inside]
            node = t.steps(node, chars[at + n - 1])
            at, node = at[node >= 0], node[node >= 0]
            found = np.full(len(chars), -1, dtype=np.int64)
            found[at] = t.piece[node]
            if n == 1 and (bare := found < 0).any():
                points, number = np.unique(chars[bare], return_inverse=True)
                found[bare] = self.size + number
                self.spelt = [[bytes_[b] for b in chr(c).encode()] for c in points.tolist()]
            if not len(at) and n > 1:
                break
            self.arcs.append(found.reshape(self.shape))

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sums over all ways to each position, and the arcs' probabilities."""
        every = np.concatenate([p, [math.prod(p[k] for k in spelt) for spelt in self.spelt], [0.0]])
        q = [every[arc] for arc in self.arcs]
        a = np.zeros((self.shape[1] + 1, self.shape[0]))
        a[0] = 1.0
        for j in range(1, self.shape[1] + 1):
            for n, x in enumerate(q[:j], 1):
                a[j] += a[j - n] * x[:, j - n]
        return a, q

    def log_forward(self, logs: np.ndarray) -> np.ndarray:
        """The logarithm of each word's sum over all segmentations, from those of the pieces' probabilities."""
        every = np.concatenate([logs, [sum(logs[k] for k in spelt) for spelt in self.spelt], [-np.inf]])
        q = [every[arc] for arc in self.arcs]
        a = np.zeros((self.shape[1] + 1, self.shape[0]))
        for j in range(1, self.shape[1] + 1):
            into = np.stack([a[j - n] + x[:, j - n] for n, x in enumerate(q[:j], 1)])
            top = into.max(axis=0)  # a character at least is always an arc
            a[j] = top + np.log(np.exp(into - top).sum(axis=0))
        return a[-1]

    def uses(self, p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """c times the expected uses of each piece, added up, and each word's probability. Words that come close to underflow are left out."""
        a, q = self.forward(p)
        b = np.zeros_like(a)
        b[-1] = 1.0
        for i in range(self.shape[1] - 1, -1, -1):
            for n, x in enumerate(q[: self.shape[1] - i], 1):
                b[i] += x[:, i] * b[i + n]
        share = np.where(a[-1] > TINY, c / np.maximum(a[-1], TINY), 0.0)
        use = np.zeros(self.size + len(self.spelt) + 1)
        for n, (arc, x) in enumerate(zip(self.arcs, q), 1):
            through = (a[:-n] * b[n:] * share).T * x[:, : self.shape[1] + 1 - n]
            some = arc[:, : self.shape[1] + 1 - n] >= 0
            use += np.bincount(arc[:, : self.shape[1] + 1 - n][some], through[some], minlength=len(use))
        for k, spelt in enumerate(self.spelt, self.size):
            for b_ in spelt:
                use[b_] += use[k]
        return use[: self.size], a[-1]


def by_length(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Texts of up to PLAIN characters by their length, with their places, a bounded number of characters at a time."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    for n in np.unique(lengths[lengths <= PLAIN]).tolist():
        every = np.flatnonzero(lengths == n)
        for at in np.array_split(every, -(-n * len(every) // CHARS)):
            yield at, [texts[i] for i in at.tolist()]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of words joined to larger ones, so that arrays are long."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.nbytes
        if size >= GATHER:
            yield pa.concat_batches(some)
            some, size = [], 0
    if some:
        yield pa.concat_batches(some)


def log_sum(logs: list[float]) -> float:
    top = max(logs)
    return top + math.log(math.fsum(math.exp(x - top) for x in logs))


def log10_word(word: str, pieces, bytes_, p) -> float:
    """log10 of the word's probability over all segmentations."""
    text = MARK + word
    into: list[list[float]] = [[0.0], *([] for _ in text)]
    for i in range(len(text)):
        here, into[i] = log_sum(into[i]), []
        for j, _, q in arcs_from(text, i, pieces, bytes_, p):
            # A character that is spelt in many bytes may have less than the least double.
            into[j].append(here + (math.log(q) if q > 0 else sum(math.log(p[bytes_[b]]) for b in text[i].encode())))
    return log_sum(into[-1]) / math.log(10)


def add_uses(text: str, c: float, use: dict[int, float], pieces, bytes_, p) -> None:
    """Adds c times the expected uses of each piece in text, by forward and backward sums over the whole text.

    A character spelt in bytes uses each of its byte pieces. The sums are plain as long as they stay clear of underflow; longer or rarer texts are summed in logarithms.
    """

    def add(i: int, k: int, x: float) -> None:
        for k in (k,) if k >= 0 else map(bytes_.__getitem__, text[i].encode()):
            use[k] = use.get(k, 0.0) + x

    arcs = [arcs_from(text, i, pieces, bytes_, p) for i in range(len(text))]
    a, b = [1.0] + [0.0] * len(text), [0.0] * len(text) + [1.0]
    if len(text) <= PLAIN:
        for i, found in enumerate(arcs):
            for j, _, q in found:
                a[j] += a[i] * q
    if a[-1] > TINY:
        for i in range(len(text) - 1, -1, -1):
            share = c * a[i] / a[-1]
            for j, k, q in arcs[i]:
                b[i] += (through := q * b[j])
                if k >= 0:
                    use[k] = use.get(k, 0.0) + share * through
                else:
                    add(i, k, share * through)
        return
    # Each arc is followed through the logarithms of its ends' sums, of which the largest is taken out.
    into: list[list[float]] = [[] for _ in range(len(text) + 1)]
    into[0].append(0.0)
    la, lb = [0.0] * (len(text) + 1), [0.0] * (len(text) + 1)
    for i in range(len(text) + 1):
        top = max(into[i], default=-math.inf)
        la[i] = top + math.log(math.fsum(math.exp(x - top) for x in into[i])) if into[i] else -math.inf
        for j, _, q in arcs[i] if i < len(text) else ():
            into[j].append(la[i] + math.log(q))
    for i in range(len(text) - 1, -1, -1):
        on = [math.log(q) + lb[j] for j, _, q in arcs[i]]
        top = max(on)
        lb[i] = top + math.log(math.fsum(math.exp(x - top) for x in on))
        for (_, k, _), x in zip(arcs[i], on):
            add(i, k, c * math.exp(la[i] + x - la[-1]))


def expected(path: str, p: list[float] | None = None):
    """Expected uses of each piece in (word, c) under weights p (the first ones), and in piece -1 the words' log10 likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, bytes_, first = vocabulary(path)
        weights = np.array(first if p is None else p)
        plain, total, likelihood = weights.tolist(), np.zeros(len(weights)), 0.0
        for batch in gathered(batches):
            texts, counts = [MARK + w for w in batch["word"].to_pylist()], batch["c"].to_numpy().astype(float)
            done = np.zeros(len(texts), dtype=bool)
            for at, some in by_length(texts):
                use, whole = Lattices(some, path).uses(weights, counts[at])
                total += use
                done[at] = whole > TINY
                likelihood += float((counts[at] * np.log10(np.maximum(whole, TINY)) * (whole > TINY)).sum())
            for i in np.flatnonzero(~done).tolist():
                use: dict[int, float] = {}
                add_uses(texts[i], counts[i], use, pieces, bytes_, plain)
                for k, x in use.items():
                    total[k] += x
                likelihood += counts[i] * log10_word(texts[i][1:], pieces, bytes_, plain)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1)), pa.array(np.append(total[met], likelihood))], names=["piece", "uses"])

    return run


def lattice_log10(words: list[str], path: str, p: np.ndarray) -> np.ndarray:
    """log10 of each word's probability over all segmentations."""
    pieces, bytes_, _ = vocabulary(path)
    texts, out = [MARK + w for w in words], np.full(len(words), -np.inf)
    for at, some in by_length(texts):
        out[at] = Lattices(some, path).log_forward(np.log(p)) / math.log(10)
    plain = p.tolist()
    for i in np.flatnonzero(np.isinf(out)).tolist():  # longer words
        out[i] = log10_word(words[i], pieces, bytes_, plain)
    return out


def scored_words(path: str, p: list[float], n: int, d: float, rest: float):
    """ls: log10 of a word's probability by the lattice; ws: by the word unigram, which leaves rest to the lattice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array(p)
        for batch in gathered(batches):
            c, ls = batch["c"].to_numpy(), lattice_log10(batch["word"].to_pylist(), path, weights)
            own = np.where(c > 0, np.log(np.maximum(c - d, 1e-9) / n), -np.inf)
            ws = np.logaddexp(own, math.log(rest) + ls * math.log(10)) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch["word"], batch["c"], pa.array(ls), pa.array(ws)], names=["word", "c", "ls", "ws"])

    return run


def fitted(words: DataFrame, path: str) -> list[float]:
    """Weights of the pieces, fitted to words (word, c) until their likelihood rests. What is collected is a row a piece of the file at most."""
    _, _, first = vocabulary(path)
    p, before = None, None
    for _ in range(STEPS):
        uses = words.mapInArrow(expected(path, p), "piece bigint, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        found = dict(map(tuple, uses.collect()))
        likelihood, total = found.pop(-1, 0.0), sum(v for k, v in found.items() if k >= 0) + 1.0
        p = [(found.get(i, 0.0) + first[i]) / total for i in range(len(first))]
        if before is not None and likelihood - before < REST * abs(before) or not likelihood:
            break
        before = likelihood
    return p


def scored_texts(n: int, v: int, ends: int, p_end: float):
    unit = math.log10(n + v + 1) if n + v else 0.0

    def run(words: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        place = {w.encode(): i for i, w in enumerate(words["word"])}
        counts, lattice, own = (words[c].to_numpy() for c in ("c", "ls", "ws"))
        known, base = counts > 0, np.where(counts > 0, np.log10(counts + 1.0), 0.0)
        out = []
        for doc_id, text in zip(docs["doc_id"], docs["text"]):
            tokens = (text or "").encode().lower().split()
            at = np.fromiter(map(place.__getitem__, tokens), dtype=np.int64, count=len(tokens))
            size = len(tokens) + 1
            held = zlib.crc32(str(int(doc_id)).encode()) % FOLDS == HELD if doc_id is not None and doc_id == doc_id else False
            b = float(base[at].sum()) + math.log10(ends + 1) - size * unit
            s, w = float(lattice[at].sum()) + p_end, float(own[at].sum()) + p_end
            out.append((doc_id, held, size, int(known[at].sum()) + (ends > 0), n, b, s, w))
        return pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "word_score"]).astype({"doc_id": "Int64"})

    return run


def scored(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score) of every row of docs (doc_id, text).

    Null text is empty: its only token is the end. A null doc_id is never held out. Repeated rows are counted and
    scored each. Other columns are left out. An empty table gives no rows; without training rows all words are spelt by
    the vocabulary's own weights. Texts are whole; a word of any length is one lattice.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    # A split is cut by its size in the file; rows that come from no file are dealt by the size of all texts.
    row = F.xxhash64("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))
    ends, size = docs.agg(F.count_if(~held), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    cut = F.struct(F.input_file_name(), F.input_file_block_start(), F.pmod(row, F.ceil(F.greatest(F.input_file_block_length(), F.lit(1)) / TILE)))
    tile = F.when(F.input_file_name() == "", F.pmod(row, F.lit(size // (2 * TILE) + 1))).otherwise(F.xxhash64(cut)).alias("tile")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tile)
    tokens = rows.select("tile", held.alias("held"), F.explode(blank_split(lower_ascii(F.coalesce("text", F.lit(""))))).alias("word"))
    tiled = stored(tokens.groupBy("tile", "word").agg(F.count_if(~F.col("held")).alias("c")), f"{folder}/tiled")
    counts = stored(tiled.groupBy("word").agg(F.sum("c").alias("c")), f"{folder}/counts")
    known = F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    n, v, once, twice = counts.where("c > 0").agg(*known).first()

    p = fitted(counts.where("c > 0"), path)
    # One end more than the documents have, so that an end is always known.
    d = once / (once + 2 * twice) if once and twice else 0.75
    all_ = n + ends + 1
    words = stored(counts.mapInArrow(scored_words(path, p, all_, d, d * (v + 1) / all_), "word string, c bigint, ls double, ws double"), f"{folder}/words")
    n, v = n + ends, v + (ends > 0)
    wanted = tiled.select("tile", "word").join(words, "word")
    run = scored_texts(n, v, ends, math.log10((ends + 1 - d) / all_))
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, word_score double"
    return wanted.groupBy("tile").cogroup(rows.groupBy("tile")).applyInPandas(run, schema)


def op6_lm_scoring(spark, sf_dir) -> DataFrame:
    """The whole documents table, as scored gives it; see there for nulls, repeated rows and empty tables."""
    return scored(table(spark, sf_dir, "documents"))
