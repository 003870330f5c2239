"""Plain Python versions of the operators' contracts."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = list(zip(words, words[1:], words[2:]))
    seen = collections.Counter(grams)
    hit = {j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "base_failed": n < 50 or 100 * len(hit) > 50 * n,
    }


def token_store(rows, tokenizer, end_id=2):
    """rows: (doc_id, text), in order of doc_id."""
    import zlib

    import numpy as np

    start, out = 0, []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def decontaminate(docs, items, span=10):
    """docs and items: dicts of id to text. Returns id to (n_words, n_hit, sorted item ids as strings)."""
    windows = collections.defaultdict(set)
    for item, text in items.items():
        w = TERM.findall((text or "").translate(FOLD))
        if w:
            for i in range(max(1, len(w) - span + 1)):
                windows[tuple(w[i : i + span])].add(str(item))
    sizes = sorted({len(w) for w in windows})
    out = {}
    for doc, text in docs.items():
        w = TERM.findall((text or "").translate(FOLD))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (t := tuple(w[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[t]
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def near_items(docs, items, span, reach):
    """Id to the items (as strings) with a window all of whose words stand at most reach away from a place of its rarest word."""
    cut = {doc: TERM.findall((text or "").translate(FOLD)) for doc, text in docs.items()}
    counts = collections.Counter(w for words in cut.values() for w in words)
    out = {doc: set() for doc in docs}
    for item, text in items.items():
        w = TERM.findall((text or "").translate(FOLD))
        for i in range(max(1, len(w) - span + 1) if w else 0):
            window = w[i : i + span]
            rarest = min(window, key=lambda t: (counts[t], window.index(t)))
            for doc, words in cut.items():
                if any(x == rarest and set(window) <= set(words[max(0, at - reach) : at + reach + 1]) for at, x in enumerate(words)):
                    out[doc].add(str(item))
    return out


def jaccard(docs, n=3, num=90, den=100):
    """docs: list of (id, text). Returns (id, set size, component's least id)."""
    sets = []
    for _, text in docs:
        w = WORD.findall((text or "").translate(FOLD))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            lists[g].append(i)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for g in s for j in lists[g] if j < i)
        for j, c in shared.items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(sets[i]), least[find(i)] if sets[i] else doc) for i, (doc, _) in enumerate(docs)]
