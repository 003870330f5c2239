"""License scans by ordered signature rules.

Rules come from signatures of licenses (what their notices, grants and clauses say) and from a table of licenses, their
versions and the phrases that name them; each has a priority and keywords of which one of each group must stand in a
text before its expression runs. Texts are read as words with one space between them, so wrapped lines and comment marks
are no obstacle. Fields that declare a license (`SPDX-License-Identifier:`, `License:`) are read as expressions: every
license that AND and OR join is a label, so is an exception behind WITH, and what holds for later versions too ends in
-or-later. Of the detections, one that lies within another of at least its priority is suppressed, so a
license's bare name gives way to the grant or field around it. The three base phrases are never suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertext.llm.common import table
from undertext.llm.signatures import SIGNATURES

# The base phrases and labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Label, name as an expression, words of which one stands in every such name, versions.
LICENSES = (
    ("apache", r"apache(?: software)?", ("apache",), ("1.0", "1.1", "2.0")),
    ("mit", r"mit", ("mit",), ("",)),
    ("bsd", r"bsd", ("bsd",), ("2-clause", "3-clause", "4-clause")),
    ("gpl", r"(?:gnu )?(?:general public|gpl)", ("general public", "gpl"), ("1", "2", "3")),
    ("lgpl", r"(?:gnu )?(?:lesser general public|library general public|lgpl)", ("lesser general", "library general", "lgpl"), ("2.0", "2.1", "3")),
    ("agpl", r"(?:gnu )?(?:affero general public|agpl)", ("affero", "agpl"), ("1", "3")),
    ("mpl", r"(?:mozilla public|mpl)", ("mozilla", "mpl"), ("1.0", "1.1", "2.0")),
    ("epl", r"(?:eclipse public|epl)", ("eclipse", "epl"), ("1.0", "2.0")),
    ("cddl", r"(?:common development and distribution|cddl)", ("common development", "cddl"), ("1.0", "1.1")),
    ("eupl", r"(?:european union public|eupl)", ("european union", "eupl"), ("1.0", "1.1", "1.2")),
    ("artistic", r"artistic", ("artistic",), ("1.0", "2.0")),
    ("boost", r"boost software", ("boost",), ("1.0",)),
    ("isc", r"isc", ("isc",), ("",)),
    ("zlib", r"zlib", ("zlib",), ("",)),
    ("unlicense", r"the unlicense", ("unlicense",), ("",)),
    ("ofl", r"(?:sil )?open font", ("open font",), ("1.0", "1.1")),
    ("odbl", r"(?:open database|odbl)", ("open database", "odbl"), ("1.0",)),
    ("cc0", r"(?:creative commons zero|cc0)", ("commons zero", "cc0"), ("1.0",)),
    ("cc-by", r"(?:creative commons attribution|cc by)", ("creative commons", "cc by"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", r"(?:creative commons attribution sharealike|cc by sa)", ("attribution sharealike", "cc by sa"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", r"(?:creative commons attribution noderivs|cc by nd)", ("attribution noderivs", "cc by nd"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", r"(?:creative commons attribution noncommercial|cc by nc)", ("attribution noncommercial", "cc by nc"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-sa", r"(?:creative commons attribution noncommercial sharealike|cc by nc sa)", ("noncommercial sharealike", "cc by nc sa"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-nd", r"(?:creative commons attribution noncommercial noderivs|cc by nc nd)", ("noncommercial noderivs", "cc by nc nd"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
)

# Identifiers of license expressions that are not written as the labels are, and exceptions.
SHORT = {"bsl-1.0": "boost-1.0", "gpl-1.0": "gpl-1", "gpl-2.0": "gpl-2", "gpl-3.0": "gpl-3", "lgpl-3.0": "lgpl-3", "agpl-1.0": "agpl-1", "agpl-3.0": "agpl-3", "python-2.0": "psf", "psf-2.0": "psf", "x11": "x11", "cc-pddc": "public-domain"}
EXCEPTIONS = ("autoconf-exception-2.0", "autoconf-exception-3.0", "bison-exception-2.2", "classpath-exception-2.0", "font-exception-2.0", "gcc-exception-2.0", "gcc-exception-3.1", "libtool-exception", "linux-syscall-note", "llvm-exception", "ocaml-lgpl-linking-exception", "openjdk-assembly-exception-1.0", "qt-gpl-exception-1.0", "wxwindows-exception-3.1")
FIELD_PRIORITY, FIELD_WEIGHT = 95, 0.95

# Expression around {name} and {version}, keyword, priority, weight of the detection.
PHRASES = (
    (r"licensed under (?:the )?(?:terms of )?(?:the )?{name}(?: licen[cs]e)?(?: version)? ?v?{version}", "licensed under", 70, 0.9),
    (r"(?:released|distributed|available) under (?:the )?(?:terms of )?(?:the )?{name}(?: licen[cs]e)?(?: version)? ?v?{version}", " under ", 70, 0.85),
    (r"{name} licen[cs]e(?: version)? ?v?{version}", "licen", 50, 0.6),
)
EDGE_A, EDGE_Z = r"(?<![a-z0-9])", r"(?![a-z0-9])"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    weight: float
    keywords: tuple[tuple[bytes, ...], ...]
    pattern: re.Pattern


def anchor(phrase: str) -> str:
    """The longest run of characters that stands in every text the phrase finds."""
    return max(re.split(r"\(\?:[^)]*\)\??|\[[^]]*\]\??|.\?|~", phrase), key=len).strip()


def rules() -> list[Rule]:
    """A rule for each signature, for each phrase, license and version, and for each phrase and license without a version."""
    whole = lambda text: re.compile((EDGE_A + text + EDGE_Z).encode())
    out = [Rule(label, priority, weight, ((anchor(phrase).encode(),),), whole(phrase.replace("~", r"(?: [^ ]+){0,12}?"))) for label, (priority, weight), phrase in SIGNATURES]
    for label, name, words, versions in LICENSES:
        for phrase, keyword, priority, weight in PHRASES:
            for version in dict.fromkeys((*versions, "")):
                text = phrase.format(name=name, version=re.sub("[.-]", " ", version))
                text = text if version else text.removesuffix("(?: version)? ?v?")
                full = f"{label}-{version}" if version else label
                out.append(Rule(full, priority + bool(version), weight, ((keyword.encode(),), tuple(w.encode() for w in words)), whole(text)))
    return sorted(out, key=lambda r: -r.priority)


def identifiers() -> dict[str, str]:
    """Labels of the identifiers that license expressions may hold, all in lower case."""
    own = [f"{label}-{v}" if v else label for label, _, _, versions in LICENSES for v in versions]
    return {x: x for x in (*own, *(label for label, _, _ in SIGNATURES), *EXCEPTIONS)} | SHORT


FIELD = re.compile(rb"(?:spdx-license-identifier|(?<![^\n\r])[^a-z0-9\n\r]*licen[cs]e(?:-expression|s)?)[\"']?[ \t]*[:=][ \t]*")
OPENING, NAME, JOINT = re.compile(rb"[ \t(\"'\[]*"), re.compile(rb"[a-z0-9][a-z0-9.+-]*"), re.compile(rb"[ \t)\"'\]]*[ \t](?:and|or|with)(?=[ \t(])")


def expression(raw: bytes, at: int, known: dict[str, str]) -> list[tuple[str, int, int]]:
    """The labels of a license expression in lower-cased bytes from at on, with the places of their identifiers. It ends at the first identifier that is not known."""
    labels = []
    while True:
        found = NAME.match(raw, OPENING.match(raw, at).end())
        if not found:
            break
        name = found.group().decode().rstrip(".")
        base = name.removesuffix("-only").removesuffix("-or-later").removesuffix("+")
        if base not in known:
            break
        end = found.start() + len(name)
        labels.append((known[base] + ("-or-later" if name.endswith(("-or-later", "+")) else ""), found.start(), end))
        joint = JOINT.match(raw, end)
        if not joint:
            break
        at = joint.end()
    return labels


def resolved(found: list[tuple[int, int, int, float, str]]) -> list[tuple[int, int, int, float, str]]:
    """Detections (first word, last word, priority, weight, label) that do not lie within another of at least their priority; of equal stretches, the first label stays.

    In order of priority and length, those kept are remembered by their first words, each with the furthest last word
    up to it, so that one search tells whether any holds the next.
    """
    kept, begins, reach = [], [], []
    for d in sorted(set(found), key=lambda d: (-d[2], d[0] - d[1], d[0], d[4])):
        at = bisect_right(begins, d[0])
        if at and reach[at - 1] >= d[1]:
            continue
        kept.append(d)
        upto = at
        while upto < len(begins) and reach[upto] <= d[1]:
            upto += 1
        begins[at:upto], reach[at:upto] = [d[0]], [d[1]]
    return kept


def scanning():
    ordered, known = rules(), identifiers()
    # One word of each rule's first keyword, by which most texts are passed over.
    gates = sorted({max(r.keywords[0][0].split(), key=len) for r in ordered} | {b"licen"}, key=len)
    gates = [g for i, g in enumerate(gates) if not any(x in g for x in gates[:i])]
    word_byte = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
    spaced = bytes(b if word_byte[b] else 32 for b in range(256))
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    edge = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
    base = [(re.compile((rf"(?<!{edge})" + gap.join(p.split()) + rf"(?!{edge})").encode("latin-1")), p.split()[-1].encode(), label) for p, label in BASE]

    def detections(raw: bytes, starts: np.ndarray) -> list[tuple[int, int, int, float, str]]:
        out = []
        if b"licen" in raw:
            for m in FIELD.finditer(raw):
                begin = m.start()  # the field itself goes with the first identifier
                for label, at, end in expression(raw, m.end(), known):
                    first, last = (int(x) for x in np.searchsorted(starts, [min(begin, at), end]))
                    out.append((first, last - 1, FIELD_PRIORITY, FIELD_WEIGHT, label))
                    begin = len(raw)
        low = b" ".join(raw.translate(spaced).split())
        present: dict[bytes, bool] = {}
        has = lambda k: present[k] if k in present else present.setdefault(k, k in low)
        spaces = None
        for rule in ordered:
            if all(any(map(has, group)) for group in rule.keywords):
                for m in rule.pattern.finditer(low):
                    spaces = np.flatnonzero(np.frombuffer(low, dtype=np.uint8) == 32) if spaces is None else spaces
                    first, last = (int(x) for x in np.searchsorted(spaces, [m.start(), m.end() - 1]))
                    out.append((first, last, rule.priority, rule.weight, rule.label))
        return out

    def scan(text: str):
        raw = text.encode().lower()
        flags = word_byte[np.frombuffer(raw, dtype=np.uint8)]
        starts = np.flatnonzero(flags & np.append(True, ~flags[:-1])[: len(flags)])
        places, labels = [], set()
        for pattern, keyword, label in base:
            if keyword in raw:
                at = [m.start() for m in pattern.finditer(raw)]
                places += at
                labels |= {label} if at else set()
        first, last = (int(np.searchsorted(starts, x)) for x in (min(places), max(places))) if places else (None, None)
        kept = resolved(detections(raw, starts)) if any(g in raw for g in gates) else []
        miss = 0.6 if labels else 1.0
        for d in kept:
            miss *= 1 - d[3]
        both = labels | {d[4] for d in kept}
        return len(starts), len(places), first, last, ",".join(sorted(labels)), ",".join(sorted(both)), 1 - miss

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            columns = list(zip(*[scan(t or "") for t in batch["text"].to_pylist()])) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", *names])

    return run


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of docs (doc_id, text).

    Null text is empty: no words, no labels, score 0. Repeated rows and null ids are scanned like others; other columns are
    left out; an empty table gives no rows. A text of any length is scanned whole, in time that grows with its length.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return rows.mapInArrow(scanning(), schema)


def op3_license_scan(spark, sf_dir) -> DataFrame:
    """The whole documents table, as scanned gives it; see there for nulls, repeated rows and empty tables."""
    return scanned(table(spark, sf_dir, "documents"))
