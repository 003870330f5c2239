import random
import re
import sys
import time
from pathlib import Path

import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

from undertext.llm import licenses
from undertext.llm.signatures import SIGNATURES


def labels(spark, texts):
    rows = licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [set(r.labels.split(",")) - {""} for r in sorted(rows, key=lambda r: r.doc_id)]


def sample(phrase):
    """A text that the phrase finds."""
    phrase = re.sub(r"\(\?:([^)|]*)[^)]*\)\??", r"\1", phrase).replace("[cs]", "s").replace("~", " some one")
    return re.sub(r"(.)\?", r"\1", phrase)


def test_every_signature_on_wrapped_comments(spark):
    texts = []
    for _, _, phrase in SIGNATURES:
        words = sample(phrase).title().split()
        texts.append("# " + "".join(w + ("\n#  " if i % 4 == 3 else ", " if i % 5 == 2 else " ") for i, w in enumerate(words)))
    for (label, _, phrase), got in zip(SIGNATURES, labels(spark, texts)):
        assert any(x == label or x.startswith(label) for x in got), (label, phrase, got)


@pytest.mark.parametrize(
    "text,label",
    [
        ("Licensed under the\n * Apache License,\n * Version 2.0", "apache-2.0"),
        ("// SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("released\nunder the terms of the GNU GPL v3", "gpl-3"),
    ],
)
def test_wrapped_names(spark, text, label):
    assert label in labels(spark, [text])[0]


def test_plain_prose_has_no_label(spark):
    assert labels(spark, ["The permission slip was under the table, and the software was free.", "Redistribution of wealth."]) == [set(), set()]


@pytest.mark.parametrize(
    "text,want",
    [
        ("# SPDX-License-Identifier: BSD-3-Clause OR Apache-2.0\n", {"bsd-3-clause", "apache-2.0"}),
        ("// SPDX-License-Identifier: (MIT AND (GPL-2.0-only OR EPL-2.0))", {"mit", "gpl-2", "epl-2.0"}),
        ("/* SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */", {"gpl-2-or-later", "classpath-exception-2.0"}),
        ("SPDX-License-Identifier: LGPL-2.1+", {"lgpl-2.1-or-later"}),
        ("License: MIT", {"mit"}),
        ('name = "x"\n  license = "Apache-2.0"', {"apache-2.0"}),
        ('{\n "licenses": ["MIT"]', {"mit"}),
        ("License: see the file", set()),
        ("SPDX-License-Identifier: MIT OR house rules", {"mit"}),
        ("a dog license: mit or not", set()),
        ("SPDX-License-Identifier:", set()),
    ],
)
def test_expressions(spark, text, want):
    assert labels(spark, [text])[0] == want


def test_suppression_against_all_pairs():
    rng = random.Random(8)
    for _ in range(400):
        found = [(a, a + rng.randint(0, 9), rng.randint(1, 3), 0.5, rng.choice("xyz")) for a in (rng.randint(0, 30) for _ in range(rng.randint(0, 25)))]
        kept = []
        for d in sorted(set(found), key=lambda d: (-d[2], d[0] - d[1], d[0], d[4])):
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
                kept.append(d)
        assert licenses.resolved(found) == kept


def test_long_texts_take_time_by_their_length():
    scan = licenses.scanning()
    text = "distributed under the GNU GPL v2; see the MIT license. License: MIT\n" * 6000
    began = time.time()
    rows = next(scan(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})])))
    assert {"gpl-2", "mit"} <= set(rows["labels"][0].as_py().split(",")) and time.time() - began < 8


def plain_base(text):
    w = brute.TERM.findall((text or "").translate(brute.FOLD))
    phrases = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
    at = [(i, label) for label, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_base_columns_of_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = licenses.op3_license_scan(spark, sf).collect()
    assert len(rows) == len(texts) and {r.base_labels for r in rows} > {""}
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(texts[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([(None, None, "z")] * 2, "doc_id long, text string, labels string")
    assert [tuple(r) for r in licenses.scanned(df).collect()] == [(None, 0, 0, None, None, "", "", 0.0)] * 2
    assert licenses.scanned(df.limit(0)).collect() == []
