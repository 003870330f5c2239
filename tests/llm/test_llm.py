import hashlib
import heapq
import random
import sys
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute

from undertext.llm import decontam, jaccard, licenses, lm, mixing, quality, tokencount, tokenstore, urls, warc

LONG = " ".join(f"w{i}" for i in range(3000))
TEXTS = [None, "", " \n\t ", "one", "Two two", "a b c d e f g h i j k l", "a b c d e f g h i j k l", "A B c d e f g h i j k M", "x y z x y z x y z", LONG, LONG + " more", "Été ÉTÉ straße <|endoftext|> 中文", "Licensed under CC BY-NC 4.0. All rights reserved."]
DOCS = [(i, t, "en" if i % 3 else None, f"src{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")


def test_quality_base(spark, docs, labels):
    for r in quality.verdicts(docs, labels).collect():
        want = brute.quality(TEXTS[r.doc_id])
        assert {k: r[k] for k in want} == want
        assert r.kept == (not r.base_failed)


def test_quality_cutoffs_reject_junk_and_keep_good(spark):
    good = [(i, " ".join(f"word{i}x{j}" for j in range(60)), "en") for i in range(900)]
    junk = [(1000 + i, " ".join(f"w{i}{j}###" for j in range(60)), "en") for i in range(50)]
    named = spark.createDataFrame([(i, 1) for i in range(900)] + [(1000 + i, 0) for i in range(25)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(good + junk, "doc_id long, text string, lang string"), named).collect()}
    assert all(kept[i] for i in range(900)) and not any(kept[1000 + i] for i in range(50))


def test_mixing(docs):
    rows = mixing.mixed(docs).collect()
    sizes = {i: len(brute.WORD.findall(t or "")) for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r["size"] for r in rows} == sizes
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in mixing.mixed(docs.repartition(3)).collect()}
    by_source = {}
    for r, d in ((r, DOCS[r.doc_id]) for r in rows):
        taken, _ = by_source.get(d[3], (0, 0))
        by_source[d[3]] = (taken + r.taken, r.target)
    assert all(abs(t - g) <= 130 for t, g in by_source.values())
    copies = mixing.copies(docs).collect()
    assert sum(len(brute.WORD.findall(r.text)) for r in copies) == sum(r.taken for r in rows)


def sainte_lague(votes, seats):
    """Seats by the highest quotients; of equal ones, the earlier party's."""
    won, heap = [0] * len(votes), [(-v, i) for i, v in enumerate(votes) if v]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, i = heapq.heappop(heap)
        won[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * won[i] + 1), i))
    return won


def test_quotas_are_those_of_the_highest_quotients(spark):
    rng, rows, want = random.Random(6), [], {}
    for g in range(40):
        votes, seats = [rng.choice([0, 1, 5, 64, rng.randint(1, 10**6)]) for _ in range(rng.randint(1, 12))], rng.choice([0, 1, 7, 100, 5000])
        want |= {(g, i): n for i, n in enumerate(sainte_lague([v / max(1, sum(votes)) for v in votes], seats))}
        rows += [(g, i, v, seats, 10**9) for i, v in enumerate(votes)]
    parties = spark.createDataFrame(rows, "g int, party int, votes long, seats long, most long")
    got = {(r.g, r.party): r.quota for r in mixing.apportioned(parties, ["g"], "party", "votes", "seats", "most").collect()}
    assert got == want


@pytest.mark.parametrize("words,sources", [([20], 300), ([6, 40000], 2), ([1, 2, 3, 500, 70], 40)])
def test_small_sources_come_near_their_targets(spark, words, sources):
    rows = [(100 * s + d, f"s{s:03d}", " ".join(f"w{i}" for i in range(words[s % len(words)] // n + (d < words[s % len(words)] % n)))) for s in range(sources) for n in [1 + s % 3] for d in range(n)]
    sums = {}
    for r, (_, source, text) in zip(sorted(mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect(), key=lambda r: r.doc_id), rows):
        taken, _ = sums.get(source, (0, 0))
        sums[source] = taken + r.taken, r.target
        assert 0 <= r.taken <= 3 * len(text.split())
    assert abs(sum(t for t, _ in sums.values()) - sum(x for _, x in sums.values())) <= 64
    assert all(abs(taken - target) <= 64 and taken >= target / 2 - 1 for taken, target in sums.values())
    assert all(taken for taken, target in sums.values() if target >= 1)


def test_decontamination(spark, docs):
    items = {7: "c d e f g h i j k l", 8: "One", 9: None, 10: " ".join(f"w{i}" for i in range(50, 65)), 11: "nothing like it here"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = brute.decontaminate(dict(enumerate(TEXTS)), items)
    for r in decontam.checked(docs, bench).collect():
        n, hit, found = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_proximity(spark):
    """Exact and proximity matches of every window, against a version that tries all places."""
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice("abcdefgh" if i % 2 else "abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(0, 120))) for i in range(60)}
    items = {100: "a b c d e", 101: "q r", 102: "z", 103: "a a b", 104: texts[4][:39], 105: "nowhere a", 106: "h g f e d c b a h g f e"}
    docs, bench = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    for span, reach in ((10, 20), (3, 2)):
        want, near = brute.decontaminate(texts, items, span), brute.near_items(texts, items, span, reach)
        for r in decontam.checked(docs, bench, span=span, reach=reach).collect():
            n, hit, found = want[r.doc_id]
            assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found))
            assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
            assert r.n_near == len(near[r.doc_id]) and set(found) <= near[r.doc_id]


@pytest.mark.parametrize("small", [0, 200_000])
def test_decontamination_by_shuffles_alone(spark, monkeypatch, small):
    monkeypatch.setattr(decontam, "SMALL", small)
    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute.decontaminate({r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in items.collect()})
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.op2_decontaminate(spark, sf).collect()}
    assert got == {k: (n, hit, len(found)) for k, (n, hit, found) in want.items()} and any(x[1] for x in got.values())


def test_licenses(docs):
    got = {r.doc_id: r for r in licenses.scanned(docs).collect()}
    assert len(licenses.rules()) > 200
    r = got[12]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (2, 2, 7, "cc-by,reserved")
    assert r.labels == "cc-by,cc-by-nc-4.0,reserved" and 0 < r.score <= 1
    assert got[0].n_words == 0 and got[0].labels == "" and got[0].first_word is None


def test_token_counts(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in tokencount.token_counts(docs).collect():
        text = TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(tokenizer.encode(text, add_special_tokens=False).ids))


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard(spark, n, num, den):
    texts = list(TEXTS)
    for k in range(60):  # a group of near copies, some of which link only through others
        words = [f"g{i}" for i in range(150)]
        for j in range(k % 9):
            words[(k * 7 + j * 16) % 150] = f"v{k}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    got = sorted(tuple(r)[:3] for r in jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string"), n, num, den).collect())
    assert got == brute.jaccard(rows, n, num, den)


def test_lm_base(docs):
    import collections
    import math
    import zlib

    counts, words = collections.Counter(), {}
    for i, t in enumerate(TEXTS):
        words[i] = [*brute.WORD.findall((t or "").translate(brute.FOLD)), None]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words[i])
    n, v = sum(counts.values()), len(counts)
    for r in lm.scored(docs).collect():
        w = words[r.doc_id]
        assert r.n_tokens == len(w) and r.train_tokens == n and r.n_known == sum(counts[x] > 0 for x in w)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0


def test_lattice_sums_all_segmentations():
    import math

    pieces, p = {"▁": 0, "a": 1, "▁a": 2, "aa": 3}, [0.1, 0.2, 0.3, 0.4]
    both = 0.1 * 0.2 * 0.2 + 0.3 * 0.2 + 0.1 * 0.4
    assert 10 ** lm.log10_word("aa", pieces, [0] * 256, p) == pytest.approx(both)
    assert lm.log10_word("a" * 3000, pieces, [0] * 256, p) > -math.inf


def test_urls(spark):
    log = spark.createDataFrame([("example.com", "ads", "add", 10), ("example.com", "ads", "remove", 20), (None, "ads", "add", 1)], "domain string, category string, action string, day long")
    rows = [(1, "https://u@Sub.Example.com:80/x", 10), (2, "http://example.com", 20), (3, None, 15), (4, "http://example.com/", None), (5, "http://notexample.com", 15), (6, "http://example.com./", 19)]
    got = {r.page_id: r.blocked for r in urls.evaluated(spark.createDataFrame(rows, "page_id long, url string, fetched_day long"), log).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True}


def test_warc(spark, tmp_path):
    rows = [(1, "u", "same"), (2, "u\r\nX: y", "same"), (3, None, None), (None, "v", "other"), (5, "w", "é" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archived(pages).collect()}
    assert (got[1].record_type, got[1].refers_to, got[2].record_type) == ("revisit", 2, "response")
    assert got[5].payload_bytes == 10000 and got[3].payload_bytes == 0
    warc.write_archive(pages, f"file://{tmp_path}/w")
    assert len(warc.warc_bytes(spark, f"file://{tmp_path}/w").collect()) == 5


def test_token_store(spark, docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    want = brute.token_store(list(enumerate(TEXTS)), tokenizer)
    folder = f"file://{tmp_path}/s"
    tokenstore.write_store(docs, path, 2, folder)
    assert sorted(map(tuple, tokenstore.read_digests(spark, folder).collect())) == want
    for r in tokenstore.read_ids(spark, folder).collect():
        assert r.ids == tokenizer.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [2]


def test_empty_tables(spark, empty, docs, labels):
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (quality.verdicts(empty, labels), mixing.mixed(empty), decontam.checked(empty, bench), licenses.scanned(empty), tokencount.token_counts(empty), jaccard.joined(empty), lm.scored(empty), tokenstore.token_store(spark, empty)):
        assert df.count() == 0
    assert decontam.checked(docs, bench).where("contaminated").count() == 0


def test_pipeline_stages_keep_whole_rows(spark, docs, tmp_path):
    import corpus_pipeline

    good = " ".join(f"t{i}" for i in range(80))
    rows = [(20, good, "en", "a", 9, "x", 1), (21, good, "en", "a", 9, "y", 2), (22, "bad " + " ".join(f"b{i}" for i in range(70)), None, None, 9, "z", 3), (23, "short", "en", "a", 5, "z", 3)]
    wide = spark.createDataFrame(rows, SCHEMA + ", n_words string, key int")
    spark.createDataFrame([(20, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(20, 30)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, wide, str(tmp_path))
    assert kept.columns == wide.columns and sorted(r.doc_id for r in kept.collect()) == [20, 21, 22]
    one = stages["ngram_jaccard"](spark, kept, str(tmp_path))
    assert sorted(r.doc_id for r in one.collect()) == [20, 22]
    clean = stages["decontaminate"](spark, one, str(tmp_path))
    assert [tuple(r) for r in clean.collect()] == [rows[0]]
    mix = stages["mix_sources"](spark, clean, str(tmp_path))
    assert [tuple(r) for r in mix.collect()] == [(20, good, "en", "a", len(good), "x", 1)]  # n_chars follows the text
    assert stages["token_store"](spark, mix, str(tmp_path)).count() == mix.count()


def test_quality_cutoffs_are_those_of_exact_binomial_sums(spark):
    """Two strata and one too small for any cutoff, against plain Python."""
    import math
    import random
    from fractions import Fraction

    rng, rows, labels = random.Random(8), [], []
    for i in range(3300):
        lang, good = ("en", "fr", None)[min(2, i // 1600)], i % 11 > 0
        n = rng.randrange(0, 9) if good else rng.randrange(4, 40)
        rows.append((i, " ".join(f"{'#' if j < n else 'w'}{i}x{j}{'y' * rng.randrange(5)}" for j in range(60)), lang))
        labels.append((i, int(good)))
    risk, names = quality.Risk(), [n for n, _, _ in quality.RULES]
    measures = {}
    for i, text, _ in rows:
        q = brute.quality(text)
        n, chars = q["n_words"], q["word_chars"]
        measures[i] = (q["n_symbols"] * 10000 // chars, 0, 0, chars * 100 // n, -(chars * 100 // n))
    want = {}
    for lang in {r[2] for r in rows}:
        ids = [r[0] for r in rows if r[2] == lang]
        good, bad = [i for i in ids if labels[i][1]], [i for i in ids if not labels[i][1]]
        a, tests = Fraction(1, 20) / len(names), 3 * len(names)
        k, below = -1, Fraction(0)
        while True:
            below += math.comb(len(good), k + 1) * a ** (k + 1) * (1 - a) ** (len(good) - k - 1)
            if below > Fraction(1, 20) / tests:
                break
            k += 1
        for at, name in enumerate(names):
            best = None
            for v in sorted({measures[i][at] for i in ids}):
                over = sum(measures[i][at] > v for i in good)
                if over <= k:
                    gain = sum(measures[i][at] > v for i in bad) / len(bad) - risk.price * over / len(good)
                    if gain > 0 and (best is None or (gain, v) > best):
                        best = (gain, v)
            if best:
                want[lang, name] = best[1]
    assert want and not any(lang is None for lang, _ in want)
    got = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert got == {i: not any(measures[i][at] > want.get((lang, name), math.inf) for at, name in enumerate(names)) for i, _, lang in rows}
    assert 0 < sum(not kept for kept in got.values()) < 400
