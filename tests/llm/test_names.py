"""Stages and operators over rows with null ids, repeated rows and columns of clashing names."""

import public_tokenizers
import pytest

from undertext.llm import decontam, jaccard, licenses, lm, mixing, packing, quality, runs, tokencount, tokens, tokenstore, urls, warc

EXTRA = ["_row", "_run", "_runs", "_d", "_h", "h", "h2", "k", "d", "run", "row", "key", "node", "comp", "n", "n_words", "kept", "words", "stratum", "src", "part", "tile", "word", "_kept", "g_h"]
GOOD = " ".join(f"t{i}" for i in range(80))


@pytest.fixture(scope="module")
def rows(spark):
    texts = [(1, GOOD), (1, GOOD), (None, GOOD + " more"), (None, None), (2, ""), (3, " ".join(f"u{i}" for i in range(90)))]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` int" for c in EXTRA)
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), *range(7, 7 + len(EXTRA))) for d, t in texts], schema)


def carried(df):
    assert all(tuple(r)[5:] == tuple(range(7, 7 + len(EXTRA))) for r in df.collect())
    return df


def test_stages_carry_columns_of_any_name(spark, rows, tmp_path):
    spark.createDataFrame([(1, 1), (None, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "u7 u8 u9"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage, left in ((quality.stage, 4), (jaccard.stage, 4), (decontam.stage, 5)):
        out = carried(stage(spark, rows, str(tmp_path)))
        assert out.columns == rows.columns and out.count() == left, stage
    taken = carried(mixing.stage(spark, rows, str(tmp_path)))
    assert taken.columns == rows.columns and all(r.n_chars == len(r.text) for r in taken.collect())
    assert tokenstore.stage(spark, rows, str(tmp_path)).count() == 6


def test_operators_take_null_ids_and_repeated_rows(spark, rows):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "t7 t8 t9"), (None, "t1 t2 t3")], "item_id long, text string")
    for out in (mixing.mixed(rows), decontam.checked(rows, items), licenses.scanned(rows), tokencount.token_counts(rows), jaccard.joined(rows), lm.scored(rows), quality.verdicts(rows, labels), tokenstore.token_store(spark, rows)):
        assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "2", "3", "None", "None"]


def test_url_filters_carry_columns_of_any_name(spark):
    log = spark.createDataFrame([("Example.com", "ads", "add", 10), ("example.com", "ads", "add", 10), ("sub.example.com", "malware", "add", 10), ("sub.example.com", "malware", "remove", 10), ("example.com", "adult", "add", 40)], "domain string, category string, action string, day long")
    names = ["host", "blocked", "n_entries", "categories", "entry", "_host", "_day", "domain", "bucket", "since", "until", "row", "day", "f_host", "f_day"]
    rows = [(1, "http://sub.example.com/a", 40), (1, "http://sub.example.com/a", 40), (2, "http://sub.example.com/a", 39), (None, None, None), (3, "http://other.example.org", 50)]
    captures = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "page_id long, url string, fetched_day long, " + ", ".join(f"`{c}` int" for c in names))
    out = urls.evaluated(captures, log)
    assert out.columns == ["page_id", "url", "fetched_day", *[f"in_{c}" if i < 5 else c for i, c in enumerate(names)], *names[:5]]
    got = sorted(([r[0], *r[3 : 3 + len(names)], *r[3 + len(names) :]] for r in out.collect()), key=str)
    told = {1: ("sub.example.com", True, 2, "ads,adult", "example.com"), 2: ("sub.example.com", True, 1, "ads", "example.com"), None: (None, False, 0, "", None), 3: ("other.example.org", False, 0, "", None)}
    assert got == sorted(([i, *range(len(names)), *told[i]] for i, _, _ in rows), key=str)
    assert urls.evaluated(captures.limit(0), log).count() == 0
    assert {r.blocked for r in urls.evaluated(captures, log.limit(0)).collect()} == {False}


def test_archives_of_odd_tables(spark):
    schema = "page_id long, url string, html string, p string, a string, address string, digest int, body int"
    rows = [(1, "u", "same"), (2, "v", "same"), (2, "v", "same"), (None, None, "same"), (3, None, None), (None, "w", ""), (None, "w", "alone"), (4, "x", "long" * 200_000)]
    pages = spark.createDataFrame([(*r, "q", "q", "q", 1, 2) for r in rows], schema)
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(pages).collect())
    assert got == sorted([("1", 4, "revisit", 2), ("2", 4, "response", None), ("2", 4, "response", None), ("None", 4, "revisit", 2), ("3", 0, "response", None), ("None", 0, "revisit", 3), ("None", 5, "response", None), ("4", 800_000, "response", None)], key=str)
    assert warc.archived(pages.limit(0)).count() == 0 and {r.record_type for r in warc.archived(pages, least=1 << 30).collect()} == {"response"}


def test_other_tokenizers_are_refused():
    """Each encoder splits texts itself, so it takes only files that are split that way."""
    word, byte = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    with pytest.raises(ValueError, match="not split"):
        tokens.ByteLevelEncoder(word)
    with pytest.raises((ValueError, KeyError)):
        tokencount.TokenCounter(byte)
    tokens.ByteLevelEncoder(byte), tokencount.TokenCounter(word)


def test_new_operators_take_columns_of_any_name(spark, rows):
    assert sorted(str(r.doc_id) for r in runs.periodic_runs(rows).collect()) == ["1", "1", "2", "3", "None", "None"]
    assert sorted(str(r.doc_id) for r in packing.pack(spark, rows)[1].collect()) == ["1", "1", "2", "3", "None", "None"]
