import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from undertext.functions import attributes, numbers
from undertext.operators import layout, packages, reports, sites, uploads
from undertext.streaming import guard

CLASSES = {
    "page_boxes": {"on_page": {True, False}},
    "run_attributes": {"hidden": {True, False, None}},
    "session_verdicts": {"verdict": {"clean", "infected", "unscannable"}},
    "notes_bodies": {"slide_no": {1, 2}},
    "package_limits": {"stopped": {True, False}},
    "crash_flush": {"verdict": {"clean", "infected", "unscannable", "error"}},
}


@pytest.mark.parametrize("name", sorted(CLASSES))
def test_every_class_of_the_answer_occurs(spark, name):
    rows = entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    for column, values in CLASSES[name].items():
        assert {r[column] for r in rows} == values


@pytest.mark.parametrize("present,value,on", [(True, None, True), (True, "1", True), (True, "true", True), (True, "on", True), (True, "True", False), (True, "ON", False), (True, "0", False), (True, "", False), (False, None, None), (False, "1", None)])
def test_switches(spark, present, value, on):
    df = spark.createDataFrame([(present, value)], "p boolean, v string")
    assert df.select(attributes.switched_on(F.col("p"), F.col("v"))).first()[0] is on


@pytest.mark.parametrize("value,size", [("24", 12.0), ("3", 1.5), ("0", 0.0), ("3.0", None), ("-2", None), (" 4", None), ("", None), (None, None), ("1pt", 1.0), ("2 pt", 2.0), ("1in", 72.0), ("2.54cm", 72.0), ("1pc", 12.0), ("1pi", 12.0), ("mm", 0.0), ("xmm", None), ("5em", None), ("5PT", None), ("1e1pt", 10.0), ("-1pt", -1.0), ("0.00004pt", 1 / 12700), ("0.00003pt", 0.0), ("n", None)])
def test_points(spark, value, size):
    got = spark.createDataFrame([(value,)], "v string").select(attributes.points(F.col("v"))).first()[0]
    assert got is None if size is None else got == pytest.approx(size)


def test_lines_meet_the_box_of_their_own_page(spark):
    span = "doc_id int, page_no int, op_index long, text string, size double, x0 double, y0 double, x1 double, y1 double"
    rows = [(1, 1, 2, "b", 10.0, 100.0, 50.0, 150.0, 60.0), (1, 1, 1, " a", 10.0, -60.0, 50.0, -10.0, 60.0), (1, 2, 3, "c", 10.0, 100.0, 50.0, 150.0, 60.0), (1, 3, 4, "d", 10.0, 1.0, 1.0, 2.0, 2.0), (2, 1, 1, "e", 10.0, 100.0, 50.0, 150.0, 60.0)]
    sheets = spark.createDataFrame([(1, 1, 200.0, 100.0), (1, 2, 100.0, 100.0), (2, 1, 300.0, 50.0)], "doc_id int, page_no int, width double, height double")
    got = {(r.doc_id, r.page_no): (r.direct, r.first_op, r.x0, r.x1, r.n_off, r.on_page) for r in layout.placed_lines(spark.createDataFrame(rows, span), sheets).collect()}
    assert got == {(1, 1): ("ab", 1, -60.0, 150.0, 1, True), (1, 2): ("c", 3, 100.0, 150.0, 1, False), (2, 1): ("e", 1, 100.0, 150.0, 1, False)}


def test_filled_paths_and_luminance(spark):
    rows = [(p, 1.0) for p in (*layout.FILLS, "stroke", "closeStroke", None)] + [("fill", None)]
    assert [r.paint for r in layout.painted(spark.createDataFrame(rows, "paint string, x0 double")).collect()] == list(layout.FILLS)
    df = spark.createDataFrame([((0, 0, 0),), ((255, 255, 255),), ((255, 0, 0),), ((1, 2, 3),)], "c struct<r:int,g:int,b:int>")
    assert [r[0] for r in df.select(numbers.luminance(F.col("c"))).collect()] == [0, 255, 76, 2]


def test_first_body_placeholder(spark):
    rows = [(1, 1, 1, "title", "t"), (1, 1, 3, "body", "late"), (1, 1, 2, "body", None), (1, 2, 1, None, "x"), (2, 1, 1, "body", " n ")]
    got = layout.notes_bodies(spark.createDataFrame(rows, "file_id int, slide_no int, ord int, placeholder string, text string")).collect()
    assert {tuple(r) for r in got} == {(1, 1, ""), (2, 1, " n ")}


AT = datetime.datetime(2026, 1, 1)


def test_sessions_and_what_they_believe(spark):
    at = lambda s: AT + datetime.timedelta(seconds=s)
    sessions = spark.createDataFrame([(i, at(0)) for i in range(1, 6)], "session int, opened timestamp")
    hellos = spark.createDataFrame([(1, at(3), "a"), (1, at(2), "b"), (2, at(4), "c"), (3, at(1), None), (4, at(0), "d"), (4, at(0), "e"), (9, at(0), "z"), (5, at(1), "f")], "session int, at timestamp, nonce string")
    known = guard.greeted(sessions, hellos)
    assert {r.session: r.nonce for r in known.collect()} == {1: "b", 2: None, 3: None, 4: "d", 5: "f"}
    requests = spark.createDataFrame([(10, 1, at(5)), (20, 2, at(5)), (40, 4, at(5)), (41, 4, at(5)), (50, 5, at(5)), (51, 5, at(5)), (50, 5, at(5))], "id int, session int, asked timestamp")
    rows = [(1, "b", 10, at(9), "infected", True, True), (1, "b", 10, at(10), "clean", True, True), (2, "c", 20, at(6), "infected", True, True), (4, "x", 40, at(6), "infected", True, True), (4, "d", 41, at(126), "infected", True, True), (5, "f", 50, at(6), "infected", False, True), (5, "f", 50, at(7), "error", True, True), (5, "f", 51, at(6), "infected", True, False)]
    messages = spark.createDataFrame(rows, "session int, nonce string, id int, told timestamp, verdict string, own_channel boolean, own_window boolean")
    assert {r.id: r.verdict for r in guard.decided(requests, known, messages).collect()} == {10: "infected", 20: "clean", 40: "clean", 41: "clean", 50: "error", 51: "clean"}
    assert sorted(r.id for r in guard.believed(messages, known).collect()) == [10, 10, 20, 41, 50]


def test_choices(spark):
    df = spark.createDataFrame([(v, c) for v in ("infected", "error", "clean") for c in ("block", "allow", None)], "v string, c string")
    assert [r[0] for r in df.select(guard.answer(F.col("v"), F.col("c"))).collect()] == ["infected", "clean", "infected", "infected", "error", "error", "infected", "error", "clean"]


def test_gate_state(spark):
    rows = [("paused", "true"), ("sites", '{"a.example": false, "b.example": true}'), ("other", "x")]
    store = spark.createDataFrame(rows, "key string, value string")
    assert sites.gate_state(store) == (True, {"a.example": False, "b.example": True})
    assert sites.gate_state(store.limit(0)) == (False, {}) and sites.gate_state(spark.createDataFrame([("paused", "1"), ("sites", "no json")], store.schema)) == (False, {})


def test_entries_have_ids_and_places(spark):
    told = spark.createDataFrame([(1, "a", "txt", "infected", 5), (2, "b", "txt", "clean", 6)], "doc_id int, name string, file_type string, verdict string, ts int")
    threats = spark.createDataFrame([(1, "l2", "y", 2, {"line": 2}), (1, "l1", "x" * 1200, 1, {"line": 1})], "doc_id int, layer string, extracted string, line_no int, location map<string,int>")
    got = {r.doc_id: r for r in reports.entries(told, threats, ["line_no"]).collect()}
    assert (got[1].layer, len(got[1].payload), got[1].location, got[2].location) == ("l1", 1000, {"line": 1}, None) and len({r.id for r in got.values()}) == 2


def test_blocked_uploads_of_a_stream(spark, tmp_path):
    """Bodies of requests as a stream: their files, with verdicts, and the marks of those that are stopped."""
    schema = "request_id int, channel string, method string, parts array<struct<kind:string,name:string,type:string,size:long,content:binary>>"
    rows = [(1, "form", "POST", [("file", "bad.pdf", "", 5, b""), ("file", "ok.txt", "", 6, b"")]), (2, "socket", None, [("blob", None, "", None, b"%PDF" + bytes(600)), ("string", None, None, 3, b"abc")])]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    files = uploads.body_files(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    told = files.withColumn("verdict", F.when(F.col("name").contains(".pdf"), "infected").otherwise("clean")).withColumn("ts", F.lit(1))
    guard.block_marks(told).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(60)
    assert sorted((r.name, r.size) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("bad.pdf", 5), ("upload.pdf", 604)]


def test_parts_are_read_up_to_the_limits(spark):
    mb = 1 << 20
    sizes = {1: [100 * mb, 100 * mb, 1, 5], 2: [100 * mb + 1, 1], 3: [None, 99 * mb, None, 99 * mb, 2 * mb, None], 4: [], 5: [0, 200 * mb]}
    rows = [(f, i, f"p{i}", x) for f, xs in sizes.items() for i, x in enumerate(xs)]
    got = {}
    for r in packages.read_parts(spark.createDataFrame(rows, "file_id int, read_ord int, path string, size long")).collect():
        got.setdefault(r.file_id, {})[r.read_ord] = r.stopped
    assert got == {1: {0: False, 1: False, 2: True}, 2: {0: True}, 3: dict.fromkeys(range(6), False), 5: {0: False, 1: True}}


def test_changes_of_site_lists(spark):
    rows = [("u", "a", 1, 1, "add"), ("u", "a", 2, 2, "add"), ("u", "b", 1, 3, "add"), ("u", "b", 5, 4, "remove"), ("u", "c", 1, 5, "add"), ("u", "c", 5, 6, "remove"), ("u", "c", 5, 7, "add"), ("u", "c", 9, 8, "add"), ("v", "a", 3, 9, "remove"), (None, "a", 1, 10, "add"), ("v", None, 1, 11, "add"), (None, "d", 1, 12, "add"), (None, "d", 1, 13, "remove")]
    changes = spark.createDataFrame(rows, "owner string, host string, ts int, id int, action string")
    assert {tuple(r) for r in sites.after_changes(changes).collect()} == {("u", "a", 1), ("u", "c", 7), (None, "a", 10)}


def test_crashes_flush_what_was_not_told(spark):
    at = lambda s: None if s is None else AT + datetime.timedelta(seconds=s)
    rows = [(1, "a", 0, 5, "infected"), (2, "a", 0, 50, "infected"), (3, "a", 11, 50, "infected"), (4, "a", 0, None, None), (5, "a", 11, None, None), (6, "b", 0, 99, "error"), (7, "a", 10, 12, "infected"), (8, "a", 0, 10, "infected"), (9, None, 0, None, None)]
    requests = spark.createDataFrame([(i, s, at(a), at(t), v) for i, s, a, t, v in rows], "id int, session string, asked timestamp, told timestamp, verdict string")
    crashes = spark.createDataFrame([("a", at(10)), ("a", at(10)), ("c", at(0)), (None, at(1))], "session string, at timestamp")
    assert {r.id: r.verdict for r in guard.flushed(requests, crashes).collect()} == {1: "infected", 2: "error", 3: "infected", 4: "error", 5: "clean", 6: "error", 7: "error", 8: "infected", 9: "clean"}


def test_settings_are_upserted(spark):
    rows = [({"a": True, "b": False}, "a", False), ({"a": True}, "c", True), (None, "a", False), ({"a": True}, None, False), ({}, "x", None)]
    df = spark.createDataFrame(rows, "m map<string,boolean>, h string, v boolean")
    assert [r[0] for r in df.select(sites.upserted(F.col("m"), F.col("h"), F.col("v"))).collect()] == [{"a": False, "b": False}, {"a": True, "c": True}, {"a": False}, {"a": True}, {"x": None}]
