import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from undertext.functions import canonical, numbers
from undertext.operators import completeness, labels, packages, reports, sites, uploads

#: Values that must occur in the answers over the small tables, by query and column.
CLASSES = {
    "file_reports": {"verdict": {"clean", "infected", "unscannable", "error"}, "file_type": {"txt", "md", "pdf", "docx", "pptx"}, "code": {None, "OVERSIZED", "ENCRYPTED", "CORRUPT", "INTERNAL"}, "message": {None, *reports.MESSAGES.values()}, "reason": {None, reports.IMAGE_ONLY}},
    "verdict_rollup": {"verdict": {"clean", "infected", "unscannable", "error"}},
    "sniff_type": {"file_type": {"txt", "pdf", "docx", "pptx"}},
    "docx_threats": {"layer": {"hidden_attr", "white_on_white", "tiny_font"}, "severity": {"high", "medium"}},
    "pdf_z_index": {"cover": {"image", "shape"}},
    "pptx_speaker_notes": {"scan": {"raw", "collapsed", "adversarial_keywords"}},
    "labelled_entries": {"title": {*labels.ERRORS.values(), labels.OTHER_ERROR}, "description": {*labels.LAYERS.values(), "", "new_layer"}, "badge": set(labels.VERDICTS.values()), "expandable": {True, False}, "noted": {True, False}},
    "beacon_replay": {"scannable": {True, False}},
    "frame_release": {"delivered": {True, False}},
    "site_list": {"builtin": {True, False}, "rank": {0, 1, 2}},
    "request_gate": {"blocked": {True, False}},
    "gate_config_in_force": {"active": {True, False}},
}


@pytest.mark.parametrize("name", sorted(CLASSES))
def test_every_class_of_the_answer_occurs(spark, name):
    rows = entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    for column, values in CLASSES[name].items():
        assert {r[column] for r in rows} == values


@pytest.mark.parametrize(
    "folder,target,path",
    [("ppt", "slides/a.xml", "ppt/slides/a.xml"), ("ppt/slides", "../media/./b.png", "ppt/media/b.png"), ("ppt", "../../../x", "x"), ("", "a//b/", "a/b"), ("/a/b/", "..", "a"), ("a", "", "a"), ("ppt", "/ppt/slides/a.xml", "ppt/ppt/slides/a.xml"), (None, "a", None)],
)
def test_targets(spark, folder, target, path):
    df = spark.createDataFrame([(folder, target)], "f string, t string")
    assert df.select(packages.resolved(F.col("f"), F.col("t"))).first()[0] == path


def test_slides_close_up_and_take_their_first_notes(spark):
    top, notes = packages.LISTING, packages.NOTES
    listed = [(1, 1, "a"), (1, 2, "gone"), (1, 3, "nopart"), (1, 4, "b"), (1, 5, None), (2, 1, "a"), (1, 6, "a")]
    rels = [(1, top, 1, "a", "t", "slides/1.xml"), (1, top, 2, "nopart", "t", "slides/9.xml"), (1, top, 3, "b", "t", "wrong.xml"), (1, top, 4, "b", "t", "./slides/2.xml"), (1, "ppt/slides/1.xml", 1, "x", "other", "../n/0.xml"), (1, "ppt/slides/1.xml", 2, "y", notes, "../n/1.xml"), (1, "ppt/slides/1.xml", 3, "z", notes, "../n/2.xml"), (1, "ppt/slides/2.xml", 1, "x", notes, "../n/none.xml"), (1, "ppt/slides/2.xml", 2, "y", notes, "../n/2.xml"), (1, top, 9, "c", None, "x")]
    parts = [(1, f"ppt/{p}.xml") for p in ("slides/1", "slides/2", "n/0", "n/1", "n/2", "n/2")] + [(2, "ppt/slides/1.xml")]
    frames = spark.createDataFrame(listed, "file_id int, ord int, rel_id string"), spark.createDataFrame(rels, "file_id int, source string, ord int, rel_id string, type string, target string"), spark.createDataFrame(parts, "file_id int, path string")
    got = sorted(map(tuple, packages.slides(*frames).collect()))
    assert got == [(1, 1, "ppt/slides/1.xml", "ppt/n/1.xml"), (1, 2, "ppt/slides/2.xml", None), (1, 3, "ppt/slides/1.xml", "ppt/n/1.xml")]
    assert packages.slides(*[f.limit(0) for f in frames]).count() == 0


def test_bodies(spark):
    part = "struct<kind:string,name:string,type:string,size:long,content:binary>"
    b = lambda n: bytes(n)
    rows = [
        (1, "form", "POST", [("file", "a", "x/y", 5, b""), ("string", None, None, 3, b"abc"), ("file", "empty", "", 0, b""), ("file", "b", None, 1, None)]),
        (2, "blob", "put", [("blob", None, "", 9, b"")]), (3, "blob", "PUT", [("blob", None, "image/png", 9, b"")]), (4, "blob", "POST", [("blob", None, "", 9, b"")]), (5, "blob", "PUT", [("blob", None, "", 0, b"")]),
        (6, "socket", None, [("blob", None, None, None, b(511)), ("blob", None, None, None, b(512)), ("string", None, None, None, b(4000)), ("buffer", None, "a/b", None, b"%PDF" + b(600)), ("blob", None, None, None, None)]),
        (7, "file", "POST", [("file", "c.txt", "text/plain", 2, b"")]), (8, "form", "POST", []), (9, "form", "POST", None), (10, "beacon", "POST", [("blob", None, "", None, b"PK\x03\x04 word/" + b(600))]), (11, "blob", "Put", [("blob", None, None, 4, b"")]),
    ]
    df = spark.createDataFrame(rows, f"request_id int, channel string, method string, parts array<{part}>")
    got = sorted(map(tuple, uploads.body_files(df).collect()))
    octet = "application/octet-stream"
    assert got == [(1, 1, "a", "x/y", 5), (1, 4, "b", "", 1), (2, 1, "upload.bin", "", 9), (6, 2, "upload.txt", octet, 512), (6, 4, "upload.pdf", "a/b", 604), (7, 1, "c.txt", "text/plain", 2), (10, 1, "upload.docx", octet, 610), (11, 1, "upload.bin", "", 4)]


@pytest.mark.parametrize("mime,yes", [("", True), (None, True), ("application/vnd.openxmlformats-OFFICEDOCUMENT", True), ("text/markdown", True), ("text/html", False), ("application/msword", True)])
def test_mime(spark, mime, yes):
    assert spark.createDataFrame([(mime,)], "m string").select(uploads.may_be_document(F.col("m"))).first()[0] is yes


def test_faults_come_in_order(spark):
    head, zip_ = reports.ENCRYPTED_MAGIC + b"x", b"PK\x03\x04"
    rows = [("pdf", 50 * 2**20 + 1, None, "password", None), ("pdf", 50 * 2**20, None, "password", None), ("txt", 1, head, "internal", None), ("docx", 1, head, "bomb", None), ("docx", 1, zip_, "bomb", None), ("pdf", 1, zip_, "bomb", None), ("pptx", 1, zip_, None, None), ("pptx", 1, zip_, None, True), ("docx", None, None, "??", None), ("docx", 1, zip_, "internal", None), ("md", 1, None, None, None)]
    df = spark.createDataFrame(rows, "k string, size long, head binary, opened string, listing boolean")
    assert [r[0] for r in df.select(reports.fault(*map(F.col, df.columns))).collect()] == ["OVERSIZED", "ENCRYPTED", None, "ENCRYPTED", "OVERSIZED inside", "CORRUPT", "CORRUPT", None, "CORRUPT", "INTERNAL", None]


def test_reports_of_text_free_pages(spark):
    files = spark.createDataFrame([(i, f"f{i}.{k}", 9, None, o, None) for i, k, o in ((1, "pdf", None), (2, "pdf", None), (3, "pdf", None), (4, "txt", None), (5, "pdf", "x"), (6, "pdf", None))], "doc_id int, name string, size long, head binary, opened string, has_listing boolean")
    sheets = spark.createDataFrame([(1, 1, 0, 0), (1, 2, None, 2), (2, 1, 0, 1), (2, 2, 4, 0), (3, 1, 0, 0), (5, 1, 0, 1)], "doc_id int, page_no int, text_chars int, n_images int")
    threats = spark.createDataFrame([(2, "spatial"), (5, "spatial"), (2, "micro_font"), (2, "spatial")], "doc_id int, layer string")
    got = {r.doc_id: (r.verdict, r.pages, r.n_threats, r.layers, r.code) for r in reports.file_reports(files, threats, reports.page_facts(sheets)).collect()}
    assert got == {1: ("unscannable", 2, 0, "", None), 2: ("infected", 2, 3, "micro_font,spatial", None), 3: ("clean", 1, 0, "", None), 4: ("clean", None, 0, "", None), 5: ("error", None, 0, "", "CORRUPT"), 6: ("clean", None, 0, "", None)}


def test_places(spark):
    fields = "page long, paragraph long, slide long, line long, col long"
    rows = [((3, 4, 5, 6, 7), k) for k in ("pdf", "docx", "pptx", "txt", "md", "zip", None)] + [((None, None, None, 6, None), "md"), ((None,) * 5, "pdf"), ((None, None, None, None, 7), "txt"), (None, "pdf")]
    df = spark.createDataFrame(rows, f"l struct<{fields.replace(' long', ':long')}>, k string")
    assert [r[0] for r in df.select(labels.place(F.col("l"), F.col("k"))).collect()] == ["עמוד 3", "פסקה 4", "שקף 5", "שורה 6, עמודה 7", "שורה 6, עמודה 7", "", "", "שורה 6", "", "", ""]


@pytest.mark.parametrize("x", [0.5, 1.5, 2.5, -0.5, -1.5, -2.5, 0.125, -0.125, 2.675, 1.005, 0.0, -3.0, 1e9 + 0.5, 12.0625, None])
def test_rounding(spark, x):
    df = spark.createDataFrame([(x,)], "x double").select(*[f(F.col("x"), d).alias(f"{f.__name__}{d}") for f in (numbers.half_up, numbers.half_even) for d in (0, 2, 3)]).first()
    for d in (0, 2, 3):
        up = None if x is None else math.floor(x * 10**d + 0.5) / 10**d
        low = None if x is None else math.floor(x * 10**d)
        even = None if x is None else (low + (x * 10**d - low > 0.5 or (x * 10**d - low == 0.5 and low % 2 == 1))) / 10**d
        assert (df[f"half_up{d}"], df[f"half_even{d}"]) == (up, even)


def test_colours(spark):
    rows = [("rgb", [1.0, 2.0, 3.0]), ("grey", [0.5]), ("cmyk", [0.0, 0.5, 1.0, 0.25]), ("cmyk", [0.0, 0.5, 1.0]), ("pattern", [0.1, 0.2, 0.3]), ("grey", None), ("rgb", [1.0, None, 3.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "k string, v array<double>")
    assert [tuple(r[0]) for r in df.select(numbers.colour(F.col("k"), F.col("v"))).collect()] == [(1, 2, 3), (128, 128, 128), (191, 64, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_canonical_forms_do_not_depend_on_order(spark):
    one = spark.sql("SELECT map('b', named_struct('y', array(map('q', 1, 'p', 2)), 'x', null), 'a', null) AS v")
    two = spark.sql("SELECT map('a', null, 'b', named_struct('x', null, 'y', array(map('p', 2, 'q', 1)))) AS v")
    texts = {df.select(canonical.stable(F.col("v"), df.schema["v"].dataType)).first()[0] for df in (one, two)}
    assert texts == {'{"a":null,"b":{"x":null,"y":[{"p":2,"q":1}]}}'}
    none = spark.sql("SELECT CAST(null AS map<string,int>) AS v, array('b', 'a', null, 'a') AS t")
    assert none.select(canonical.stable(F.col("v"), none.schema["v"].dataType), canonical.in_order(F.col("t"))).first()[:] == ("null", "a\na\nb")


def test_grid_shows_empty_and_unexpected_cells(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), (None, "x"), ("z", "x")], "k string, v string")
    got = {(r.k, r.v, r.level): (r.n, r.expected) for r in completeness.grid(df, {"k": ("a", "b"), "v": ("x", "y")}).collect()}
    assert got == {("a", "x", 0): (2, True), ("a", "y", 0): (0, True), ("b", "x", 0): (0, True), ("b", "y", 0): (1, True), (None, "x", 0): (1, False), ("z", "x", 0): (1, False), ("a", None, 1): (2, True), ("b", None, 1): (1, True), (None, None, 1): (1, False), ("z", None, 1): (1, False), (None, "x", 2): (4, True), (None, "y", 2): (1, True), (None, None, 3): (5, True)}
    assert {r.n for r in completeness.grid(df.limit(0), {"k": ("a",), "v": ("x",)}).collect()} == {0}


def test_sites(spark):
    custom = spark.createDataFrame([("a-b.example.org", 1), (sites.STATIC[0], 2), (sites.OFFERED[0], 3), ("c.example.org", 4)], "host string, place int")
    granted = spark.createDataFrame([(f"https://{h}/*",) for h in ("a-b.example.org", sites.STATIC[1], sites.OFFERED[0], "other.org")], "origin string")
    known = sites.known_sites(custom)
    assert [r.host for r in known.orderBy("rank", "place").collect()] == [*sites.STATIC, *sites.OFFERED, "a-b.example.org", sites.STATIC[0], sites.OFFERED[0], "c.example.org"]
    assert {tuple(r) for r in sites.to_register(known, granted).collect()} == {("a-b.example.org", "https://a-b.example.org/*", "a_b.example.org"), (sites.OFFERED[0], f"https://{sites.OFFERED[0]}/*", sites.OFFERED[0])}
