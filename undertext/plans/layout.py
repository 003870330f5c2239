"""Queries of pages' layout, runs' attributes, sessions and history entries, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from undertext.functions import attributes, numbers
from undertext.functions.lexicon import PHRASES, dialect
from undertext.operators import layout, packages, reports, run_layers, sites
from undertext.plans import files, pages
from undertext.plans import queries as base
from undertext.plans.queries import RUNS, _t, q, runs
from undertext.streaming import guard

#: Lines on a page, and lines' distance.
A_PAGE, STEP = 5, 60


def _sheet_spans(docs):
    """Runs on pages of five lines, whose sizes differ; some lie beside, above or below theirs."""
    r = runs(docs)
    line = F.col("para_no").cast("long") - 1
    x, y = (F.col("run_no") % 14 * 60 - 60).cast("double"), (F.lit(A_PAGE * STEP) - line % A_PAGE * STEP - 40).cast("double")
    return r.select("doc_id", (F.floor(line / A_PAGE) + 1).alias("page_no"), (line * 100000 + F.col("run_no")).alias("op_index"), "text", F.lit(10.0).alias("size"), x.alias("x0"), y.alias("y0"), (x + 50).alias("x1"), (y + 10).alias("y1"))


def page_boxes(spark, sf_dir):
    """Lines against the boxes of their own pages."""
    spans = _sheet_spans(_t(spark, sf_dir, "documents"))
    # The documents' pages, odd ones large and even ones small, the third of each lacking.
    sheets = spans.select("doc_id", "page_no").distinct().where("page_no <> 3").select("doc_id", "page_no", F.when(F.col("page_no") % 2 == 1, 595.0).otherwise(180.0).alias("width"), F.when(F.col("page_no") % 2 == 1, 842.0).otherwise(200.0).alias("height"))
    return layout.placed_lines(spans, sheets).drop("direct").withColumn("page_no", F.col("page_no").cast("long"))


EXTRA = ("  ", r"plain\s+words", "", r"red\s+house")


def pdf_extra_keywords(spark, sf_dir):
    return run_layers.keyword_lines(pages.spans(_t(spark, sf_dir, "documents")), pages.PAGE, layout.with_extra(PHRASES, EXTRA)).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


#: Planted values of switches (None: no value, absent: no element) and sizes.
SWITCHES = ("1", "true", "on", "TRUE", "0", "off", "", "yes", None, "absent")
SIZES = ("22", "3", "0", "2.5", "-4", "1pt", "2mm", "0.5in", "1.5 pc", "3pi", "12cm", "pt", "1e1pt", "xpt", "5em", "", None, "1.00005mm", "+3pt", ".5pt")


def run_attributes(spark, sf_dir):
    """Runs with attributes as files hold them."""
    spread = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("doc_id") / by) % len(values) + 1).cast("int"))
    raw = _t(spark, sf_dir, "documents").select("doc_id", spread(SWITCHES, 1).alias("s"), spread(SIZES, 3).alias("z"))
    present = ~F.coalesce(F.col("s") == "absent", F.lit(False))
    return raw.select("doc_id", attributes.switched_on(present, F.when(present, F.col("s"))).alias("hidden"), F.round(attributes.points(F.col("z")), 6).alias("size_pt"))


PAINT_NAMES = (*layout.FILLS, "stroke", "clip")


def painted_luminance(spark, sf_dir):
    """Paths of documents' runs by operator, those that fill, with the luminance of their colour; the range of each document."""
    paint = F.element_at(F.array(*map(F.lit, PAINT_NAMES)), (F.col("run_no") % len(PAINT_NAMES) + 1).cast("int"))
    rgb = F.struct((F.col("run_no") * 37 % 256).cast("int").alias("r"), (F.col("para_no") * 53 % 256).cast("int").alias("g"), (F.col("doc_id") % 256).cast("int").alias("b"))
    paths = runs(_t(spark, sf_dir, "documents")).select("doc_id", paint.alias("paint"), rgb.alias("rgb"), F.when(F.col("run_no") % 11 != 0, 0.0).alias("x0"))
    lum = layout.painted(paths).select("doc_id", numbers.luminance(F.col("rgb")).alias("l"))
    return lum.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("l").alias("darkest"), F.max("l").alias("lightest"))


PLACEHOLDERS = ("title", "body", "sldNum", None)


def notes_bodies(spark, sf_dir):
    """Every document's notes pages have a few shapes with placeholders; the first body's text counts."""
    one = F.element_at(F.array(*map(F.lit, PLACEHOLDERS)), ((F.col("doc_id") + F.col("k")) % len(PLACEHOLDERS) + 1).cast("int"))
    k = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 7 + 1).cast("int"))).alias("k"))
    shapes = k.select(F.col("doc_id").alias("file_id"), (F.col("k") % 2 + 1).alias("slide_no"), F.col("k").alias("ord"), one.alias("placeholder"), F.when(F.col("k") % 3 != 0, F.concat(F.lit("notes "), F.col("k").cast("string"))).alias("text"))
    return layout.notes_bodies(shapes).withColumnRenamed("file_id", "doc_id")


def session_verdicts(spark, sf_dir):
    """Events as sessions that are greeted in time, late, twice or never, and ask once; some answers come late, by others or with a wrong nonce."""
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("session"), F.col("ts").cast("timestamp").alias("opened"), "value")
    after = lambda c: F.timestamp_micros(F.unix_micros("opened") + c * 1_000_000)
    s = F.col("session")
    name = lambda letter: F.concat(F.lit(letter), s.cast("string"))
    hellos = e.where("session % 4 <> 0").select("session", after(s % 6).alias("at"), name("n").alias("nonce")).union(e.where("session % 5 = 0").select("session", after(s % 3), name("m")))
    known = guard.greeted(e.select("session", "opened"), hellos)
    requests = e.select(s.alias("id"), "session", after(F.lit(5)).alias("asked"))
    told = e.join(known, "session").select("session", F.when(s % 7 == 0, "wrong").otherwise(F.col("nonce")).alias("nonce"), s.alias("id"), after(5 + s % 200).alias("told"), F.when(F.col("value") > 30, "infected").otherwise("unscannable").alias("verdict"), (s % 11 != 0).alias("own_channel"), (s % 13 != 0).alias("own_window"))
    return guard.decided(requests, known, told)


CHOICES = ("block", "allow", None)


def answered_files(spark, sf_dir):
    """Reports of files after people's choices on infected and unreadable ones, and those that are stopped then."""
    told = files.file_reports(spark, sf_dir).select("doc_id", "name", F.col("file_type").alias("type"), "size", "verdict", F.col("doc_id").alias("ts"))
    choice = F.when(F.col("verdict").isin("infected", "error"), F.element_at(F.array(*map(F.lit, CHOICES)), (F.col("doc_id") % len(CHOICES) + 1).cast("int")))
    return guard.block_marks(told.withColumn("verdict", guard.answer(F.col("verdict"), choice))).withColumnRenamed("ts", "doc_id")


def history_entries(spark, sf_dir):
    """Entries with the place of their first threat; ids are left out, as they are random."""
    told, threats = base._reports(spark, sf_dir)
    threats = threats.withColumn("location", F.struct(F.col("line_no").alias("line"), "col"))
    return reports.entries(told, threats, ["line_no", "col"]).select("doc_id", "verdict", "layer", "location.line", "location.col")


def package_limits(spark, sf_dir):
    """Every document's package declares up to nine parts of up to 120 MB."""
    k = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 9 + 1).cast("int"))).alias("read_ord"))
    size = F.when((F.col("doc_id") + F.col("read_ord")) % 7 != 0, (F.col("doc_id") * 31 + F.col("read_ord") * 17) % 120 * 1_000_000)
    return packages.read_parts(k.select(F.col("doc_id").alias("file_id"), "read_ord", F.concat(F.lit("p"), F.col("read_ord").cast("string")).alias("path"), size.alias("size"))).withColumnRenamed("file_id", "doc_id")


def custom_sites(spark, sf_dir):
    """Signups add a host to a user's list and errors remove one."""
    events = _t(spark, sf_dir, "events").where("event_type in ('signup', 'error')")
    host = F.concat(F.lit("h"), F.floor(F.col("value") % 3).cast("int").cast("string"), F.lit(".example.org"))
    changes = events.select(F.col("user_id").alias("owner"), host.alias("host"), "ts", F.col("event_id").alias("id"), F.when(F.col("event_type") == "signup", "add").otherwise("remove").alias("action"))
    return sites.after_changes(changes)


def crash_flush(spark, sf_dir):
    """Clicks ask; answers take up to 50,000 seconds or never come; a user's errors are crashes."""
    e = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    told = F.when(F.col("event_id") % 7 != 0, F.timestamp_micros(F.unix_micros("ts") + F.col("event_id") * 7919 % 50_000 * 1_000_000))
    verdict = F.when(told.isNotNull(), F.when(F.col("value") > 30, "infected").otherwise("unscannable"))
    asked = e.where("event_type = 'click'").select(F.col("event_id").alias("id"), F.col("user_id").alias("session"), F.col("ts").alias("asked"), told.alias("told"), verdict.alias("verdict"))
    return guard.flushed(asked, e.where("event_type = 'error'").select(F.col("user_id").alias("session"), F.col("ts").alias("at")))


QUERIES = {f.__name__: f for f in (package_limits, custom_sites, crash_flush, page_boxes, pdf_extra_keywords, run_attributes, painted_luminance, notes_bodies, session_verdicts, answered_files, history_entries)}

_S = f"""(SELECT doc_id, (para_no - 1) // {A_PAGE} + 1 AS page_no, (para_no - 1) * 100000 + run_no AS op_index, CAST(run_no % 14 * 60 - 60 AS DOUBLE) AS x0, CAST({A_PAGE * STEP} - (para_no - 1) % {A_PAGE} * {STEP} - 40 AS DOUBLE) AS y0 FROM {RUNS})"""
_B = f"(SELECT *, x0 + 50 AS x1, y0 + 10 AS y1, CASE page_no % 2 WHEN 1 THEN 595.0 ELSE 180.0 END AS w, CASE page_no % 2 WHEN 1 THEN 842.0 ELSE 200.0 END AS h FROM {_S} WHERE page_no <> 3)"
_ALL = layout.with_extra(PHRASES, EXTRA)
_LIST = lambda values: "([" + ", ".join("NULL" if v is None else q(v) for v in values) + "])"
_FIRST = "SELECT event_id AS s, value, ts, arg_min(nonce, (late, nonce)) AS nonce FROM events e LEFT JOIN (SELECT event_id, 'n' || event_id AS nonce, event_id % 6 AS late FROM events WHERE event_id % 4 <> 0 UNION ALL SELECT event_id, 'm' || event_id, event_id % 3 FROM events WHERE event_id % 5 = 0) h USING (event_id) WHERE late IS NULL OR late <= 3 GROUP BY 1, 2, 3"

SQL = {
    "package_limits": f"""SELECT doc_id, CAST(k AS INT) AS read_ord, 'p' || k AS path, CAST(total AS BIGINT) AS total, stopped FROM (SELECT *, coalesce(bool_or(stopped) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS past FROM (
      SELECT *, coalesce(size > 104857600, false) OR (coalesce(size, 0) > 0 AND total > 209715200) AS stopped FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY k), 0) AS total FROM (
        SELECT doc_id, k, CASE WHEN (doc_id + k) % 7 <> 0 THEN (doc_id * 31 + k * 17) % 120 * 1000000 END AS size FROM {files._K.replace('doc_id % 5', 'doc_id % 9')})))) WHERE NOT past""",
    "custom_sites": """WITH c AS (SELECT user_id AS owner, 'h' || CAST(floor(value % 3) AS INT) || '.example.org' AS host, ts, event_id AS id, event_type AS kind FROM events WHERE event_type IN ('signup', 'error'))
      SELECT owner, host, arg_min(id, (ts, id)) AS place FROM c a WHERE kind = 'signup' AND NOT EXISTS (SELECT 1 FROM c r WHERE r.kind = 'error' AND r.owner = a.owner AND r.host = a.host AND (r.ts, r.id) > (a.ts, a.id)) GROUP BY 1, 2""",
    "crash_flush": """SELECT c.event_id AS id, CASE WHEN min(e.ts) IS NOT NULL AND (c.event_id % 7 = 0 OR min(e.ts) < c.ts + to_seconds(c.event_id * 7919 % 50000)) THEN 'error' WHEN c.event_id % 7 = 0 THEN 'clean' WHEN c.value > 30 THEN 'infected' ELSE 'unscannable' END AS verdict
      FROM events c LEFT JOIN events e ON e.event_type = 'error' AND e.user_id = c.user_id AND e.ts >= c.ts WHERE c.event_type = 'click' GROUP BY c.event_id, c.ts, c.value""",
    "page_boxes": f"SELECT doc_id, page_no, CAST(floor(y0 + 2 + 0.5) AS BIGINT) AS line_key, min(op_index) AS first_op, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) FILTER (x1 <= 0 OR y1 <= 0 OR x0 >= w OR y0 >= h) AS n_off, min(x0) < min(w) AND max(x1) > 0 AND min(y0) < min(h) AND max(y1) > 0 AS on_page FROM {_B} GROUP BY 1, 2, 3",
    "pdf_extra_keywords": "SELECT pattern, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(direct, {q(dialect(p, False))}) THEN {q(p)}" for p in _ALL) + f" END AS pattern FROM {pages._joined(pages.SPANS, 'true', pages.ON_PAGE)} WHERE direct <> '') WHERE pattern IS NOT NULL GROUP BY 1",
    "run_attributes": f"""SELECT doc_id, CASE WHEN s = 'absent' THEN NULL WHEN s IS NULL THEN true ELSE s IN ('1', 'true', 'on') END AS hidden, round(CASE WHEN regexp_matches(z, '[mnp]') THEN floor(CASE trim(left(z, -2)) WHEN '' THEN 0.0 ELSE try_cast(trim(left(z, -2)) AS DOUBLE) END
        * CASE right(z, 2) WHEN 'mm' THEN 36000 WHEN 'cm' THEN 360000 WHEN 'in' THEN 914400 WHEN 'pt' THEN 12700 WHEN 'pc' THEN 152400 WHEN 'pi' THEN 152400 END + 0.5) / 12700 WHEN regexp_full_match(z, '[0-9]+') THEN CAST(z AS DOUBLE) / 2 END, 6) AS size_pt
      FROM (SELECT doc_id, {_LIST(SWITCHES)}[doc_id % {len(SWITCHES)} + 1] AS s, {_LIST(SIZES)}[doc_id // 3 % {len(SIZES)} + 1] AS z FROM documents)""",
    "painted_luminance": f"""SELECT doc_id, count(*) AS n, min(l) AS darkest, max(l) AS lightest FROM (SELECT doc_id, CAST(floor((run_no * 37 % 256) * CAST(0.299 AS DOUBLE) + (para_no * 53 % 256) * CAST(0.587 AS DOUBLE) + (doc_id % 256) * CAST(0.114 AS DOUBLE) + 0.5) AS INT) AS l
      FROM {RUNS} WHERE {_LIST(PAINT_NAMES)}[run_no % {len(PAINT_NAMES)} + 1] NOT IN ('stroke', 'clip') AND run_no % 11 <> 0) GROUP BY 1""",
    "notes_bodies": f"SELECT doc_id, CAST(k % 2 + 1 AS INT) AS slide_no, arg_min(CASE WHEN k % 3 <> 0 THEN 'notes ' || k ELSE '' END, k) AS notes FROM {files._K.replace('doc_id % 5', 'doc_id % 7')} WHERE {_LIST(PLACEHOLDERS)}[(doc_id + k) % {len(PLACEHOLDERS)} + 1] = 'body' GROUP BY 1, 2",
    "session_verdicts": f"SELECT e.event_id AS id, CASE WHEN f.nonce IS NOT NULL AND s % 7 <> 0 AND s % 11 <> 0 AND s % 13 <> 0 AND s % 200 <= 120 THEN CASE WHEN e.value > 30 THEN 'infected' ELSE 'unscannable' END ELSE 'clean' END AS verdict FROM events e LEFT JOIN ({_FIRST}) f ON f.s = e.event_id",
    "answered_files": f"""SELECT doc_id, name, file_type AS type, size, answered AS verdict FROM (SELECT *, CASE WHEN verdict NOT IN ('infected', 'error') OR choice IS NULL THEN verdict WHEN choice = 'block' THEN 'infected' WHEN verdict = 'infected' THEN 'clean' ELSE 'error' END AS answered
      FROM (SELECT *, {_LIST(CHOICES)}[doc_id % 3 + 1] AS choice FROM {files._REPORTS})) WHERE answered = 'infected'""",
    "history_entries": f"SELECT r.doc_id, verdict, CASE WHEN t.doc_id IS NOT NULL THEN 'zero_width' END AS layer, CAST(line AS INT) AS line, CAST(col AS INT) AS col FROM {base._R} r LEFT JOIN (SELECT doc_id, arg_min(line_no, line_no * 100000000 + col) AS line, arg_min(col, line_no * 100000000 + col) AS col FROM {base._Z} GROUP BY 1) t USING (doc_id)",
}
