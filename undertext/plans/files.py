"""Queries of files: packages, reports, uploads, labels, numbers and canonical forms, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from undertext.functions import canonical, numbers
from undertext.functions.lexicon import COLLAPSED, PHRASES
from undertext.functions.text import is_adversarial
from undertext.operators import completeness, labels, packages, reports, run_layers, sites, text_layers, uploads
from undertext.plans import pages
from undertext.plans import queries as base
from undertext.plans.queries import POOL, RUNS, _pick, _t, adv, planted, q, runs
from undertext.streaming import order

#: Planted targets of slides; the last has no relationship.
TARGETS = ("slides/slide#.xml", "./slides/slide#.xml", "../ppt/slides/slide#.xml", "slides/x/../..//slides/./slide#.xml", "")
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/slide"


def _packages(docs):
    """Every document's package lists up to five slides: some without relationship or part, some with two relationships of one id, notes of which some have no part."""
    k = docs.select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 5 + 1).cast("int"))).alias("k"))
    k = k.withColumn("n", F.col("k").cast("string")).withColumn("way", (F.col("doc_id") + F.col("k")) % 5)
    listed = k.select(F.col("doc_id").alias("file_id"), F.col("k").alias("ord"), F.concat(F.lit("rId"), "n").alias("rel_id"))
    target = F.replace(F.element_at(F.array(*map(F.lit, TARGETS)), (F.col("way") + 1).cast("int")), F.lit("#"), F.col("n"))
    rel = lambda source, place, rel_id, kind, target: F.struct(source.alias("source"), place.alias("ord"), rel_id.alias("rel_id"), F.lit(kind).alias("type"), target.alias("target"))
    text = lambda *parts: F.concat(*[F.lit(p) if p != "n" else F.col("n") for p in parts])
    path = text("ppt/slides/slide", "n", ".xml")
    rels = F.array_compact(F.array(
        F.when(F.col("way") != 4, rel(F.lit(packages.LISTING), F.col("k"), text("rId", "n"), OFFICE, F.when(F.col("way") == 3, "gone.xml").otherwise(target))),
        F.when(F.col("way") == 3, rel(F.lit(packages.LISTING), F.col("k") + 10, text("rId", "n"), OFFICE, target)),
        F.when((F.col("doc_id") + F.col("k")) % 3 == 1, rel(path, F.lit(2), F.lit("rId2"), packages.NOTES, text("../notes/n", "n", ".xml"))),
        F.when((F.col("doc_id") + F.col("k")) % 6 == 4, rel(path, F.lit(1), F.lit("rId9"), packages.NOTES, F.lit("../notes/none.xml"))),
        F.when((F.col("doc_id") + F.col("k")) % 3 == 2, rel(path, F.lit(1), F.lit("rId1"), OFFICE, F.lit("../slides/other.xml"))),
    ))
    all_rels = k.select(F.col("doc_id").alias("file_id"), F.explode(rels).alias("r")).select("file_id", "r.*")
    there = F.array_compact(F.array(F.when((F.col("doc_id") * 3 + F.col("k")) % 7 != 0, path), text("ppt/notes/n", "n", ".xml")))
    parts = k.select(F.col("doc_id").alias("file_id"), F.explode(there).alias("path"))
    return listed, all_rels, parts


def package_slides(spark, sf_dir):
    return packages.slides(*_packages(_t(spark, sf_dir, "documents"))).withColumnRenamed("file_id", "doc_id")


def _by_type(docs, *kinds):
    return docs.where(sites.file_type(_pick(base.NAMES)).isin(*kinds))


def file_reports(spark, sf_dir):
    """Documents as files of all kinds, by their planted names, each scanned by the layers of its kind; some cannot be read."""
    docs = _t(spark, sf_dir, "documents")
    pdf, pptx = _by_type(docs, "pdf"), _by_type(docs, "pptx")
    spans = pages.spans(pdf.where("doc_id % 28 <> 0"))
    far = run_layers.from_white(*[F.col("grey")] * 3)
    layer = lambda df, name: df.select("doc_id", F.lit(name).alias("layer"))
    threats = [
        layer(text_layers.zero_width(text_layers.line_table(planted(_by_type(docs, "txt", "md")))), "zero_width"),
        layer(run_layers.span_lines(spans, far < 25, pages.PAGE), "color_threshold"),
        layer(run_layers.span_lines(spans, F.col("size") < 2.0, pages.PAGE), "micro_font"),
        layer(run_layers.span_lines(spans, run_layers.off_page(*pages.PAGE)), "spatial"),
        layer(run_layers.keyword_lines(spans, pages.PAGE, PHRASES), "regex_keyword"),
        run_layers.docx_threats(runs(_by_type(docs, "docx"))).select("doc_id", "layer"),
        layer(run_layers.note_threats(pptx.select("doc_id", F.lit(1).alias("slide_no"), pages.note_pool().alias("notes")), PHRASES, COLLAPSED), "speaker_notes"),
    ]
    all_threats = threats[0]
    for more in threats[1:]:
        all_threats = all_threats.unionByName(more)
    text = run_layers.page_lines(spans, F.lit(True), pages.PAGE).groupBy("doc_id", "page_no").agg(F.sum(F.length("direct")).alias("text_chars"))
    leaves = pdf.select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int"))).alias("page_no"))
    sheets = leaves.join(text, ["doc_id", "page_no"], "left").withColumn("n_images", F.when((F.col("doc_id") / 7 + F.col("page_no")) % 4 < 2, 1).otherwise(0))
    slides = packages.slides(*_packages(pptx)).groupBy(F.col("file_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("pages"))
    units = reports.page_facts(sheets).unionByName(slides.withColumn("text_chars", F.lit(None).cast("long")).withColumn("has_images", F.lit(False)))
    head = F.when(F.col("doc_id") % 11 == 0, F.lit(reports.ENCRYPTED_MAGIC)).otherwise(F.encode(F.lit("PK\x03\x04"), "UTF-8"))
    opened = F.when(F.col("doc_id") % 13 == 0, "not of its kind").when(F.col("doc_id") % 17 == 0, "internal").when(F.col("doc_id") % 19 == 0, "bomb").when(F.col("doc_id") % 23 == 0, "password")
    files = docs.select("doc_id", _pick(base.NAMES).alias("name"), (F.octet_length("text").cast("long") * 10_000).alias("size"), head.alias("head"), opened.alias("opened"), (F.col("doc_id") % 10 != 0).alias("has_listing"))
    return reports.file_reports(files, all_threats, units)


def file_reports_by_class(spark, sf_dir):
    """Files by kind and verdict, held against all cells that there could be, with sums by kind, by verdict and of all."""
    told = file_reports(spark, sf_dir).select("file_type", "verdict")
    return completeness.grid(told, {"file_type": ("txt", "md", "pdf", "docx", "pptx"), "verdict": ("clean", "infected", "unscannable", "error")})


MIMES = ("", "application/pdf", "text/plain; charset=utf-8", "image/png", "APPLICATION/OCTET-STREAM", "text/html")
CHANNELS = ("form", "file", "blob", "socket", "peer", "beacon", "form")


def _bodies(docs):
    """Every document's text is cut into up to four parts of requests by several ways."""
    part = F.struct(
        F.element_at(F.array(*map(F.lit, ("file", "blob", "string"))), ((F.col("doc_id") + F.col("i")) % 3 + 1).cast("int")).alias("kind"),
        F.concat(F.lit("part"), F.col("i").cast("string"), F.lit(".pdf")).alias("name"),
        F.element_at(F.array(*map(F.lit, MIMES)), ((F.col("doc_id") + 2 * F.col("i")) % len(MIMES) + 1).cast("int")).alias("type"),
        F.octet_length("content").cast("long").alias("size"),
        "content",
    )
    heads = F.element_at(F.array(*map(F.lit, base.HEADS)), (F.col("doc_id") % len(base.HEADS) + 1).cast("int"))
    cut = F.encode(F.substring(F.concat(heads, F.regexp_replace("text", "[^ -~]", "")), F.lit(1), F.when(F.col("i") == 0, 0).when(F.col("i") == 1, 511).when(F.col("i") == 2, 512).otherwise(4000).cast("int")), "UTF-8")
    parts = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int"))).alias("i")).withColumn("content", cut)
    grouped = parts.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", part.alias("p")))), lambda x: x["p"]).alias("parts"))
    method = F.element_at(F.array(F.lit("put"), F.lit("POST"), F.lit(None)), (F.floor(F.col("doc_id") / 7) % 3 + 1).cast("int"))
    channel = F.element_at(F.array(*map(F.lit, CHANNELS)), (F.col("doc_id") % len(CHANNELS) + 1).cast("int"))
    return grouped.select(F.col("doc_id").alias("request_id"), channel.alias("channel"), method.alias("method"), "parts")


def upload_files(spark, sf_dir):
    return uploads.body_files(_bodies(_t(spark, sf_dir, "documents")))


CODES = ("CORRUPT", "ENCRYPTED", "OVERSIZED", "UNSUPPORTED", "TIMEOUT", "IO", "INTERNAL", "NEW", None)
LAYER_NAMES = (*labels.LAYERS, "new_layer", None)
PATHS = ("C:\\files\\a.pdf", "/home/x/b.docx", "c.pptx", "dir/", "a/b\\c.txt")
KINDS = ("pdf", "docx", "pptx", "txt", "md", "zip")


def labelled_entries(spark, sf_dir):
    """History entries as people see them: layer, error, verdict, place, name and time in words."""
    at = lambda name, step: F.when((F.col("doc_id") + step) % 4 != 0, (F.col("doc_id") % 50 + step).cast("long")).alias(name)
    spread = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("doc_id") / by) % len(values) + 1).cast("int"))
    location = F.struct(at("page", 0), at("paragraph", 1), at("slide", 2), at("line", 3), at("col", 4))
    e = _t(spark, sf_dir, "documents").select("doc_id", spread(LAYER_NAMES, 1).alias("layer"), spread(CODES, 2).alias("code"), spread(tuple(labels.VERDICTS), 3).alias("verdict"), spread(KINDS, 1).alias("kind"), location.alias("location"), spread(PATHS, 1).alias("path"), (F.col("doc_id") * 86_399_999).alias("ts"), F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 20)).alias("payload"))
    e = labels.labelled(e, "layer", labels.LAYERS, "description", F.coalesce("layer", F.lit("")))
    e = labels.labelled(e.withColumn("code", F.coalesce("code", F.lit(labels.DEFAULT_ERROR))), "code", labels.ERRORS, "title", F.lit(labels.OTHER_ERROR))
    e = labels.labelled(e, "verdict", labels.VERDICTS, "badge", F.col("verdict"))
    return e.select("doc_id", "description", "title", "badge", labels.place(F.col("location"), F.col("kind")).alias("place"), labels.base_name(F.col("path")).alias("name"), labels.clock(F.col("ts")).alias("shown_at"), labels.expandable(F.col("verdict"), F.col("payload")).alias("expandable"), labels.noted(F.col("verdict"), F.col("code")).alias("noted"))


def rounded_numbers(spark, sf_dir):
    """Prices and discounts of line items as numbers to be rounded, many of them half-way, also below zero."""
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_orderkey") % 4001 - 2000) / 16.0).alias("x"), (F.col("l_linenumber") / 8.0).alias("level"))
    return items.select("l_orderkey", "l_linenumber", numbers.half_up(F.col("x"), 2).alias("up2"), numbers.half_even(F.col("x"), 2).alias("even2"), numbers.half_up(F.col("x"), 0).alias("up0"), numbers.half_even(F.col("x"), 0).alias("even0"), numbers.half_even(F.col("x"), 3).alias("even3"))


PAINTS = ("rgb", "grey", "cmyk", "pattern")


def line_colours(spark, sf_dir):
    """Spans of lines in colours of several kinds; each line's first colour and its least distance from white."""
    kind = F.element_at(F.array(*map(F.lit, PAINTS)), ((F.col("run_no") + F.col("doc_id")) % len(PAINTS) + 1).cast("int"))
    v = F.when(kind == "rgb", F.array(*[F.lit(255.0) - F.col("para_no") % 5 * k for k in (0, 1, 2)])).when(kind == "grey", F.array((F.col("run_no") + F.col("doc_id")) % 9 / 8.0)).when(kind == "cmyk", F.array(*[(F.col("run_no") + k) % 17 / 16.0 for k in range(3)], F.col("para_no") % 3 / 4.0)).otherwise(F.array(F.lit(1.0)))
    spans = runs(_t(spark, sf_dir, "documents")).select("doc_id", "para_no", F.col("run_no").alias("op_index"), numbers.colour(kind, v).alias("rgb"))
    far = run_layers.from_white(*[F.col("rgb")[c] for c in "rgb"])
    return numbers.line_colours(spans, ("doc_id", "para_no"), far)


def canonical_threats(spark, sf_dir):
    """Each document's threats as texts that do not depend on the order of keys or rows."""
    found = base.zero_width_threats(spark, sf_dir)
    line, col, point = ((F.lit(n), F.col(c).cast("string")) for n, c in (("line", "line_no"), ("col", "col"), ("codepoint", "codepoint")))
    location = F.when(F.col("doc_id") % 2 == 0, F.create_map(*line, *col, *point)).otherwise(F.create_map(*point, *line, *col))
    details = F.when(F.col("doc_id") % 3 == 0, F.struct(F.col("codepoint"), F.array(F.struct(F.col("line_no").alias("b"), F.when(F.col("col") > 9, F.col("col")).alias("a"))).alias("at")))
    both = found.select("doc_id", "payload", location.alias("location"), details.alias("details"))
    kind = {f.name: f.dataType for f in both.schema.fields}
    tuples = F.concat_ws("|", F.lit("zero_width"), F.lit("high"), canonical.stable(F.col("location"), kind["location"]), "payload", canonical.stable(F.col("details"), kind["details"]))
    return both.groupBy("doc_id").agg(canonical.in_order(F.collect_list(tuples)).alias("threats"))


def frame_release(spark, sf_dir):
    """A user's events as frames of one connection: purchases are scanned for as many seconds as their value, and hold back all that follows."""
    events = _t(spark, sf_dir, "events")
    scan = F.when(F.col("event_type") == "purchase", F.floor("value")).otherwise(0)
    frames = events.select(F.col("user_id").alias("conn"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("sent"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + scan * 1_000_000).alias("ready"), F.when((F.col("event_type") == "purchase") & (F.col("value") > 50), "infected").otherwise("clean").alias("verdict"))
    gone = order.release_times(frames, span=500)
    return gone.select(F.col("seq").alias("event_id"), (F.unix_micros("released") - F.unix_micros("sent")).alias("waited"), (F.col("verdict") != "infected").alias("delivered"))


def registered_sites(spark, sf_dir):
    """Hosts of pages are custom sites; permissions are granted for some, and for an offered one."""
    hosts = pages.normalize_host(spark, sf_dir).where("host is not null").groupBy("host").agg(F.min("page_id").alias("place"))
    allowed = hosts.where("place % 3 = 0").select(sites.origin(F.col("host")).alias("origin"))
    offered = spark.createDataFrame([(f"https://{sites.OFFERED[0]}/*",), (f"https://{sites.STATIC[0]}/*",)], "origin string")
    return sites.to_register(sites.known_sites(hosts), allowed.union(offered))


def site_list(spark, sf_dir):
    hosts = pages.normalize_host(spark, sf_dir).where("host is not null").groupBy("host").agg(F.min("page_id").alias("place"))
    return sites.known_sites(hosts).select("host", "rank", "place", sites.is_builtin(F.col("host")).alias("builtin"))


def beacon_replay(spark, sf_dir):
    """Documents as beacons: those of file size are looked at, and sent on unless they read as instructions."""
    from undertext.streaming.correlate import replayed

    docs = _t(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", _pick(POOL), F.substring("text", F.lit(1), (F.col("doc_id") * 37 % 1000).cast("int"))).alias("body"))
    seen = docs.select("doc_id", uploads.may_be_file(F.lit("blob"), F.encode("body", "UTF-8")).alias("scannable"), F.when(is_adversarial(F.col("body")), "infected").otherwise("clean").alias("verdict"))
    return replayed(seen).select("doc_id", "scannable")


QUERIES = {f.__name__: f for f in (package_slides, file_reports, file_reports_by_class, upload_files, labelled_entries, rounded_numbers, line_colours, canonical_threats, frame_release, registered_sites, site_list, beacon_replay)}

_K = "(SELECT doc_id, unnest(generate_series(1, doc_id % 5 + 1)) AS k FROM documents)"
_TARGET = f"replace(([{', '.join(map(q, TARGETS))}])[(doc_id + k) % 5 + 1], '#', CAST(k AS VARCHAR))"
_FOLD = "list_reduce(list_concat([{}], string_split({}, '/')), lambda a, x: CASE WHEN x IN ('', '.') THEN a WHEN x = '..' THEN regexp_replace(a, '/?[^/]+$', '') WHEN a = '' THEN x ELSE a || '/' || x END)"
_SLIDES = f"""(WITH k AS (SELECT * FROM {_K}), rel AS (SELECT doc_id, k, arg_max(target, o) AS target FROM (
      SELECT doc_id, k, k AS o, CASE WHEN (doc_id + k) % 5 = 3 THEN 'gone.xml' ELSE {_TARGET} END AS target FROM k WHERE (doc_id + k) % 5 <> 4 UNION ALL SELECT doc_id, k, k + 10, {_TARGET} FROM k WHERE (doc_id + k) % 5 = 3) GROUP BY 1, 2),
    part AS (SELECT doc_id, 'ppt/slides/slide' || k || '.xml' AS path FROM k WHERE (doc_id * 3 + k) % 7 <> 0 UNION ALL SELECT doc_id, 'ppt/notes/n' || k || '.xml' FROM k),
    found AS (SELECT doc_id, k, path FROM (SELECT doc_id, k, {_FOLD.format("'ppt'", "target")} AS path FROM rel) SEMI JOIN part USING (doc_id, path)),
    note AS (SELECT doc_id, path, {_FOLD.format("regexp_replace(path, '/[^/]*$', '')", "arg_min(target, o)")} AS notes FROM (SELECT doc_id, 'ppt/slides/slide' || k || '.xml' AS path, 2 AS o, '../notes/n' || k || '.xml' AS target FROM k WHERE (doc_id + k) % 3 = 1
      UNION ALL SELECT doc_id, 'ppt/slides/slide' || k || '.xml', 1, '../notes/none.xml' FROM k WHERE (doc_id + k) % 6 = 4) GROUP BY 1, 2)
  SELECT f.doc_id, CAST(row_number() OVER (PARTITION BY f.doc_id ORDER BY f.k) AS INT) AS slide_no, f.path AS path, p.path AS notes_path FROM found f LEFT JOIN note n ON n.doc_id = f.doc_id AND n.path = f.path LEFT JOIN part p ON p.doc_id = n.doc_id AND p.path = n.notes)"""
_OF = lambda kind, layer, sql, more="": f"SELECT doc_id, {layer} AS layer FROM ({sql}) WHERE {base._TYPE} IN ({kind}){more}"
_PDF = {"color_threshold": "pdf_color_threshold", "micro_font": "pdf_micro_font", "spatial": "pdf_spatial", "regex_keyword": "pdf_regex_keyword"}
_THREATS = " UNION ALL ".join([
    _OF("'txt', 'md'", "'zero_width'", f"SELECT * FROM {base._Z}"), *[_OF("'pdf'", q(layer), pages.SQL[name], " AND doc_id % 28 <> 0") for layer, name in _PDF.items()],
    _OF("'docx'", "layer", base._D), _OF("'pptx'", "'speaker_notes'", pages.SQL["pptx_speaker_notes"]),
])
_FAULT = f"""CASE WHEN size > 52428800 THEN 'OVERSIZED' WHEN kind IN ('txt', 'md') THEN NULL WHEN kind IN ('docx', 'pptx') AND doc_id % 11 = 0 THEN 'ENCRYPTED' WHEN doc_id % 13 = 0 THEN 'CORRUPT' WHEN doc_id % 17 = 0 THEN 'INTERNAL'
  WHEN doc_id % 19 = 0 THEN CASE WHEN kind = 'pdf' THEN 'CORRUPT' ELSE 'OVERSIZED inside' END WHEN doc_id % 23 = 0 THEN 'ENCRYPTED' WHEN kind = 'pptx' AND doc_id % 10 = 0 THEN 'CORRUPT' END"""
_REPORTS = f"""(WITH typed AS (SELECT *, {_FAULT} AS fault FROM (SELECT doc_id, {base._NAME} AS name, {base._TYPE} AS kind, strlen(text) * 10000 AS size FROM documents)),
    found AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT layer, ',' ORDER BY layer) AS fired FROM ({_THREATS}) GROUP BY 1),
    text AS (SELECT doc_id, sum(length(direct)) AS chars FROM {pages._joined(pages.SPANS, "true", pages.ON_PAGE)} WHERE doc_id % 28 <> 0 GROUP BY 1),
    sheet AS (SELECT doc_id, max(p) AS pages, bool_or((doc_id / 7 + p) % 4 < 2) AS images FROM (SELECT doc_id, unnest(generate_series(1, doc_id % 3 + 1)) AS p FROM documents) GROUP BY 1),
    deck AS (SELECT doc_id, count(*) AS slides FROM {_SLIDES} GROUP BY 1),
    told AS (SELECT *, CASE WHEN fault IS NOT NULL THEN 'error' WHEN n > 0 THEN 'infected' WHEN kind = 'pdf' AND coalesce(chars, 0) = 0 AND images THEN 'unscannable' ELSE 'clean' END AS verdict FROM typed LEFT JOIN found USING (doc_id) LEFT JOIN text USING (doc_id) LEFT JOIN sheet USING (doc_id) LEFT JOIN deck USING (doc_id))
  SELECT doc_id, name, kind AS file_type, size, CASE WHEN fault IS NULL AND kind = 'pdf' THEN pages WHEN fault IS NULL AND kind = 'pptx' THEN slides END AS pages, fault IS NULL AS ok, verdict, CASE WHEN fault IS NULL THEN coalesce(n, 0) ELSE 0 END AS n_threats,
    CASE WHEN fault IS NULL THEN coalesce(fired, '') ELSE '' END AS layers, string_split(fault, ' ')[1] AS code, CASE {' '.join(f"WHEN fault = {q(k)} THEN {q(v)}" for k, v in reports.MESSAGES.items())} END AS message, CASE WHEN verdict = 'unscannable' THEN {q(reports.IMAGE_ONLY)} END AS reason FROM told)"""
_LABEL = lambda key, names, otherwise: f"CASE {' '.join(f'WHEN {key} = {q(k)} THEN {q(v)}' for k, v in names.items())} ELSE {otherwise} END"
_SPREAD = lambda values, by: f"([{', '.join('NULL' if v is None else q(v) for v in values)}])[(doc_id // {by}) % {len(values)} + 1]"
_AT = lambda step: f"CASE WHEN (doc_id + {step}) % 4 <> 0 THEN doc_id % 50 + {step} END"
_UP = lambda x, digits: f"floor({x} * {10**digits} + 0.5) / {10**digits}"
_EVEN = lambda x, digits: f"CASE round_even({x}, {digits}) WHEN 0 THEN 0.0 ELSE round_even({x}, {digits}) END"  # noqa: E731  no negative zero
_INK = lambda k: f"CAST(floor(255 * (1 - least(1.0, (run_no + {k}) % 17 / 16 + para_no % 3 / 4)) + 0.5) AS INT)"
_RGB = lambda k: f"CASE (run_no + doc_id) % 4 WHEN 0 THEN CAST(255 - para_no % 5 * {k} AS INT) WHEN 1 THEN CAST(floor((run_no + doc_id) % 9 / 8 * 255 + 0.5) AS INT) WHEN 2 THEN {_INK(k)} ELSE 0 END"
_HOSTS = f"(SELECT host, min(page_id) AS place FROM {pages._H} WHERE host IS NOT NULL GROUP BY 1)"
_PART = f"""(SELECT doc_id, i, ['file', 'blob', 'string'][(doc_id + i) % 3 + 1] AS kind, ([{', '.join(map(q, MIMES))}])[(doc_id + 2 * i) % {len(MIMES)} + 1] AS type, ([{', '.join(map(q, CHANNELS))}])[doc_id % {len(CHANNELS)} + 1] AS channel, doc_id // 7 % 3 = 0 AS put,
    substr({base._HEAD} || regexp_replace(text, '[^ -~]', '', 'g'), 1, CAST(CASE i WHEN 0 THEN 0 WHEN 1 THEN 511 WHEN 2 THEN 512 ELSE 4000 END AS INT)) AS c FROM (SELECT doc_id, text, unnest(generate_series(0, doc_id % 4)) AS i FROM documents))"""
_SNIFF = "CASE WHEN starts_with(c, '%PDF') THEN 'pdf' WHEN NOT starts_with(c, 'PK' || chr(3) || chr(4)) THEN 'txt' WHEN contains(c, 'ppt/') THEN 'pptx' WHEN contains(c, 'word/') THEN 'docx' ELSE 'txt' END"
_BODY = f"(SELECT doc_id, ([{', '.join(map(q, POOL))}])[doc_id % {len(POOL)} + 1] || ' ' || substr(text, 1, CAST(doc_id * 37 % 1000 AS INT)) AS body FROM documents)"

SQL = {
    "package_slides": f"SELECT * FROM {_SLIDES}",
    "file_reports": f"SELECT * FROM {_REPORTS}",
    "file_reports_by_class": f"""WITH c AS (SELECT file_type, verdict, CAST(grouping_id(file_type, verdict) AS BIGINT) AS level, count(*) AS n FROM {_REPORTS} GROUP BY GROUPING SETS ((file_type, verdict), (file_type), (verdict), ())),
      w AS (SELECT t AS file_type, v AS verdict, CAST((t IS NULL)::INT * 2 + (v IS NULL)::INT AS BIGINT) AS level FROM (VALUES ('txt'), ('md'), ('pdf'), ('docx'), ('pptx'), (NULL)) a(t), (VALUES ('clean'), ('infected'), ('unscannable'), ('error'), (NULL)) b(v))
      SELECT coalesce(c.file_type, w.file_type) AS file_type, coalesce(c.verdict, w.verdict) AS verdict, coalesce(c.level, w.level) AS level, coalesce(n, 0) AS n, w.level IS NOT NULL AS expected FROM c FULL JOIN w ON c.level = w.level AND c.file_type IS NOT DISTINCT FROM w.file_type AND c.verdict IS NOT DISTINCT FROM w.verdict""",
    "upload_files": f"""SELECT doc_id AS request_id, CAST(i + 1 AS INT) AS seq, CASE way WHEN 1 THEN 'part' || i || '.pdf' WHEN 2 THEN 'upload.bin' ELSE 'upload.' || {_SNIFF} END AS name, CASE WHEN way = 3 AND type = '' THEN 'application/octet-stream' ELSE type END AS type, length(c) AS size FROM (
      SELECT *, CASE WHEN channel IN ('form', 'file') AND kind = 'file' AND c <> '' THEN 1 WHEN channel = 'blob' AND kind = 'blob' AND put AND c <> '' AND (type = '' OR regexp_matches(lower(type), 'pdf|officedocument|msword|ms-powerpoint|text/plain|text/markdown|octet-stream')) THEN 2
        WHEN channel IN ('socket', 'peer', 'beacon') AND kind <> 'string' AND length(c) >= 512 THEN 3 END AS way FROM {_PART}) WHERE way IS NOT NULL""",
    "labelled_entries": f"""SELECT doc_id, {_LABEL("layer", labels.LAYERS, "coalesce(layer, '')")} AS description, {_LABEL("coalesce(code, 'INTERNAL')", labels.ERRORS, q(labels.OTHER_ERROR))} AS title, {_LABEL("verdict", labels.VERDICTS, "verdict")} AS badge,
      coalesce(CASE kind WHEN 'pdf' THEN {q(labels.UNITS["pdf"][1])} || ' ' || {_AT(0)} WHEN 'docx' THEN {q(labels.UNITS["docx"][1])} || ' ' || {_AT(1)} WHEN 'pptx' THEN {q(labels.UNITS["pptx"][1])} || ' ' || {_AT(2)}
        WHEN 'zip' THEN '' ELSE coalesce({q(labels.LINE)} || ' ' || {_AT(3)} || ', ' || {q(labels.COLUMN)} || ' ' || {_AT(4)}, {q(labels.LINE)} || ' ' || {_AT(3)}) END, '') AS place,
      regexp_extract(path, '[^/\\\\]*$') AS name, strftime(make_timestamp(doc_id * 86399999000), '%d.%m %H:%M') AS shown_at, verdict = 'infected' AND doc_id % 3 = 0 AS expandable, verdict = 'error' AND coalesce(code, 'INTERNAL') IN ('CORRUPT', 'ENCRYPTED', 'OVERSIZED') AS noted
      FROM (SELECT doc_id, {_SPREAD(LAYER_NAMES, 1)} AS layer, {_SPREAD(CODES, 2)} AS code, {_SPREAD(tuple(labels.VERDICTS), 3)} AS verdict, {_SPREAD(KINDS, 1)} AS kind, {_SPREAD(PATHS, 1)} AS path FROM documents)""",
    "rounded_numbers": f"SELECT l_orderkey, l_linenumber, {_UP('x', 2)} AS up2, {_EVEN('x', 2)} AS even2, {_UP('x', 0)} AS up0, {_EVEN('x', 0)} AS even0, {_EVEN('x', 3)} AS even3 FROM (SELECT l_orderkey, l_linenumber, CAST((l_orderkey % 4001 - 2000) / 16 AS DOUBLE) AS x FROM lineitem)",
    "line_colours": f"""SELECT doc_id, para_no, arg_min(r, run_no) AS r, arg_min(g, run_no) AS g, arg_min(b, run_no) AS b, {_UP("min(sqrt((255.0 - r) * (255 - r) + (255 - g) * (255 - g) + (255 - b) * (255 - b)))", 2)} AS euclidean
      FROM (SELECT doc_id, para_no, run_no, {_RGB(0)} AS r, {_RGB(1)} AS g, {_RGB(2)} AS b FROM {RUNS}) GROUP BY 1, 2""",
    "canonical_threats": f"""SELECT doc_id, string_agg(t, chr(10) ORDER BY t) AS threats FROM (SELECT doc_id, 'zero_width|high|{{"codepoint":"' || codepoint || '","col":"' || col || '","line":"' || line_no || '"}}|' || CASE WHEN seen = '' THEN '' ELSE seen || ' ' END || '[' || codepoint || ']|'
      || CASE WHEN doc_id % 3 = 0 THEN '{{"at":[{{"a":' || CASE WHEN col > 9 THEN CAST(col AS VARCHAR) ELSE 'null' END || ',"b":' || line_no || '}}],"codepoint":"' || codepoint || '"}}' ELSE 'null' END AS t FROM {base._Z}) GROUP BY 1""",
    "frame_release": "SELECT event_id, epoch_us(max(CASE WHEN event_type = 'purchase' THEN ts + to_seconds(CAST(floor(value) AS BIGINT)) ELSE ts END) OVER (PARTITION BY user_id ORDER BY event_id)) - epoch_us(ts) AS waited, NOT (event_type = 'purchase' AND value > 50) AS delivered FROM events",
    "registered_sites": f"SELECT host, 'https://' || host || '/*' AS origin, regexp_replace(host, '[^a-zA-Z0-9.]', '_', 'g') AS script FROM {_HOSTS} WHERE place % 3 = 0 UNION SELECT {q(sites.OFFERED[0])}, {q(f'https://{sites.OFFERED[0]}/*')}, {q(sites.OFFERED[0])}",
    "site_list": f"SELECT host, CAST(2 AS INT) AS rank, place, host IN ({', '.join(map(q, sites.STATIC))}) AS builtin FROM {_HOSTS} UNION ALL SELECT * FROM (VALUES {', '.join(f'({q(h)}, {r}, CAST({i} AS BIGINT), {r == 0})' for r, hosts in enumerate((sites.STATIC, sites.OFFERED)) for i, h in enumerate(hosts))})",
    "beacon_replay": f"SELECT doc_id, strlen(body) >= 512 AS scannable FROM {_BODY} WHERE strlen(body) < 512 OR NOT {adv('body')}",
}
