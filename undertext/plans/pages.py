"""Queries over page spans, slides and sites, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from undertext.functions.lexicon import COLLAPSED, PHRASES, dialect
from undertext.operators import run_layers, sites
from undertext.plans.queries import POOL, RUNS, _t, adv, q, runs

WIDTH, HEIGHT = 595.0, 842.0


def spans(docs):
    r = runs(docs)
    grey = F.when(F.col("color_val") == "FFFFFF", 255).when(F.col("color_val") == "F3F3F3", 243).otherwise(0)
    x, y = (F.col("run_no") % 12 * 60 - 30).cast("double"), (820 - F.col("para_no") * 14).cast("double")
    return r.select("doc_id", F.lit(1).alias("page_no"), (F.col("para_no").cast("long") * 100000 + F.col("run_no")).alias("op_index"), "text", grey.alias("grey"), F.col("size_pt").alias("size"), x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + F.col("size_pt")).alias("y1"))


SPANS = f"""(SELECT doc_id, op_index, text, grey, size, x0, y0, x0 + 40 AS x1, y0 + size AS y1, CAST(floor(floor(y0 + size * CAST(0.2 AS DOUBLE) + 0.5) + 0.5) AS BIGINT) AS line_key FROM (
  SELECT doc_id, para_no * 100000 + run_no AS op_index, text, CASE m WHEN 5 THEN 255 WHEN 6 THEN 243 ELSE 0 END AS grey, CAST(CASE m WHEN 3 THEN 1.5 WHEN 4 THEN 2.0 ELSE 11.0 END AS DOUBLE) AS size,
    CAST(run_no % 12 * 60 - 30 AS DOUBLE) AS x0, CAST(820 - para_no * 14 AS DOUBLE) AS y0 FROM {RUNS}))"""


PAGE = (WIDTH, HEIGHT)
ON_PAGE = "min(x0) < 595 AND max(x1) > 0 AND min(y0) < 842 AND max(y1) > 0"


def _joined(source: str, keep: str, having: str, extra: str = "") -> str:
    """Lines of kept spans with their texts, as they stand and with spaces."""
    f = f"FILTER ({keep})"
    return f"""(SELECT doc_id, line_key, trim(string_agg(text, '' ORDER BY op_index) {f}) AS direct, coalesce(string_agg(trim(text), ' ' ORDER BY op_index) FILTER (({keep}) AND trim(text) <> ''), '') AS spaced,
        min(x0) {f} AS x0, max(x1) {f} AS x1, min(y0) {f} AS y0, max(y1) {f} AS y1, max(op_index) {f} AS last_op{', ' + extra.format(f=f) if extra else ''} FROM {source} s GROUP BY 1, 2 HAVING count(*) {f} > 0 AND {having})"""


def _worded(lines: str) -> str:
    return f"(SELECT * FROM (SELECT *, CASE WHEN {adv('direct')} THEN direct WHEN {adv('spaced')} THEN spaced END AS phrase FROM {lines}) WHERE phrase IS NOT NULL)"


def pdf_color_threshold(spark, sf_dir):
    s = spans(_t(spark, sf_dir, "documents")).withColumn("far", run_layers.from_white(F.col("grey"), F.col("grey"), F.col("grey")))
    found = run_layers.span_lines(s, F.col("far") < 25, PAGE, least="far")
    return found.select("doc_id", "line_key", "phrase", F.when(F.col("least") < 10, "high").otherwise("medium").alias("severity"))


def pdf_micro_font(spark, sf_dir):
    found = run_layers.span_lines(spans(_t(spark, sf_dir, "documents")), F.col("size") < 2.0, PAGE, min_size="size")
    return found.select("doc_id", "line_key", "phrase", F.round("min_size", 3).alias("min_size"))


def pdf_spatial(spark, sf_dir):
    return run_layers.span_lines(spans(_t(spark, sf_dir, "documents")), run_layers.off_page(*PAGE)).select("doc_id", "line_key", "phrase", "x0", "x1")


def pdf_regex_keyword(spark, sf_dir):
    return run_layers.keyword_lines(spans(_t(spark, sf_dir, "documents")), PAGE, PHRASES).drop("page_no")


#: Planted objects: which documents have them, kind, opacity, place among the page's objects, box.
COVERS = (
    ("doc_id % 3 = 0", "image", 1.0, 10_000_000_000, (0.0, 700.0, 300.0, 842.0)),
    ("doc_id % 3 <> 2", "fill", 0.9, 5_000_000, (0.0, 500.0, 200.0, 842.0)),
    ("doc_id % 3 <> 2", "fill", 1.0, 20_000_000_000, (0.0, 0.0, 595.0, 842.0)),
    ("doc_id % 2 = 0", "fill", 0.5, 30_000_000_000, (0.0, 0.0, 400.0, 600.0)),
)


def pdf_z_index(spark, sf_dir):
    # Texts are dealt by document before they become spans, which then stay where they are.
    docs = _t(spark, sf_dir, "documents").repartition("doc_id")
    one = lambda kind, alpha, op, box: F.struct(F.lit(kind).alias("kind"), F.lit(alpha).alias("alpha"), F.lit(op).cast("long").alias("op_index"), *[F.lit(v).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), box)])
    planted = F.array_compact(F.array(*[F.when(F.expr(when), one(*rest)) for when, *rest in COVERS]))
    covers = docs.select("doc_id", F.lit(1).alias("page_no"), F.explode(planted).alias("c")).select("doc_id", "page_no", "c.*")
    probed = docs.where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("page_no"))
    return run_layers.buried_lines(spans(docs), covers, probed, PAGE).drop("page_no")


def pptx_off_slide(spark, sf_dir):
    at = (F.col("doc_id") + F.col("run_no")) % 5
    shapes = runs(_t(spark, sf_dir, "documents")).withColumn("left_emu", F.when(at == 0, -1.0).when(at == 1, 0.0).when(at == 2, 500000.0)).withColumn("top_emu", F.when(at == 2, -6000000.0).otherwise(0.0))
    return run_layers.off_slide(shapes).select("doc_id", "para_no", "run_no")


def note_pool():
    return F.element_at(F.array(*map(F.lit, (*POOL, "d-a-n m.o.d.e"))), (F.col("doc_id") % (len(POOL) + 1) + 1).cast("int"))


def pptx_speaker_notes(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return run_layers.note_threats(docs.select("doc_id", F.lit(1).alias("slide_no"), note_pool().alias("notes")), PHRASES, COLLAPSED)


def normalize_host(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", sites.normal_host(F.col("url")).alias("host"))


def site_enabled_default(spark, sf_dir):
    hosts = normalize_host(spark, sf_dir).where("host is not null").select("host").distinct()
    enabled = hosts.where(F.length("host") % 3 == 0).select("host", (F.length("host") % 2 == 0).alias("on"))
    return sites.active(hosts, enabled)


def site_anti_join(spark, sf_dir):
    hosts = normalize_host(spark, sf_dir)
    return sites.unlisted(hosts, hosts.where(F.col("host").startswith("m.")), hosts.where(F.col("host").startswith("blog.")))


_H = r"""(SELECT page_id, CASE WHEN regexp_matches(h, '^([a-z0-9]([a-z0-9\-]{0,61}[a-z0-9])?\.)+[a-z]{2,}$') AND length(h) <= 253 THEN h END AS host FROM
  (SELECT page_id, regexp_replace(regexp_extract(lower(url), '://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', '') AS h FROM pages))"""
_FAR = "sqrt(3.0 * (255 - grey) * (255 - grey))"
_N = f"(SELECT doc_id, ([{', '.join(map(q, (*POOL, 'd-a-n m.o.d.e')))}])[doc_id % {len(POOL) + 1} + 1] AS notes FROM documents)"
_FLAT = "regexp_replace(notes, '[^a-zA-Z]', '', 'g')"

_HALF = "least(s.x1, c.cx1) > greatest(s.x0, c.cx0) AND least(s.y1, c.cy1) > greatest(s.y0, c.cy0) AND (least(s.x1, c.cx1) - greatest(s.x0, c.cx0)) * (least(s.y1, c.cy1) - greatest(s.y0, c.cy0)) >= 0.5 * (s.x1 - s.x0) * (s.y1 - s.y0)"
_COV = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {op} AS op, {op + (kind != 'image') * 10**12} AS rank, " + ", ".join(f"CAST({v} AS DOUBLE) AS c{k}" for k, v in zip(("x0", "y0", "x1", "y1"), box)) + f" FROM documents WHERE {when}"
    for when, kind, alpha, op, box in COVERS
    if kind == "image" or alpha >= 0.85 and 0 < (box[2] - box[0]) * (box[3] - box[1]) < 0.85 * WIDTH * HEIGHT
)

QUERIES = {f.__name__: f for f in (pdf_color_threshold, pdf_micro_font, pdf_spatial, pdf_regex_keyword, pdf_z_index, pptx_off_slide, pptx_speaker_notes, normalize_host, site_enabled_default, site_anti_join)}
SQL = {
    "pdf_color_threshold": f"SELECT doc_id, line_key, phrase, CASE WHEN least < 10 THEN 'high' ELSE 'medium' END AS severity FROM {_worded(_joined(SPANS, _FAR + ' < 25', ON_PAGE, f'min({_FAR}) {{f}} AS least'))}",
    "pdf_micro_font": f"SELECT doc_id, line_key, phrase, min_size FROM {_worded(_joined(SPANS, 'size < 2.0', ON_PAGE, 'min(size) {f} AS min_size'))}",
    "pdf_spatial": f"SELECT doc_id, line_key, phrase, x0, x1 FROM {_worded(_joined(SPANS, 'x1 <= 0 OR y1 <= 0 OR x0 >= 595 OR y0 >= 842', 'true'))}",
    "pdf_regex_keyword": "SELECT doc_id, line_key, direct AS extracted, m.pattern AS pattern, m.match AS match FROM (SELECT doc_id, line_key, direct, CASE "
    + " ".join(f"WHEN regexp_matches(direct, {q(dialect(p, False))}) THEN {{'pattern': {q(p)}, 'match': regexp_extract(direct, {q(dialect(p, False))}, 0)}}" for p in PHRASES)
    + f" END AS m FROM {_joined(SPANS, 'true', ON_PAGE)} WHERE direct <> '') WHERE m IS NOT NULL",
    "pdf_z_index": f"""WITH sp AS (SELECT * FROM {SPANS}), cov AS ({_COV}), kept AS (SELECT * FROM sp s WHERE EXISTS (SELECT 1 FROM cov c WHERE c.doc_id = s.doc_id AND op > op_index AND {_HALF})),
      visible AS (SELECT doc_id, line_key FROM sp GROUP BY 1, 2 HAVING {ON_PAGE}), named AS (SELECT * FROM {_worded(_joined('kept', 'true', 'true'))} SEMI JOIN visible USING (doc_id, line_key)),
      met AS (SELECT s.doc_id, line_key, phrase, arg_min(kind, rank) AS kind, min(rank) % 1000000000000 AS cover_op FROM named s JOIN cov c ON c.doc_id = s.doc_id AND op > last_op AND {_HALF} GROUP BY 1, 2, 3)
      SELECT doc_id, line_key, phrase, CASE kind WHEN 'image' THEN 'image' ELSE 'shape' END AS cover, cover_op FROM met WHERE kind = 'image' OR doc_id % 2 = 0""",
    "pptx_off_slide": f"SELECT doc_id, para_no, run_no FROM {RUNS} WHERE (doc_id + run_no) % 5 IN (0, 2) AND {adv('text')}",
    "pptx_speaker_notes": f"SELECT doc_id, 1 AS slide_no, t.scan AS scan, t.pattern AS pattern, t.match AS match, trim(notes) AS extracted FROM (SELECT doc_id, notes, CASE "
    + " ".join(f"WHEN regexp_matches(notes, {q(dialect(p, False))}) THEN {{'scan': 'raw', 'pattern': {q(p)}, 'match': regexp_extract(notes, {q(dialect(p, False))}, 0)}}" for p in PHRASES)
    + " " + " ".join(f"WHEN regexp_matches({_FLAT}, {q('(?i)' + p)}) THEN {{'scan': 'collapsed', 'pattern': {q(p)}, 'match': regexp_extract({_FLAT}, {q('(?i)' + p)}, 0)}}" for p in COLLAPSED)
    + f" WHEN {adv('notes')} THEN {{'scan': 'adversarial_keywords', 'pattern': NULL, 'match': NULL}} END AS t FROM {_N}) WHERE t IS NOT NULL",
    "normalize_host": f"SELECT page_id, host FROM {_H}",
    "site_enabled_default": f"SELECT host, CASE WHEN length(host) % 3 = 0 THEN length(host) % 2 = 0 ELSE true END AS active FROM (SELECT DISTINCT host FROM {_H} WHERE host IS NOT NULL)",
    "site_anti_join": f"SELECT DISTINCT host FROM {_H} WHERE host IS NOT NULL AND NOT starts_with(host, 'm.') AND NOT starts_with(host, 'blog.')",
}
