"""Layers over formatted runs and shapes: an anomaly counts only with adversarial wording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertext.functions.lexicon import dialect
from undertext.functions.text import is_adversarial, trimmed
from undertext.operators.covers import buried, buried_by_few, by_number, cover_cells, met, on_pages_of


def from_white(r, g, b):
    return F.sqrt((255 - r) * (255 - r) + (255 - g) * (255 - g) + (255 - b) * (255 - b))


def docx_threats(runs: DataFrame) -> DataFrame:
    """(doc_id, para_no, run_no, layer, severity) from runs with text, hidden, size_pt, color_val; one pass for all layers.

    Plain conditions pick the odd runs, wording is looked at for those alone, and layers are listed for what remains.
    """
    part = lambda i: F.conv(F.substring("color_val", i, 2), 16, 10).cast("double")
    far = F.when(F.col("color_val").rlike("^[0-9a-fA-F]{6}$"), from_white(part(1), part(3), part(5)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    hidden, white, tiny = yes(F.col("hidden")), yes(far < 25), yes(F.col("size_pt") < 2.0)
    found = runs.where(hidden | tiny | white).where(is_adversarial(F.col("text")))
    hit = lambda name, when, severity: F.when(when, F.struct(F.lit(name).alias("layer"), severity.alias("severity")))
    high = F.lit("high")
    layers = F.array_compact(F.array(hit("hidden_attr", hidden, high), hit("white_on_white", white, F.when(far < 10, "high").otherwise("medium")), hit("tiny_font", tiny, high)))
    return found.select("doc_id", "para_no", "run_no", F.explode(layers).alias("t")).select("doc_id", "para_no", "run_no", "t.layer", "t.severity")


def off_slide(shapes: DataFrame) -> DataFrame:
    """Shapes with adversarial text and a corner left of or above the slide."""
    away = F.col("left_emu").isNotNull() & F.col("top_emu").isNotNull() & ((F.col("left_emu") < 0) | (F.col("top_emu") < 0))
    return shapes.where(away).where(is_adversarial(F.col("text")))


LINE = ("doc_id", "page_no", "line_key")
# Fills conceal from this opacity on, and up to this share of the page.
OPAQUE, PAGE_FILL = 0.85, 0.85


def keyed_lines(spans: DataFrame) -> DataFrame:
    return spans.withColumn("line_key", F.floor(F.floor(F.col("y0") + F.col("size") * 0.2 + 0.5) + 0.5).cast("long"))


def touches(width: float, height: float):
    """Whether a group of spans touches the page with the box around all of them."""
    return (F.min("x0") < width) & (F.max("x1") > 0) & (F.min("y0") < height) & (F.max("y1") > 0)


def page_lines(spans: DataFrame, keep, page: tuple[float, float] | None = None, **least: str) -> DataFrame:
    """(doc_id, page_no, line_key, direct, spaced, x0, y0, x1, y1, last_op, least ones) of each line's kept spans.

    direct: their text as it stands; spaced: their trimmed texts with spaces between. page: its width and height; lines
    that lie off it, with all their spans, don't count. least: names for the smallest values of columns.
    """
    some = keyed_lines(spans) if page else keyed_lines(spans).where(keep)
    kept = lambda c: F.when(keep, c)
    by_line = some.groupBy(*LINE).agg(
        F.array_sort(F.collect_list(kept(F.struct("op_index", "text")))).alias("s"),
        *[f(kept(F.col(c))).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))],
        F.max(kept(F.col("op_index"))).alias("last_op"),
        *[F.min(kept(F.col(c))).alias(name) for name, c in least.items()],
        (touches(*page) if page else F.lit(True)).alias("on_page"),
    )
    direct = trimmed(F.array_join(F.transform("s", lambda x: x.getField("text")), ""))
    spaced = F.array_join(F.filter(F.transform("s", lambda x: trimmed(x.getField("text"))), lambda t: t != ""), " ")
    return by_line.where((F.size("s") > 0) & F.col("on_page")).withColumn("direct", direct).withColumn("spaced", spaced).drop("s", "on_page")


def worded(lines: DataFrame) -> DataFrame:
    """Lines that read as instructions, with that phrase: as it stands, or failing that with spaces between the spans."""
    phrase = F.when(is_adversarial(F.col("direct")), F.col("direct")).when(is_adversarial(F.col("spaced")), F.col("spaced"))
    return lines.withColumn("phrase", phrase).where("phrase is not null").drop("direct", "spaced")


def span_lines(spans: DataFrame, keep, page: tuple[float, float] | None = None, **least: str) -> DataFrame:
    return worded(page_lines(spans, keep, page, **least))


def keyword_lines(spans: DataFrame, page: tuple[float, float], phrases) -> DataFrame:
    """(doc_id, page_no, line_key, extracted, pattern, match): the first of the phrases in a visible line's text as it stands."""
    lines = page_lines(spans, F.lit(True), page).where("direct <> ''")
    one = lambda p: F.when(F.col("direct").rlike(dialect(p, True)), F.struct(F.lit(p).alias("pattern"), F.regexp_extract("direct", dialect(p, True), 0).alias("match")))
    return lines.withColumn("m", F.coalesce(*map(one, phrases))).where("m is not null").select(*LINE, F.col("direct").alias("extracted"), "m.pattern", "m.match")


def off_page(width: float, height: float):
    """Spans that do not touch the page."""
    return (F.col("x1") <= 0) | (F.col("y1") <= 0) | (F.col("x0") >= width) | (F.col("y0") >= height)


def concealing(covers: DataFrame, page: tuple[float, float]) -> DataFrame:
    """Of covers (doc_id, page_no, kind, alpha, op_index, box), images and those fills that conceal, by cell of the page."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    fill = (F.col("alpha") >= OPAQUE) & (area > 0) & (area / (page[0] * page[1]) < PAGE_FILL)
    return cover_cells(covers.where((F.col("kind") == "image") | fill))


def buried_lines(spans: DataFrame, covers: DataFrame, probed: DataFrame, page: tuple[float, float]) -> DataFrame:
    """(doc_id, page_no, line_key, phrase, cover, cover_op) of visible lines whose buried spans read as instructions.

    A span is buried by an object painted after it. The line's cover is the first image, or else the first fill, that
    is painted after all its buried spans; a fill counts only on pages where probed (doc_id, page_no) says that nothing shows.
    """
    c = concealing(covers, page)
    few, many = by_number(c)
    phrases = span_lines(buried_by_few(spans, few), F.lit(True)).union(span_lines(buried(on_pages_of(spans, many), many), F.lit(True)))
    # A line is visible where its buried spans touch the page; they can only miss it below covers that reach beyond it.
    touched = (F.col("x0") < page[0]) & (F.col("x1") > 0) & (F.col("y0") < page[1]) & (F.col("y1") > 0)
    beyond = (F.col("cx0") < 0) | (F.col("cy0") < 0) | (F.col("cx1") > page[0]) | (F.col("cy1") > page[1])
    shown = keyed_lines(on_pages_of(spans, c.where(beyond))).groupBy(*LINE).agg(touches(*page).alias("on_page")).where("on_page")
    visible = phrases.join(shown, list(LINE), "left").where(touched | F.col("on_page")).drop("on_page")
    first = F.min(F.struct(F.when(F.col("kind") == "image", 0).otherwise(1).alias("rank"), "op", "kind")).alias("first")
    covered = met(visible, c, "last_op").groupBy(*LINE, "phrase").agg(first)
    image, bare = F.col("first.kind") == "image", probed.select("doc_id", "page_no", F.lit(True).alias("bare")).distinct()
    counted = covered.join(bare, ["doc_id", "page_no"], "left").where(image | F.col("bare"))
    return counted.select(*LINE, "phrase", F.when(image, "image").otherwise("shape").alias("cover"), F.col("first.op").alias("cover_op"))


def note_threats(notes: DataFrame, phrases, collapsed) -> DataFrame:
    """(doc_id, slide_no, scan, pattern, match, extracted), one a slide at most: a phrase as written, a phrase in letters alone, or instruction wording."""
    kept = notes.where(trimmed(F.col("notes")) != "").withColumn("letters", F.regexp_replace("notes", "[^a-zA-Z]", ""))

    def first(column, scan, pattern, regex):
        found = F.struct(F.lit(scan).alias("scan"), F.lit(pattern).alias("pattern"), F.regexp_extract(column, regex, 0).alias("match"))
        return F.when(F.col(column).rlike(regex), found)

    raw = [first("notes", "raw", p, dialect(p, True)) for p in phrases]
    flat = [first("letters", "collapsed", p, f"(?i){p}") for p in collapsed]
    none = F.lit(None).cast("string")
    word = F.when(is_adversarial(F.col("notes")), F.struct(F.lit("adversarial_keywords").alias("scan"), none.alias("pattern"), none.alias("match")))
    return kept.withColumn("t", F.coalesce(*raw, *flat, word)).where("t is not null").select("doc_id", "slide_no", "t.*", trimmed(F.col("notes")).alias("extracted"))
