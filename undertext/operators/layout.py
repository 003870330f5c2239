"""Lines, paths and placeholders where they stand on pages and slides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertext.functions.text import trimmed
from undertext.operators.run_layers import LINE, keyed_lines

# Paint operators that fill, and the placeholder that holds notes.
FILLS = ("fill", "eoFill", "fillStroke", "eoFillStroke", "closeFillStroke", "closeEOFillStroke")
NOTES_BODY = "body"


def placed_lines(spans: DataFrame, sheets: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_key, first_op, direct, box, n_off, on_page) of each line of spans, on its page in sheets (doc_id, page_no, width, height).

    on_page: whether the box around all the line's spans meets the page; n_off: its spans that don't meet it by
    themselves. Touching is not meeting. Pages number from 1; spans of pages that sheets lacks are left out.
    """
    on = keyed_lines(spans).join(sheets, ["doc_id", "page_no"])
    off = (F.col("x1") <= 0) | (F.col("y1") <= 0) | (F.col("x0") >= F.col("width")) | (F.col("y0") >= F.col("height"))
    lines = on.groupBy(*LINE).agg(
        F.min("op_index").alias("first_op"), F.array_sort(F.collect_list(F.struct("op_index", "text"))).alias("s"), *[F.min(c).alias(c) for c in ("x0", "y0", "width", "height")], *[F.max(c).alias(c) for c in ("x1", "y1")], F.count_if(off).alias("n_off")
    )
    meets = (F.col("x0") < F.col("width")) & (F.col("x1") > 0) & (F.col("y0") < F.col("height")) & (F.col("y1") > 0)
    return lines.select(*LINE, "first_op", trimmed(F.array_join(F.transform("s", lambda x: x["text"]), "")).alias("direct"), "x0", "y0", "x1", "y1", "n_off", meets.alias("on_page"))


def painted(paths: DataFrame) -> DataFrame:
    """Of paths (paint, box and others), those that are filled and have a box."""
    return paths.where(F.col("paint").isin(*FILLS) & F.col("x0").isNotNull())


def notes_bodies(shapes: DataFrame) -> DataFrame:
    """(file_id, slide_no, notes) from the shapes of notes pages (file_id, slide_no, ord, placeholder, text): the text of the first body placeholder, empty if it has none; pages without one are left out."""
    body = shapes.where(F.col("placeholder") == NOTES_BODY)
    return body.groupBy("file_id", "slide_no").agg(F.min_by(F.coalesce("text", F.lit("")), "ord").alias("notes"))


def with_extra(phrases: tuple[str, ...], extra: tuple[str, ...]) -> tuple[str, ...]:
    """phrases and, behind them, those extra ones that are not blank."""
    return (*phrases, *(x for x in extra if x.strip()))
