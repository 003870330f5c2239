"""Slides of presentation packages, from rows of their relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The part that lists slides, its folder, and the kind of relationship that leads to a slide's notes.
LISTING, LISTING_FOLDER = "ppt/presentation.xml", "ppt"
NOTES = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/notesSlide"

# The most declared bytes of one part and of all that are read of a package.
MOST_PART, MOST_PACKAGE = 100 << 20, 200 << 20


def resolved(folder: Column, target: Column) -> Column:
    """The path of a relationship's target, from the folder of its source; steps up beyond the root stay there."""
    start = F.filter(F.split(folder, "/"), lambda x: x != "")
    up = lambda path: F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))
    step = lambda path, x: F.when((x == "") | (x == "."), path).when(x == "..", up(path)).otherwise(F.concat(path, F.array(x)))
    return F.array_join(F.aggregate(F.split(target, "/"), start, step), "/")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def relationships(rels: DataFrame) -> DataFrame:
    """(file_id, source, rel_id, place, type, target) from rows (file_id, source, ord, rel_id, type, target): of several with one rel_id the last counts, at the first one's place. Rows with nulls are no relationships."""
    whole = rels.dropna(subset=["file_id", "source", "ord", "rel_id", "type", "target"])
    return whole.groupBy("file_id", "source", "rel_id").agg(F.min("ord").alias("place"), F.max_by(F.struct("type", "target"), "ord").alias("r")).select("file_id", "source", "rel_id", "place", "r.*")


def slides(listed: DataFrame, rels: DataFrame, parts: DataFrame) -> DataFrame:
    """(file_id, slide_no, path, notes_path) of the slides that packages list (file_id, ord, rel_id).

    A slide whose relationship or part (file_id, path) is missing is left out, and numbers close up. Notes are those of
    the slide's first notes relationship; null where it has none or their part is missing, also if a later one has its part.
    """
    known = relationships(rels)
    there = parts.select(F.col("file_id").alias("f"), F.col("path").alias("p")).distinct()
    of = lambda path: [F.col("file_id") == F.col("f"), F.col(path) == F.col("p")]
    ways = known.where(F.col("source") == LISTING).select("file_id", "rel_id", resolved(F.lit(LISTING_FOLDER), F.col("target")).alias("path"))
    found = listed.select("file_id", "ord", "rel_id").join(ways, ["file_id", "rel_id"]).join(there, of("path"), "left_semi")
    numbered = found.withColumn("slide_no", F.row_number().over(Window.partitionBy("file_id").orderBy("ord")))
    notes = known.where(F.col("type") == NOTES).groupBy("file_id", F.col("source").alias("path")).agg(F.min_by("target", F.struct("place", "rel_id")).alias("target"))
    noted = notes.withColumn("notes", resolved(folder_of(F.col("path")), F.col("target"))).join(there, of("notes"), "left_semi").select("file_id", "path", F.col("notes").alias("notes_path"))
    return numbered.join(noted, ["file_id", "path"], "left").select("file_id", "slide_no", "path", "notes_path")


def read_parts(parts: DataFrame) -> DataFrame:
    """(file_id, read_ord, path, total, stopped) of the parts of packages (file_id, read_ord, path, size) that are read, in order of read_ord.

    total: bytes declared so far. Reading stops at the first part that is too large, or with which all are; it has
    stopped true, and what would come later is left out. A null size counts as nothing. A package has some thousand
    parts at most, so its order is one group.
    """
    own = Window.partitionBy("file_id").orderBy("read_ord", "path")
    so_far = parts.withColumn("total", F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    over = F.coalesce(F.col("size") > MOST_PART, F.lit(False)) | (F.coalesce("size", F.lit(0)) > 0) & (F.col("total") > MOST_PACKAGE)
    marked = so_far.withColumn("stopped", over).withColumn("_before", F.max("stopped").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    return marked.where("not coalesce(_before, false)").select("file_id", "read_ord", "path", "total", "stopped")
