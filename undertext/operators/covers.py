"""What is painted over what: boxes met by place and order, without comparing all boxes of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a cover hides a region from this share on. From one half on, it lies over the region's centre.
COVERED = 0.5
#: The finest level's cells have sides of 2 ** FINEST units of the page.
FINEST = 4
BOX = ("x0", "y0", "x1", "y1")
#: Wider than what coordinates lose by rounding.
EDGE = 1e-6
#: Fixed value: on pages whose covers touch no more cells than this, spans are compared with all of them.
FEW = 256


def _cell(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), level)).cast("long")


def cover_cells(covers: DataFrame) -> DataFrame:
    """covers (doc_id, page_no, op_index, kind, box) under names of their own, once for each cell (level, gx, gy) that they touch.

    A cover's level is that whose cells are at least as large as itself, so it touches four of them at most.
    """
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 2 * EDGE
    leveled = covers.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).withColumn("level", F.greatest(F.ceil(F.log2(side)), F.lit(FINEST)).cast("int"))
    reach = lambda a, b: F.explode(F.sequence(_cell(F.col(a) - EDGE, F.col("level")), _cell(F.col(b) + EDGE, F.col("level"))))
    across = leveled.withColumn("gx", reach("x0", "x1")).withColumn("gy", reach("y0", "y1"))
    return across.select(F.col("doc_id").alias("d"), F.col("page_no").alias("p"), "level", "gx", "gy", F.col("op_index").alias("op"), "kind", *[F.col(k).alias(f"c{k}") for k in BOX])


def _half() -> Column:
    """Whether a cover hides a box."""
    wide = F.least("x1", "cx1") - F.greatest("x0", "cx0")
    tall = F.least("y1", "cy1") - F.greatest("y0", "cy0")
    return (wide > 0) & (tall > 0) & (wide * tall >= COVERED * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))


def by_number(covers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """covers (of cover_cells) of pages with few of them, and of pages with many."""
    counted = covers.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("d", "p")))
    return counted.where(F.col("_n") <= FEW).drop("_n"), counted.where(F.col("_n") > FEW).drop("_n")


def on_pages_of(boxes: DataFrame, covers: DataFrame) -> DataFrame:
    """boxes of pages that have any of covers (of cover_cells). Those pages are dealt anew, so that Spark sees when there are none and leaves the boxes out."""
    pages = covers.select(F.col("d").alias("doc_id"), F.col("p").alias("page_no")).distinct().repartition("doc_id", "page_no").hint("shuffle_hash")
    return boxes.join(pages, ["doc_id", "page_no"], "left_semi")


def met(boxes: DataFrame, covers: DataFrame, after: str) -> DataFrame:
    """boxes (doc_id, page_no, box, the column `after` and others), joined with each of covers (of cover_cells) that hides them and is painted after `after`.

    Both meet in the cell of the box's centre, once for each level that the page's covers have. Boxes which nothing in
    their cell is painted after are dropped before.
    """
    page = ["d", "p"]
    levels = covers.groupBy(*page).agg(F.collect_set("level").alias("levels"), F.max("op").alias("latest"))
    on_page = (F.col("doc_id") == F.col("d")) & (F.col("page_no") == F.col("p"))
    placed = boxes.join(levels, on_page & (F.col(after) < F.col("latest"))).drop(*page).withColumn("_level", F.explode("levels"))
    centre = lambda a, b: _cell((F.col(a) + F.col(b)) / 2, F.col("_level"))
    placed = placed.withColumn("_gx", centre("x0", "x1")).withColumn("_gy", centre("y0", "y1"))
    same = on_page & (F.col("_level") == F.col("level")) & (F.col("_gx") == F.col("gx")) & (F.col("_gy") == F.col("gy"))
    last = covers.groupBy(*page, "level", "gx", "gy").agg(F.max("op").alias("last"))
    near = placed.join(last, same & (F.col(after) < F.col("last"))).drop(*last.columns)
    return near.join(covers, same & (F.col("op") > F.col(after)) & _half()).drop("levels", "latest", "_level", "_gx", "_gy", "level", "gx", "gy", *page)


def buried_by_few(spans: DataFrame, covers: DataFrame) -> DataFrame:
    """As buried, where pages have few covers: these are a hash table by page, so that spans dealt by page are neither moved nor sorted."""
    topmost = covers.groupBy("d", "p", *[f"c{k}" for k in BOX]).agg(F.max("op").alias("op")).hint("shuffle_hash")
    on_page = (F.col("doc_id") == F.col("d")) & (F.col("page_no") == F.col("p"))
    return spans.join(topmost, on_page & (F.col("op") > F.col("op_index")) & _half(), "left_semi")


def buried(spans: DataFrame, covers: DataFrame) -> DataFrame:
    """Those spans (doc_id, page_no, op_index, box and others) that one of covers (of cover_cells), painted after them, hides. Repeated rows stay repeated."""
    key = ("doc_id", "page_no", "op_index", *BOX)
    # Of covers with the same box, the last hides all that the others do.
    topmost = covers.groupBy("d", "p", "level", "gx", "gy", *[f"c{k}" for k in BOX]).agg(F.max("op").alias("op"))
    hit = met(spans.select(*key).distinct(), topmost, "op_index").select(*[F.col(k).alias(f"h_{k}") for k in key])
    equal = [F.col(k) == F.col(f"h_{k}") for k in key]
    return spans.join(hit, equal, "left_semi")
