"""Reports of scanned files: what kind a file is, its verdict, and the history of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertext.functions.lexicon import SPACES
from undertext.operators.labels import labelled
from undertext.operators.sites import file_type

# The largest file that is scanned, the history's characters of a payload and number of entries, file signatures.
MAX_BYTES, PAYLOAD_CAP, ENTRIES = 50 * 1024 * 1024, 1000, 100
PDF_MAGIC, ZIP_MAGIC = "%PDF", "PK\x03\x04"
# The head of an encrypted package, what errors of files say, and why a file without text isn't scanned.
ENCRYPTED_MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
MESSAGES = {
    "OVERSIZED": 'הקובץ גדול מדי לסריקה (מעל 50 מ"ב)',
    "OVERSIZED inside": "תוכן הקובץ הדחוס גדול מדי לסריקה בטוחה",
    "ENCRYPTED": "הקובץ מוצפן ולא ניתן לסריקה",
    "CORRUPT": "מבנה הקובץ פגום או לא חוקי",
    "INTERNAL": "שגיאה פנימית במנוע הסריקה",
}
IMAGE_ONLY = "קובץ מבוסס תמונה — אין שכבת טקסט לסריקה"


def oversize(size: Column) -> Column:
    """Whether a file is too large to be scanned. Null sizes are not."""
    return F.coalesce(size > MAX_BYTES, F.lit(False))


def sniffed(content: Column) -> Column:
    """A nameless file's kind by its bytes: a PDF by its head, a package by its head and a member path, all else text."""
    starts = lambda sig: F.coalesce(F.startswith(content, F.lit(sig.encode())), F.lit(False))
    member = lambda path: F.contains(content, F.lit(path.encode()))
    package = F.when(member("ppt/"), "pptx").when(member("word/"), "docx").otherwise("txt")
    return F.when(starts(PDF_MAGIC), "pdf").when(starts(ZIP_MAGIC), package).otherwise("txt")


def is_text(kind: Column) -> Column:
    return kind.isin("txt", "md")


def encrypted(content: Column) -> Column:
    """Whether the bytes are those of an encrypted package; null isn't."""
    return F.coalesce(F.startswith(content, F.lit(ENCRYPTED_MAGIC)), F.lit(False))


def fault(kind: Column, size: Column, head: Column, opened: Column, has_listing: Column) -> Column:
    """What is wrong with a file, as a key of MESSAGES, or null.

    Size comes before all. opened: null, or what reading came to: password, bomb (more inside than is unpacked),
    internal, or anything else for content that is not of its kind. Text is always readable. Packages are encrypted by
    their head, and a presentation must list its slides.
    """
    package = kind.isin("docx", "pptx")
    why = F.when(opened == "password", "ENCRYPTED").when((opened == "bomb") & package, "OVERSIZED inside").when(opened == "internal", "INTERNAL").when(opened.isNotNull(), "CORRUPT")
    listed = F.when((kind == "pptx") & ~F.coalesce(has_listing, F.lit(False)), "CORRUPT")
    return F.when(oversize(size), "OVERSIZED").when(is_text(kind), F.lit(None)).when(package & encrypted(head), "ENCRYPTED").otherwise(F.coalesce(why, listed))


def page_facts(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, text_chars, has_images) from pages (doc_id, page_no, text_chars, n_images)."""
    return pages.groupBy("doc_id").agg(F.max("page_no").cast("long").alias("pages"), F.coalesce(F.sum("text_chars"), F.lit(0)).alias("text_chars"), F.coalesce(F.bool_or(F.col("n_images") > 0), F.lit(False)).alias("has_images"))


def file_reports(files: DataFrame, threats: DataFrame, units: DataFrame) -> DataFrame:
    """(doc_id, name, file_type, size, pages, ok, verdict, n_threats, layers, code, message, reason) of every file of a mixed table.

    files: (doc_id, name, size, head, opened, has_listing); threats: (doc_id, layer) of whatever kinds of file; units:
    (doc_id, pages, text_chars, has_images) of PDF files and presentations. A file with an error has neither threats
    nor pages; other files without threats stay. layers: those that fired, sorted.
    """
    typed = files.withColumn("file_type", file_type(F.col("name"))).withColumn("fault", fault(F.col("file_type"), *map(F.col, ("size", "head", "opened", "has_listing"))))
    found = threats.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("fired"))
    facts = typed.join(found, "doc_id", "left").join(units, "doc_id", "left")
    fine = F.col("fault").isNull()
    n = F.when(fine, F.coalesce("n", F.lit(0))).otherwise(0)
    images = (F.col("file_type") == "pdf") & F.col("has_images")
    told = facts.withColumn("verdict", verdict(n, F.col("text_chars"), images, F.col("fault"))).withColumn("n_threats", n.cast("long"))
    named = labelled(told, "fault", MESSAGES, "message", F.lit(None).cast("string"))
    return named.select(
        "doc_id", "name", "file_type", "size", F.when(fine & F.col("file_type").isin("pdf", "pptx"), F.col("pages")).alias("pages"), fine.alias("ok"), "verdict", "n_threats",
        F.when(fine, F.coalesce("fired", F.lit(""))).otherwise("").alias("layers"), F.substring_index("fault", " ", 1).alias("code"), "message", F.when(F.col("verdict") == "unscannable", IMAGE_ONLY).alias("reason"),
    )


def verdict(n_threats: Column, text_chars: Column, has_images: Column, error: Column) -> Column:
    """error wins; threats make a file infected; one that has images and not a character on any page is unscannable; else it is clean.

    text_chars: characters of all its pages together; null, as for kinds without pages, is not 0.
    """
    image_only = F.coalesce((text_chars == 0) & has_images, F.lit(False))
    return F.when(error.isNotNull(), "error").when(n_threats > 0, "infected").when(image_only, "unscannable").otherwise("clean")


def history(reports: DataFrame, threats: DataFrame, order: list[str]) -> DataFrame:
    """(doc_id, name, file_type, verdict, layer, payload, ts): a report with its first threat, the payload cut to its cap.

    order: columns of threats by which one is first. A payload is kept for a threat with text only.
    """
    first = threats.groupBy("doc_id").agg(F.min_by(F.struct("layer", "extracted"), F.struct(*order)).alias("t"))
    payload = F.when(F.col("t.extracted") != "", F.substring("t.extracted", 1, PAYLOAD_CAP))
    return reports.join(first, "doc_id", "left").select("doc_id", "name", "file_type", "verdict", F.col("t.layer").alias("layer"), payload.alias("payload"), "ts")


def entries(reports: DataFrame, threats: DataFrame, order: list[str]) -> DataFrame:
    """Entries as history gives them, with an id of their own and the location (of threats) of the first threat; null without threats. Ids are random, so they differ between runs."""
    first = threats.groupBy("doc_id").agg(F.min_by("location", F.struct(*order)).alias("location"))
    return history(reports, threats, order).join(first, "doc_id", "left").withColumn("id", F.expr("uuid()"))


def visible(entries: DataFrame, kind: str, query: str) -> DataFrame:
    """History entries of a verdict (or all) whose name contains the query, in any case; a blank query finds all."""
    wanted = query.strip(SPACES).lower()
    some = entries if kind == "all" else entries.where(F.col("verdict") == kind)
    return some.where(F.contains(F.lower("name"), F.lit(wanted))) if wanted else some


def newest(entries: DataFrame) -> DataFrame:
    """The history holds its newest entries alone; of equal times, those with the larger id are newer."""
    return entries.orderBy(F.desc("ts"), F.desc("doc_id")).limit(ENTRIES)
