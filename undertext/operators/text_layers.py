"""Layers over lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertext.functions.lexicon import INVISIBLE, escaped
from undertext.functions.text import is_adversarial, lines, shown


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) from (doc_id, text), from 1."""
    return docs.select("doc_id", F.posexplode(lines(F.col("text"))).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("line_no"), "line")


def zero_width(lines_: DataFrame) -> DataFrame:
    """A threat for every invisible code point. Lines without one are never taken apart."""
    marked = lines_.where(F.col("line").rlike(f"[{escaped(INVISIBLE, False)}]"))
    chars = marked.select("doc_id", "line_no", shown(F.col("line")).alias("seen"), F.posexplode(F.split("line", "")).alias("i", "ch"))
    point = F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii("ch")), 4, "0"))
    found = chars.where((F.col("ch") != "") & F.lit(INVISIBLE).contains(F.col("ch"))).withColumn("codepoint", point)
    payload = F.concat(F.when(F.col("seen") == "", "").otherwise(F.concat("seen", F.lit(" "))), F.lit("["), F.col("codepoint"), F.lit("]"))
    return found.select("doc_id", "line_no", (F.col("i") + 1).alias("col"), "codepoint", payload.alias("payload"))


def adversarial_lines(lines_: DataFrame) -> DataFrame:
    return lines_.where(is_adversarial(F.col("line")))


def verdicts(docs: DataFrame, threats: DataFrame) -> DataFrame:
    """(doc_id, verdict, n_threats): documents without threats are clean."""
    counted = threats.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.select("doc_id").join(counted, "doc_id", "left").select("doc_id", F.when(F.col("n") > 0, "infected").otherwise("clean").alias("verdict"), F.coalesce("n", F.lit(0)).alias("n_threats"))
