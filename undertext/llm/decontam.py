"""Benchmark decontamination over a positional inverted index.

Postings (key, position, term) of the training tokens that stand in any benchmark item are written once, with each
document's number of words. A window's terms are ranked by the index's counts. The rarest term's list gives the places
that the window can have; they are intersected with the offset-adjusted lists of the next rarest, one after the other, which
leaves few, and then with those of all other terms, of the documents that are left. Lists are met within `reach` positions: a place where
every term is at its own offset is an exact phrase, one where every term is somewhere within reach of the rarest a
proximity match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertext.llm.common import broadcast_if_small, discard, gap_split, named_rows, shared_folder, stored, table, without

SPAN, REACH = 10, 20
#: So many of a window's rarest terms are met one after the other, over all documents.
PRUNED = 2
#: Benchmark windows, terms and documents with places are broadcast up to this many rows (about 200 bytes each), else joined by shuffle.
SMALL = 200_000


def index(docs: DataFrame, vocabulary: DataFrame, keep: tuple[str, ...], folder: str) -> DataFrame:
    """(key, pos, term) of every token of docs that vocabulary (term) has, and a row with null term, whose pos is the number of words, for every row of docs; written to folder.

    key holds doc_id, the columns in keep and a hash of the text; equal rows share it.
    """
    key = F.struct("doc_id", *[c for c in keep if c != "doc_id"], F.xxhash64("text").alias("_text")).alias("key")
    words = docs.select(key, gap_split(F.col("text")).alias("words"))
    each = words.select("key", F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("pos", "term"))
    known = vocabulary.select(F.col("term").alias("_term")).withColumn("_known", F.lit(True))
    return stored(each.join(known, F.col("term") == F.col("_term"), "left").where("term is null or _known").select("key", "pos", "term"), folder)


def windows(items: DataFrame, span: int) -> DataFrame:
    """(terms, items): distinct windows of span consecutive words; a shorter item is one window."""
    words = items.select("item_id", gap_split(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - span + 1, F.lit(1)))
    cut = words.withColumn("i", F.explode(starts)).select("item_id", F.slice("w", F.col("i"), F.lit(span)).alias("terms"))
    return cut.groupBy("terms").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))


def ranked(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(w, size, offset, term, rank) of the terms of windows asked (w, terms), the rarest by counts (term, c) first. Windows with a term that no document has are left out."""
    listed = asked.select("w", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term")).join(counts, "term", "left")
    own = Window.partitionBy("w")
    told = listed.withColumn("rank", F.row_number().over(own.orderBy("c", "offset"))).withColumn("found", F.count("c").over(own))
    return told.where("found = size").select("w", "size", "offset", "term", "rank")


def near(places: DataFrame, lists: DataFrame, reach: int, how: str) -> DataFrame:
    """places (key, pos, wanted and others) joined with lists (k, p, term): where the term wanted is at most reach away. Both meet in stretches of positions, a place in two of them at most."""
    wide = 2 * reach
    asked = places.withColumn("stretch", F.explode(F.sequence(F.floor((F.col("pos") - reach) / wide), F.floor((F.col("pos") + reach) / wide))))
    dealt = lists.withColumn("_stretch", F.floor(F.col("p") / wide))
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("wanted") == F.col("term")) & (F.col("stretch") == F.col("_stretch")) & (F.abs(F.col("pos") - F.col("p")) <= reach)
    return asked.join(dealt, same, how)


def matches(postings: DataFrame, asked: DataFrame, terms: DataFrame, reach: int, folder: str) -> DataFrame:
    """(key, start, size, w, exact) of every place of a window in the index: all its terms are within reach of its rarest, and exact if each is at its own offset."""
    n = asked.count()
    small = lambda df, times: broadcast_if_small(df, n * times, SMALL)
    lists = postings.select(F.col("key").alias("k"), F.col("pos").alias("p"), "term")
    places = postings.join(small(terms.where("rank = 1").drop("rank"), 1), "term").select("key", "pos", "w", "size", "offset")
    columns = places.columns
    for rank in range(2, PRUNED + 1):
        own = terms.where(F.col("rank") == rank)
        of_own = lists.join(small(own.select("term").distinct(), 1), "term", "left_semi")
        kept = near(places.join(small(own.select("w", F.col("term").alias("wanted")), 1), "w"), of_own, reach, "left_semi")
        places = stored(kept.select(*columns).union(places.where(F.col("size") < rank)).distinct(), f"{folder}/places{rank}")
    keys = stored(places.select(F.col("key").alias("_key")).distinct(), f"{folder}/keys")
    left = lists.join(broadcast_if_small(keys, keys.count(), SMALL), F.col("k").eqNullSafe(F.col("_key")), "left_semi")
    # The first terms are met again: only now their offsets count.
    others = terms.where("rank > 1").select("w", F.col("offset").alias("o"), F.col("term").alias("wanted"), F.expr("shiftleft(1L, rank)").alias("bit"))
    met = near(places.join(small(others, SPAN), "w"), left, reach, "inner")
    there = F.col("p") - F.col("pos") == F.col("o") - F.col("offset")
    whole = met.groupBy(*columns).agg(F.bit_or("bit").alias("all"), F.bit_or(F.when(there, F.col("bit")).otherwise(0)).alias("at"))
    every = F.expr("shiftleft(1L, size + 1) - 4")
    found = whole.where(F.col("all") == every).select("key", (F.col("pos") - F.col("offset")).alias("start"), "size", "w", (F.col("at") == every).alias("exact"))
    return found.union(places.where("size = 1").select("key", "pos", "size", "w", F.lit(True)))


def covered(spans):
    """Words within any of the sorted (start, size) spans."""
    step = lambda a, s: F.struct(
        F.greatest(a.getField("end"), s.getField("start") + s.getField("size")).alias("end"),
        (a.getField("n") + F.greatest(F.lit(0), s.getField("start") + s.getField("size") - F.greatest(a.getField("end"), s.getField("start")))).alias("n"),
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda a: a.getField("n"))


def checked(docs: DataFrame, items: DataFrame, *keep: str, span: int = SPAN, reach: int = REACH) -> DataFrame:
    """Every row of docs with n_words, n_hit, n_items, items_sha256, contaminated, n_near and the columns in keep.

    n_near: items with a proximity match of any of their windows, exact ones among them. Null text has no words and is
    clean. Items without words say nothing. Repeated rows have the same result each. An empty table gives no rows, and
    without items all documents are clean.
    """
    if span > 60:
        raise ValueError("a window's terms are bits of a number: 60 at most")
    folder = shared_folder(docs.sparkSession)
    asked = stored(windows(items, span).withColumn("w", F.monotonically_increasing_id()), f"{folder}/windows")
    vocabulary = stored(asked.select(F.explode("terms").alias("term")).distinct(), f"{folder}/vocabulary")
    n_terms = vocabulary.count()
    postings = index(docs, broadcast_if_small(vocabulary, n_terms, SMALL), keep, f"{folder}/postings")
    words = postings.where("term is not null")
    counts = stored(words.groupBy("term").agg(F.count(F.lit(1)).alias("c")), f"{folder}/counts")
    terms = stored(ranked(asked, broadcast_if_small(counts, n_terms, SMALL)), f"{folder}/terms")
    named = matches(words, asked, terms, reach, folder).join(broadcast_if_small(asked.select("w", "items"), asked.count(), SMALL), "w")
    exact = F.when(F.col("exact"), F.struct("start", "size"))
    of = lambda kept: F.array_distinct(F.flatten(F.collect_set(kept)))
    found = named.groupBy("key").agg(F.array_sort(F.collect_set(exact)).alias("spans"), F.array_sort(of(F.when(F.col("exact"), F.col("items")))).alias("items"), F.size(of(F.col("items"))).cast("long").alias("n_near"))
    found = found.select(F.col("key").alias("_key"), "n_near", covered(F.col("spans")).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    facts = stored(found, f"{folder}/facts")
    rows = stored(postings.where("term is null").select("key", F.col("pos").cast("long").alias("n_words")), f"{folder}/rows")
    discard(docs.sparkSession, f"{folder}/postings")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    told = rows.join(broadcast_if_small(facts, facts.count(), SMALL), F.col("key").eqNullSafe(F.col("_key")), "left")
    return told.select(
        *[F.col("key").getField(c).alias(c) for c in ("doc_id", *[c for c in keep if c != "doc_id"])],
        "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), zero("n_near"),
    )


def op2_decontaminate(spark, sf_dir) -> DataFrame:
    """The whole documents and benchmark tables, as checked gives them; see there for nulls, repeated rows and empty tables."""
    return checked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs, sf_dir) -> DataFrame:
    """The documents without any benchmark window, with all columns; an empty table gives no rows."""
    found = checked(named_rows(docs, ("text",), "text"), table(spark, sf_dir, "benchmark"), "h", "h2").where("contaminated")
    return without(docs, ("text",), found, f"{shared_folder(spark)}/contaminated")
