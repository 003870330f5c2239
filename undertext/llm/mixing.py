"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The budget is cut into blocks of equally many words (`block_words`, or fewer where a source's target is small, so that
none comes to nothing). Seats (blocks) go to sources by the highest quotients target / (2 s + 1), and each source's seats
go to its shards in the same way by the shards' words. Within a shard the documents lie in seeded order on one line of
words that is cut into strips; a quota of q words over n is taken as q div n passes over all strips, and q mod n words of
the strips of the lowest seeded hash once more, the last of which is taken in part. Documents are cut at these borders,
so that sources meet their targets to within a block a shard.

The divisor method never lists seats: rounding target / (total / seats) comes within half a seat a party of the
answer, and the few steps that remain take or return the best quotients (jump and step). Only tables with a row
a source or a row a shard are windowed; a shard holds a bounded number of words, hot sources just have more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertext.llm.common import blank_split, broadcast_if_small, let, shared_folder, stored, table


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in code point order; no source or document gives over `cap` times its words."""

    weights: tuple[int, ...] = (1, 2, 3)
    cap: int = 3
    block_words: int = 64
    strip_words: int = 64
    shard_words: int = 500_000
    seed: int = 17


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size) to (src, source, source_size, target): shares by weight, stopped at cap times the size.

    Re-sharing excess by weight until none is above its stop gives min(stop, level * weight) with one level for
    all. In order of stop / weight, the stopped sources come first: a source is stopped if the level that would
    hold from it on is at or above its own ratio.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), ((F.col("src") - 1) % len(mix.weights) + 1).cast("int"))
    named = sources.withColumn("src", F.row_number().over(by_name)).withColumn("weight", weight).withColumn("stop", (F.col("source_size") * mix.cap).cast("double"))
    first, all_of = Window.orderBy(F.col("stop") / F.col("weight"), "src"), Window.partitionBy()
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_of) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    rest = F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    stopped = named.withColumn("left", left).withColumn("rest", rest).withColumn("full", F.col("left") * F.col("weight") >= F.col("stop") * F.col("rest"))
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("stop"))).over(all_of), F.lit(0.0))
    share = F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_of), F.lit(1.0))
    level = (F.sum("source_size").over(all_of) - spent) / share
    return stopped.withColumn("target", F.when(F.col("full"), F.col("stop")).otherwise(level * F.col("weight"))).select("src", "source", "source_size", "target")


def apportioned(parties: DataFrame, group: list[str], party: str, votes: str, seats: str, most: str) -> DataFrame:
    """Adds quota: Sainte-Lague's seats of each party in its group, `most` of them at most.

    seats is the group's number of seats, the same in each of its rows. Jump to rounded shares, then step: with d
    seats left over of m parties, a party of share w gains or loses at most w (d + m) + 1 of them, so the candidate
    quotients number 3 m at most. Equal quotients fall by party order.
    """
    g = Window.partitionBy(*group)
    share = F.coalesce(F.try_divide(F.col(votes).cast("double"), F.sum(F.col(votes).cast("double")).over(g)), F.lit(0.0))
    jumped = parties.withColumn("_share", share).withColumn("_q", F.floor(F.col("_share") * F.col(seats) + 0.5))
    jumped = jumped.withColumn("_d", F.col(seats) - F.sum("_q").over(g)).withColumn("_m", F.count(F.lit(1)).over(g))
    reach = F.when(F.col("_d") == 0, 0).otherwise(F.ceil(F.col("_share") * (F.abs("_d") + F.col("_m"))) + 1).cast("long")
    reach = F.when(F.col("_d") < 0, F.least(reach, F.col("_q"))).otherwise(reach)
    step = F.explode_outer(F.when((reach > 0) & (F.col("_share") > 0), F.sequence(F.lit(1).cast("long"), reach)))
    steps = jumped.select("*", step.alias("_i"))
    odd = F.when(F.col("_d") > 0, 2 * (F.col("_q") + F.col("_i")) - 1).otherwise(2 * (F.col("_q") - F.col("_i")) + 1)
    quotient = F.col("_share") / odd
    best = Window.partitionBy(*group).orderBy(F.when(F.col("_d") > 0, -quotient).otherwise(quotient).asc_nulls_last(), party, "_i")
    taken = (F.row_number().over(best) <= F.abs("_d")) & F.col("_i").isNotNull()
    kept = [c for c in parties.columns]
    moved = steps.withColumn("_taken", taken.cast("long")).groupBy(*kept, "_q", "_d").agg(F.sum("_taken").alias("_t"))
    return moved.withColumn("quota", F.least(F.col("_q") + F.signum("_d").cast("long") * F.col("_t"), F.col(most))).select(*kept, "quota")


def pieces(sized: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """Rows (all columns of sized, and src, begin, end, times) for every part of a document in one strip; the targets.

    sized needs key, source, size. begin and end are the part's words, from 0; times is how often the mix takes it.
    """
    plan = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), mix), f"{shared_folder(sized.sparkSession)}/targets")
    n_sources = plan.count()
    plan = broadcast_if_small(plan, n_sources, 10_000)
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / mix.shard_words)).cast("long")
    shard = F.pmod(F.xxhash64(F.lit(mix.seed + 1), "key.doc_id", "key.h"), shards)
    names = plan.select("src", F.col("source").alias("_source"), "source_size", "target")
    named = sized.join(broadcast_if_small(names, n_sources, 10_000), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("shard", shard)

    # The source with the least target has 16 seats at least, if it has as many words.
    least = plan.where("target > 0").agg(F.min("target")).first()[0]
    block = max(1, min(mix.block_words, int((least or 0) // 16)))
    seats_of = lambda size: F.floor(F.col(size) * mix.cap / block).cast("long")
    seats = plan.withColumn("seats", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")).withColumn("most", seats_of("source_size")).withColumn("one", F.lit(1))
    by_source = apportioned(seats, ["one"], "src", "target", "seats", "most").select("src", F.col("quota").alias("source_seats"))
    by_shard = named.groupBy("src", "shard").agg(F.sum("size").alias("shard_size")).where("shard_size > 0").join(by_source, "src").withColumn("most", seats_of("shard_size"))
    quotas = apportioned(by_shard, ["src"], "shard", "shard_size", "source_seats", "most").select("src", "shard", "shard_size", (F.col("quota") * block).alias("words"))

    b = mix.strip_words
    line = Window.partitionBy("src", "shard").orderBy(F.xxhash64(F.lit(mix.seed), "key.doc_id", "key.h"), "key")
    upto = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))
    laid = named.where("size > 0").withColumn("_end", upto).withColumn("_begin", F.col("_end") - F.col("size"))
    cut = laid.withColumn("strip", F.explode(F.sequence(F.floor(F.col("_begin") / b), F.floor((F.col("_end") - 1) / b))))
    chance = lambda strip: F.xxhash64(F.lit(mix.seed), "src", "shard", strip)
    rank = F.dense_rank().over(Window.partitionBy("src", "shard").orderBy("_chance", "strip"))
    parts = cut.withColumn("_chance", chance("strip")).withColumn("_rank", rank).join(quotas, ["src", "shard"]).withColumn("_last", F.floor((F.col("shard_size") - 1) / b))
    # All strips before a strip are whole but for the line's last one.
    short = F.struct(chance("_last"), "_last") < F.struct("_chance", "strip")
    before = (F.col("_rank") - 1) * b - F.when(short, (F.col("_last") + 1) * b - F.col("shard_size")).otherwise(0)
    more = F.col("strip") * b + F.greatest(F.lit(0), F.least(F.lit(b), F.expr("words % shard_size") - before))  # up to here on the line
    begin, end = F.greatest(F.col("strip") * b, "_begin"), F.least((F.col("strip") + 1) * b, "_end")
    edge = F.greatest(begin, F.least(end, more))
    passes = F.expr("words div shard_size")
    own = lambda a, z, times: F.struct((a - F.col("_begin")).alias("begin"), (z - F.col("_begin")).alias("end"), times.alias("times"))
    both = parts.select(*sized.columns, "src", F.explode(F.array(own(begin, edge, passes + 1), own(edge, end, passes))).alias("_p"))
    return both.where("_p.begin < _p.end").select(*sized.columns, "src", "_p.begin", "_p.end", "_p.times"), plan


def word_count(text):
    return F.size(blank_split(text)).cast("long")


def sizes(docs: DataFrame, folder: str) -> DataFrame:
    """(key, doc_id, source, size), written once: the mix reads no text after it.

    h hashes the whole row. Equal rows get keys of their own, and so are interchangeable.
    """
    thin = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(*docs.columns).alias("h"))
    key = F.struct("doc_id", "h", F.monotonically_increasing_id().alias("row"))
    return stored(thin.select(key.alias("key"), "doc_id", "source", "size"), f"{folder}/sizes")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Every document with its size, its source's size and target, and the words of it that the mix takes.

    Null text has size 0 and is never taken; null source is the last source; repeated rows count and are taken each
    on its own; an empty table gives no rows. The seed and the documents alone decide, so reruns agree.
    """
    rows = sizes(docs, shared_folder(docs.sparkSession))
    parts, plan = pieces(rows, mix)
    taken = parts.where("times > 0").groupBy(F.col("key").alias("k")).agg(F.sum((F.col("end") - F.col("begin")) * F.col("times")).alias("taken"))
    named = rows.join(plan.select(F.col("source").alias("_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_source")))
    return named.join(taken, F.col("key") == F.col("k"), "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def copies(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time that a document is taken whole, and one with
    the words that are taken once more, joined by spaces; n_chars follows the text where it is there.
    Null and blank texts are never taken. Equal rows are interchangeable. Other columns are carried, whatever their names.
    """
    folder = shared_folder(docs.sparkSession)
    rows = sizes(docs, folder)
    parts, _ = pieces(rows, mix)
    by_row = parts.groupBy("key", "size").agg(
        F.min("times").alias("whole"),
        F.max("times").alias("most"),
        F.array_sort(F.collect_list(F.when(F.col("times") > 0, F.struct("begin", "end", "times")))).alias("parts"),
    )
    more = F.when(F.col("most") > F.col("whole"), F.array(F.filter("parts", lambda p: p.getField("times") > F.col("whole"))))
    whole = F.array_repeat(F.array().cast("array<struct<begin:bigint,end:bigint,times:bigint>>"), F.col("whole").cast("int"))
    spec = by_row.select("key", F.explode(F.concat(whole, F.coalesce(more, F.array().cast("array<array<struct<begin:bigint,end:bigint,times:bigint>>>")))).alias("runs"))
    spec = spec.groupBy(F.col("key.doc_id").alias("d"), F.col("key.h").alias("k")).agg(F.collect_list("runs").alias("all_runs"))
    repeated = stored(rows.groupBy(F.col("key.doc_id").alias("e_doc_id"), F.col("key.h").alias("e_h")).count().where("count > 1"), f"{folder}/repeated")
    n_repeated = repeated.count()
    held = docs.select("doc_id", F.xxhash64(*docs.columns).alias("h"), "text", F.struct("*").alias("row"))

    def repeats(how):
        return held.join(broadcast_if_small(repeated, n_repeated, 1_000_000), (F.col("h") == F.col("e_h")) & F.col("doc_id").eqNullSafe(F.col("e_doc_id")), how)

    one = repeats("left_anti").union(repeats("left_semi").dropDuplicates(["doc_id", "h"]))  # of equal rows one, which has the runs of all
    joined = one.join(spec, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k"))).withColumn("run", F.explode("all_runs"))

    def chosen(words):
        return F.array_join(F.flatten(F.transform("run", lambda r: F.slice(words, (r.getField("begin") + 1).cast("int"), (r.getField("end") - r.getField("begin")).cast("int")))), " ")

    text = F.when(F.size("run") == 0, F.col("text")).otherwise(let(blank_split(F.col("text")), chosen))
    out = joined.withColumn("text", text)
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def stage(spark, docs, sf_dir) -> DataFrame:
    """What the mix takes of the documents, as copies gives it; an empty table gives no rows."""
    return copies(docs)


def op1_mix_sources(spark, sf_dir) -> DataFrame:
    """The whole documents table, as mixed gives it; see there for nulls, repeated rows and empty tables."""
    return mixed(table(spark, sf_dir, "documents"))
