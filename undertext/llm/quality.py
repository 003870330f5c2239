"""Quality rules whose cutoffs carry a guarantee about the good documents that they reject.

Every rule is a metric in whole ten-thousandths and a side (too high, too low). Labelled good documents are the
holdout. For each stratum (language) and rule, a cutoff is valid if it leaves at most k good documents
beyond it, where k is the largest count with P(Binomial(n, a) <= k) <= d. Then, with confidence
1 - d, at most a share a of the stratum's good documents is rejected. a is the total risk divided among the
rules, and d is Bonferroni's share of the total error over all strata and rules. Strata with too few labels for
any k get no cutoff and reject nothing.

The holdout is counted into a histogram of the metric's whole values first, so no window ever sees more rows
than a metric has values (10,001 for shares; for the mean length of words as many as labelled documents have).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertext.llm.common import BLANK_RUN, blank_split, broadcast_if_small, let, named_rows, shared_folder, stored, table, without

SYMBOLS = "#*$%&|<>"
#: Cutoffs are broadcast up to this many strata, else joined by shuffle.
SMALL = 10_000


@dataclass(frozen=True)
class Risk:
    """At most `rejection` of a stratum's good documents go, with confidence 1 - `error` for all strata and rules.

    price: how many times a good document's loss outweighs catching a bad one, among cutoffs that hold the bound.
    """

    rejection: float = 0.05
    error: float = 0.05
    price: float = 20.0


#: Name, metric over the base columns, and whether large values are the bad ones.
RULES: tuple[tuple[str, str, bool], ...] = (
    ("symbols", "n_symbols * 10000 div greatest(word_chars, 1)", True),
    ("dup_lines", "n_dup_lines * 10000 div greatest(n_lines, 1)", True),
    ("repeats", "n_repeat_words * 10000 div greatest(n_words, 1)", True),
    ("long_words", "word_chars * 100 div greatest(n_words, 1)", True),
    ("short_words", "word_chars * 100 div greatest(n_words, 1)", False),
)


def covered_by_repeats(words: Column) -> Column:
    """Words that stand in a window of three found twice or more in the array."""

    def cover(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            def twin(e: Column, k: Column) -> Column:
                before = F.when(k > 0, F.get(s, k - 1).getField("h") == e.getField("h")).otherwise(False)
                return before | F.coalesce(F.get(s, k + 1).getField("h") == e.getField("h"), F.lit(False))

            return F.sort_array(F.transform(F.filter(s, twin), lambda e: e.getField("i")))

        def spread(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get(p, k - 1))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(let(pairs, places), spread)
        )

    def windows(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(grams, cover))

    return let(words, windows)


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns in keep and the base measures of each row's whole text.

    Null and blank text count as no words, no symbols and no lines. Repeated windows are compared by 64-bit hash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    split = docs.select(*keep, text.alias("_text"), blank_split(F.col("text")).alias("w"), lines.alias("lines"))
    return split.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", BLANK_RUN, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered_by_repeats(F.col("w")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def judged(rows: DataFrame) -> DataFrame:
    """Adds base_failed and a metric column for each rule."""
    bad = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return rows.withColumn("base_failed", bad).withColumns({f"m_{n}": F.expr(e).cast("long") for n, e, _ in RULES})


def log_gamma(x: Column) -> Column:
    """log((x - 1)!) for whole x from 1 on, by Stirling's series after a shift by eight."""
    z = x + F.lit(8.0)
    shift = reduce(lambda a, i: a + F.log(x + F.lit(float(i))), range(1, 8), F.log(x))
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return (z - 0.5) * F.log(z) - z + F.lit(0.9189385332046727) + series - shift


def allowed(strata: DataFrame, risk: Risk) -> DataFrame:
    """(stratum, n) to (stratum, n, k): the largest k with P(Binomial(n, a) <= k) <= d, or no row for want of data.

    The sum starts 12 standard deviations and 40 below the mean; what lies below is under exp(-70).
    """
    a = risk.rejection / len(RULES)
    n, j = F.col("n").cast("double"), F.col("j").cast("double")
    span = F.lit(12.0) * F.sqrt(n * a * (1 - a)) + 40
    low = F.greatest(F.lit(0), F.floor(n * a - span)).cast("long")
    log_p = log_gamma(n + 1) - log_gamma(j + 1) - log_gamma(n - j + 1) + j * F.log(F.lit(a)) + (n - j) * F.log(F.lit(1 - a))
    tests = strata.withColumn("tests", F.count(F.lit(1)).over(Window.partitionBy()) * len(RULES))
    terms = tests.withColumn("j", F.explode(F.sequence(low, F.least(F.col("n"), F.ceil(n * a).cast("long"))))).withColumn("p", F.exp(log_p))
    below = F.sum("p").over(Window.partitionBy("stratum").orderBy("j"))
    return terms.withColumn("below", below).where(F.col("below") <= F.lit(risk.error) / F.col("tests")).groupBy("stratum").agg(F.max("j").alias("k"))


def cutoffs(rows: DataFrame, labels: DataFrame, risk: Risk) -> DataFrame:
    """(stratum, rule, cutoff) from the judged rows that have a label and that the base rules pass.

    Every cutoff with at most k good documents beyond it keeps the guarantee, so the best of them may be chosen by
    the same labels: the one with the greatest share of bad documents beyond it less `price` times the share of good
    ones, the mildest of equals. A rule that gains nothing gets no cutoff. Labels that contradict each other count
    as bad.
    """
    named = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("named_id")).agg(F.min("quality").alias("quality"))
    held = rows.where("not base_failed").join(named, F.col("doc_id") == F.col("named_id"))
    ladder = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), (F.col(f"m_{n}") if up else -F.col(f"m_{n}")).alias("v")) for n, _, up in RULES]))
    good = F.count_if(F.col("quality") == 1)
    values = held.select("stratum", "quality", ladder.alias("r")).groupBy("stratum", "r.rule", "r.v").agg(good.alias("good"), (F.count(F.lit(1)) - good).alias("bad"))
    strata = values.where(F.col("rule") == RULES[0][0]).groupBy("stratum").agg(F.sum("good").alias("n"))
    all_of, beyond = Window.partitionBy("stratum", "rule"), Window.partitionBy("stratum", "rule").orderBy(F.desc("v"))
    ranked = values.select(
        "stratum",
        "rule",
        "v",
        (F.sum("good").over(beyond) - F.col("good")).alias("good_above"),
        F.try_divide(F.sum("bad").over(beyond) - F.col("bad"), F.sum("bad").over(all_of)).alias("caught"),
        F.try_divide(F.sum("good").over(beyond) - F.col("good"), F.sum("good").over(all_of)).alias("lost"),
    )
    gain = F.coalesce(F.col("caught"), F.lit(0.0)) - F.col("lost") * risk.price
    valid = ranked.join(allowed(strata, risk), "stratum").where("good_above <= k").withColumn("gain", gain)
    return valid.where("gain > 0").groupBy("stratum", "rule").agg(F.max_by("v", F.struct("gain", "v")).alias("cutoff"))


def verdicts(docs: DataFrame, labels: DataFrame, *keep: str, risk: Risk = Risk()) -> DataFrame:
    """Every row of docs with its base measures, base_failed, and kept.

    docs needs doc_id, text and lang; labels needs doc_id and quality. Null lang is a stratum of its own. A null
    doc_id is judged like any other row but never counts as labelled; repeated rows are each judged. Columns named
    in keep come along. Empty tables give empty results, empty labels reject by the base rules alone.
    """
    keep = ("doc_id", *[c for c in keep if c != "doc_id"])
    wanted = docs.select(*keep, *[c for c in ("text", "lang") if c not in keep])
    thin = measured(wanted.withColumn("stratum", F.concat(F.lit("lang:"), F.coalesce(F.col("lang"), F.lit("\x00")))), *keep, "stratum")
    folder = shared_folder(docs.sparkSession)
    rows = stored(judged(thin), f"{folder}/measures")
    limits = cutoffs(rows, labels, risk).groupBy("stratum").pivot("rule", [n for n, _, _ in RULES]).agg(F.first("cutoff"))
    limits = stored(limits.select(F.col("stratum").alias("of_stratum"), *[F.col(n).alias(f"x_{n}") for n, _, _ in RULES]), f"{folder}/limits")
    over = [F.coalesce((F.col(f"m_{n}") if up else -F.col(f"m_{n}")) > F.col(f"x_{n}"), F.lit(False)) for n, _, up in RULES]
    rejected = reduce(lambda a, b: a | b, over)
    joined = rows.join(broadcast_if_small(limits, limits.count(), SMALL), F.col("stratum") == F.col("of_stratum"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_quality_rules(spark, sf_dir) -> DataFrame:
    """The whole documents and labels tables, as verdicts gives them."""
    return verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark, docs, sf_dir) -> DataFrame:
    """The documents that the rules keep, with all columns; an empty table gives no rows."""
    rows = named_rows(docs, ("text", "lang"), "text", "lang")
    rejected = verdicts(rows, table(spark, sf_dir, "labels"), "h", "h2").where("not kept")
    return without(docs, ("text", "lang"), rejected, f"{shared_folder(spark)}/rejected")
