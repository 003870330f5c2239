"""What is let through: requests of several files, settings in force at a time, and comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def should_block(verdict: Column) -> Column:
    """Infected files alone are stopped; errors, unscannable files and null are let through."""
    return F.coalesce(verdict == "infected", F.lit(False))


def answered(asked: DataFrame, told: DataFrame, seconds: int = 120) -> DataFrame:
    """(id, verdict) of each distinct id of asked (id, key, asked): that of the key's first row of told (key, told, verdict) from then on within so many seconds, clean where there is none.

    Of equal times the lesser verdict counts; a null key or time asks and tells nothing. Time is cut into bins as long
    as the deadline: what follows in time lies in a request's bin or the next, so a busy key is many groups.
    """
    bin_ = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    near = asked.select("id", "key", "asked", F.explode(F.array(bin_("asked"), bin_("asked") + 1)).alias("bin"))
    said = told.where("verdict is not null").select(F.col("key").alias("k"), "told", "verdict", bin_("told").alias("b"))
    within = (F.col("key") == F.col("k")) & (F.col("bin") == F.col("b")) & (F.col("told") >= F.col("asked")) & (F.col("told") <= F.col("asked") + F.expr(f"interval {seconds} seconds"))
    first = near.join(said, within).groupBy("id").agg(F.min_by("verdict", F.struct("told", "verdict")).alias("verdict"))
    return asked.select("id").distinct().join(first, "id", "left").select("id", F.coalesce("verdict", F.lit("clean")).alias("verdict"))


def requests(files: DataFrame) -> DataFrame:
    """(request_id, blocked, first_blocked, n_passed) from (request_id, seq, verdict): all files must pass, in order, and the first that does not ends the request."""
    stopped = F.when(should_block(F.col("verdict")), F.col("seq"))
    first = files.groupBy("request_id").agg(F.min(stopped).alias("first_blocked"), F.count("seq").alias("n"))
    # Only the files of stopped requests are counted a second time.
    before = files.join(first.where("first_blocked is not null").select(F.col("request_id").alias("r"), F.col("first_blocked").alias("f")), F.col("request_id").eqNullSafe(F.col("r")) & (F.col("seq") < F.col("f")), "left_semi").groupBy(F.col("request_id").alias("r")).agg(F.count("seq").alias("m"))
    passed = F.when(F.col("first_blocked").isNull(), F.col("n")).otherwise(F.coalesce("m", F.lit(0)))
    return first.join(before, F.col("request_id").eqNullSafe(F.col("r")), "left").select("request_id", F.col("first_blocked").isNotNull().alias("blocked"), "first_blocked", passed.cast("long").alias("n_passed"))


def in_force(asked: DataFrame, told: DataFrame, seconds: int = 86_400) -> DataFrame:
    """asked (id, key, ts) with active: what the key's latest row of told (id, key, ts, on) up to then says, and on where none does.

    A null on or key says nothing. Of equal times the larger id of told is later, and it counts for what is asked at that time. Each key is cut into
    bins of time: rows are ordered within a bin, and only one row a bin is carried on to later bins, so that a busy
    key is many groups.
    """
    bin_ = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000))
    nobody = asked.where("key is null").select("id", "key", "ts", F.lit(True).alias("active"))  # answered without a group
    both = told.where("key is not null and on is not null").select("id", "key", "ts", F.lit(0).alias("kind"), "on").unionByName(asked.where("key is not null").select("id", "key", "ts", F.lit(1).alias("kind"), F.lit(None).cast("boolean").alias("on")))
    both = both.withColumn("bin", bin_)
    within = Window.partitionBy("key", "bin").orderBy("ts", "kind", "id")
    last = both.where("kind = 0").groupBy("key", "bin").agg(F.max_by("on", F.struct("ts", "id")).alias("carried"))
    bins = both.select("key", "bin").distinct()
    # A bin takes from the last bin before it that tells something: one ordered pass over bins.
    before = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.join(last, ["key", "bin"], "left").withColumn("from_before", F.last("carried", ignorenulls=True).over(before)).select("key", "bin", "from_before")
    own = both.withColumn("own", F.last("on", ignorenulls=True).over(within)).where("kind = 1")
    return own.join(carried, ["key", "bin"], "left").select("id", "key", "ts", F.coalesce("own", "from_before", F.lit(True)).alias("active")).unionByName(nobody)


def overlaid(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """(owner, host, on): defaults (owner, host, on), over which each host's last stored value that isn't null (owner, host, ts, id, on) is laid."""
    latest = stored.where("on is not null").groupBy("owner", "host").agg(F.max_by("on", F.struct("ts", "id")).alias("set"))
    return defaults.join(latest, ["owner", "host"], "full").select("owner", "host", F.coalesce("set", "on").alias("on"))


def differences(golden: DataFrame, actual: DataFrame) -> DataFrame:
    """golden's columns and n_golden, n_actual of each tuple that the two hold unequally often. Nulls are equal to each other."""
    columns = golden.columns
    both = golden.withColumn("n_golden", F.lit(1)).withColumn("n_actual", F.lit(0)).unionByName(actual.select(*columns).withColumn("n_golden", F.lit(0)).withColumn("n_actual", F.lit(1)))
    return both.groupBy(*columns).agg(F.sum("n_golden").alias("n_golden"), F.sum("n_actual").alias("n_actual")).where("n_golden <> n_actual")
