"""What is believed of messages between a page and its guard, and what becomes of requests.

All functions take streams as well as tables but for those that say otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds until a session without greeting is let through, and a request without verdict.
GREETING, DEADLINE = 3, 120


def greeted(sessions: DataFrame, hellos: DataFrame, seconds: int = GREETING) -> DataFrame:
    """(session, nonce) of each session (session, opened): the nonce of its first hello (session, at, nonce) in time, null if none came. Of hellos at one time the least nonce counts. For tables."""
    said = hellos.where("nonce is not null").select(F.col("session").alias("s"), "at", "nonce")
    in_time = (F.col("session") == F.col("s")) & (F.col("at") >= F.col("opened")) & (F.col("at") <= F.col("opened") + F.expr(f"interval {seconds} seconds"))
    first = sessions.join(said, in_time).groupBy("session").agg(F.min_by("nonce", F.struct("at", "nonce")).alias("nonce"))
    return sessions.select("session").distinct().join(first, "session", "left")


def believed(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Of messages (session, nonce, own_channel, own_window and others), those by the channel, from the window itself and with the nonce that sessions (session, nonce) has; where a session has none, any nonce does."""
    own = sessions.select(F.col("session").alias("s"), F.col("nonce").alias("expected"))
    met = messages.where("own_channel and own_window").join(own, F.col("session") == F.col("s"))
    return met.where("expected is null or nonce = expected").drop("s", "expected")


def decided(requests: DataFrame, sessions: DataFrame, messages: DataFrame, seconds: int = DEADLINE) -> DataFrame:
    """(id, verdict) of requests (id, session, asked): of messages (session, nonce, id, told, verdict, own_channel, own_window) the first believed one in time; clean without one, or without a greeting. For tables."""
    said = believed(messages, sessions).select(F.col("id").alias("i"), "told", F.col("verdict").alias("v"))
    in_time = (F.col("id") == F.col("i")) & (F.col("told") >= F.col("asked")) & (F.col("told") <= F.col("asked") + F.expr(f"interval {seconds} seconds"))
    sent = requests.join(sessions.where("nonce is not null").select("session"), "session", "left_semi")  # without a nonce nothing is asked
    first = sent.join(said, in_time).groupBy("id").agg(F.min_by("v", F.struct("told", "v")).alias("verdict"))
    return requests.select("id").distinct().join(first, "id", "left").select("id", F.coalesce("verdict", F.lit("clean")).alias("verdict"))


def answer(verdict: Column, choice: Column) -> Column:
    """What is told of a file after somebody's choice: block stops it, allow lets an infected file pass as clean and others with their error; without a choice the verdict stands."""
    return F.when(choice == "block", "infected").when(choice == "allow", F.when(verdict == "infected", "clean").otherwise("error")).otherwise(verdict)


def block_marks(files: DataFrame) -> DataFrame:
    """(name, type, size, verdict, ts) of those files that are stopped."""
    return files.where("verdict = 'infected'").select("name", "type", "size", "verdict", "ts")


def flushed(requests: DataFrame, crashes: DataFrame) -> DataFrame:
    """(id, verdict) of requests (id, session, asked, told, verdict): error where the session's worker crashes (session, at) before it tells, from the time that it was asked on; clean where it never tells. For tables.

    A session's requests and crashes are one group, in order of time.
    """
    asked = requests.select("session", F.col("asked").alias("t"), F.struct("id", "told", "verdict").alias("r"), F.lit(None).cast("timestamp").alias("at"))
    down = crashes.where("session is not null and at is not null").select("session", F.col("at").alias("t"), F.lit(None).cast(asked.schema["r"].dataType).alias("r"), "at")
    following = Window.partitionBy("session").orderBy(F.col("t").desc(), F.col("at").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = asked.unionByName(down).withColumn("next", F.min("at").over(following)).where("r is not null")
    dead = F.col("next").isNotNull() & (F.col("r.told").isNull() | (F.col("next") < F.col("r.told")))
    return met.select("r.id", F.when(dead, "error").otherwise(F.coalesce("r.verdict", F.lit("clean"))).alias("verdict"))
