"""Requests and verdicts as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_deadline(requests: DataFrame, verdicts: DataFrame, seconds: int = 120) -> DataFrame:
    """(id, asked, verdict) of every request (id, asked); verdict is clean where none (id, told, verdict) came in time.

    The first verdict of an id to arrive counts. Both streams carry watermarks of the deadline, so state is bounded and
    late verdicts count as none; what is without a verdict comes out once the watermark has passed its deadline.
    """
    span = f"{seconds} seconds"
    r = requests.withWatermark("asked", span)
    v = once(verdicts, "id", "told", seconds).select(F.col("id").alias("v_id"), "told", "verdict")
    within = (F.col("id") == F.col("v_id")) & (F.col("told") >= F.col("asked")) & (F.col("told") <= F.col("asked") + F.expr(f"interval {span}"))
    return r.join(v, within, "leftOuter").select("id", "asked", F.coalesce("verdict", F.lit("clean")).alias("verdict"))


def once(verdicts: DataFrame, key: str, at: str, seconds: int = 120) -> DataFrame:
    """The first of each key within the deadline."""
    return verdicts.withWatermark(at, f"{seconds} seconds").dropDuplicatesWithinWatermark([key])


def replayed(answers: DataFrame) -> DataFrame:
    """Of answers (verdict, scannable), what is sent after all: what was not looked at, and what was and is not infected."""
    return answers.where("not coalesce(scannable, false) or verdict is null or verdict <> 'infected'")
