"""Frames of a connection are let through in the order in which they were sent, each once it and all before it are ready."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RELEASED = "conn string, seq long, ready timestamp, verdict string, late boolean"
STATE = "next long, seqs array<long>, ready array<timestamp>, verdicts array<string>"


def release_times(frames: DataFrame, span: int = 4096) -> DataFrame:
    """frames (conn, seq, ready, verdict) with released: when the frame may go, the latest ready time up to it; infected frames go nowhere, but what is behind them waits for their scan.

    A null ready time holds nothing back; a null conn is a connection of its own. Connections are cut into stretches of
    so many seqs: latest times are taken within a stretch, and one row a stretch carries them on, so a long
    connection is many groups. seq is unique in a connection; of equal ones, each waits for the other.
    """
    cut = frames.withColumn("stretch", F.floor(F.col("seq") / span))
    within = Window.partitionBy("conn", "stretch").orderBy("seq")
    before = Window.partitionBy("conn").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy("conn", "stretch").agg(F.max("ready").alias("latest")).withColumn("carried", F.max("latest").over(before)).select(F.col("conn").alias("c"), F.col("stretch").alias("s"), "carried")
    own = cut.withColumn("own", F.max("ready").over(within))
    joined = own.join(carried, F.col("conn").eqNullSafe(F.col("c")) & F.col("stretch").eqNullSafe(F.col("s")))
    return joined.select(*frames.columns, F.greatest("own", "carried").alias("released"))


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state, first: int, wait_ms: int) -> Iterator[pd.DataFrame]:
    """Emits a connection's rows as far as their seqs are complete. A gap that isn't closed within wait_ms of event time is given up."""
    following, held = (first, {}) if not state.exists else (state.get[0], {s: (r, v) for s, r, v in zip(*state.get[1:])})
    out = []

    def let_go(seq: int, late: bool) -> None:
        ready, verdict = held.pop(seq)
        out.append((key[0], seq, ready, verdict, late))

    for batch in batches:
        for seq, ready, verdict in zip(batch["seq"].tolist(), batch["ready"].tolist(), batch["verdict"].tolist()):
            if seq not in held:  # of repeated rows, the first counts
                held[seq] = (ready, verdict)
    for seq in sorted(s for s in held if s < following):  # its place has been given up, or it has gone
        let_go(seq, True)
    if state.hasTimedOut and held:
        following = min(held)
    while following in held:
        let_go(following, False)
        following += 1
    seqs = sorted(held)
    state.update((following, seqs, [held[s][0] for s in seqs], [held[s][1] for s in seqs]))
    if held:
        oldest = min(int(held[s][0].timestamp() * 1000) for s in seqs)
        state.setTimeoutTimestamp(max(oldest + wait_ms, state.getCurrentWatermarkMs() + 1))
    if out:
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RELEASED.split(", ")])


def in_order(frames: DataFrame, first: int = 1, seconds: int = 120) -> DataFrame:
    """A stream of frames (conn, seq, ready, verdict) as (conn, seq, ready, verdict, late), each connection's by seq without gaps from first on.

    Rows that overtake others are held as state until what is missing before them has come, or until the watermark is
    seconds past the oldest of them; then the gap is given up, so a lost frame stops nobody for good. What comes for
    a place that was given up or has gone is let through as late. Rows without conn, seq or ready time have no place in any order and
    are left out. State is a number a connection and the rows held.
    """
    known = frames.where("conn is not null and seq is not null and ready is not null").withWatermark("ready", f"{seconds} seconds")
    rows = known.select("conn", F.col("seq").cast("long").alias("seq"), "ready", "verdict")
    return rows.groupBy("conn").applyInPandasWithState(lambda key, batches, state: _advance(key, batches, state, first, seconds * 1000), RELEASED, STATE, "append", "EventTimeTimeout")


def delivered(rows: DataFrame) -> DataFrame:
    """Of frames in order, those that may go on: infected ones are dropped."""
    return rows.where("verdict is null or verdict <> 'infected'")
