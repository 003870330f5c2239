"""Rounding and colours as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_up(value: Column, digits: int) -> Column:
    """value to so many digits; what lies half-way goes up, also below zero."""
    return F.floor(value * 10.0**digits + 0.5).cast("double") / 10.0**digits


def half_even(value: Column, digits: int) -> Column:
    """value to so many digits; what lies half-way goes to the even neighbour. Half-way is what the product with the power of ten, as a double, has."""
    scaled = value * 10.0**digits
    low = F.floor(scaled).cast("double")
    up = (scaled - low > 0.5) | ((scaled - low == 0.5) & (low % 2 != 0))
    return F.when(up, low + 1).otherwise(low) / 10.0**digits


def _channel(share: Column) -> Column:
    return half_up(share * 255, 0).cast("int")


def grey(level: Column) -> Column:
    """(r, g, b) of a level from 0 to 1."""
    return F.struct(*[_channel(level).alias(c) for c in "rgb"])


def cmyk(c: Column, m: Column, y: Column, k: Column) -> Column:
    """(r, g, b) of inks from 0 to 1, without a colour profile."""
    return F.struct(*[_channel(1 - F.least(F.lit(1.0), ink + k)).alias(name) for name, ink in zip("rgb", (c, m, y))])


def colour(kind: Column, v: Column) -> Column:
    """(r, g, b) of the numbers v of a paint operator: rgb (0 to 255), grey or cmyk; black where the operator is another or numbers are missing."""
    at = lambda i: F.get(v, F.lit(i))
    black = F.struct(*[F.lit(0).alias(c) for c in "rgb"])
    rgb = F.struct(*[at(i).cast("int").alias(c) for i, c in enumerate("rgb")])
    known = lambda n: F.size(F.filter(F.slice(v, 1, n), lambda x: x.isNotNull())) == n
    return F.when((kind == "rgb") & known(3), rgb).when((kind == "grey") & known(1), grey(at(0))).when((kind == "cmyk") & known(4), cmyk(at(0), at(1), at(2), at(3))).otherwise(black)


def luminance(rgb: Column) -> Column:
    return half_up(rgb["r"] * 0.299 + rgb["g"] * 0.587 + rgb["b"] * 0.114, 0).cast("int")


def line_colours(spans: DataFrame, line: tuple[str, ...], far: Column) -> DataFrame:
    """Of each line's spans (op_index, rgb): the colour of the first, and the least distance to two digits."""
    told = spans.withColumn("far", far).groupBy(*line).agg(F.min_by("rgb", "op_index").alias("fg"), F.min("far").alias("least"))
    return told.select(*line, "fg.r", "fg.g", "fg.b", half_up(F.col("least"), 2).alias("euclidean"))
