"""Counts of classes, held against all classes that there should be."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid(rows: DataFrame, expected: dict[str, tuple[str, ...]]) -> DataFrame:
    """rows counted by the columns of expected, by each subset of these, and in all: the columns, level, n and expected.

    level has a bit for each column that a count sums over, the last column's lowest, whose value is then null. Cells
    of the expected values that no row falls into have n 0; cells of other values, null among them, are not expected.
    """
    columns = list(expected)
    counted = rows.select(*columns).cube(*columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))
    cells = [(*cell, sum((v is None) << i for i, v in enumerate(reversed(cell)))) for cell in product(*[(*v, None) for v in expected.values()])]
    wanted = rows.sparkSession.createDataFrame(cells, ", ".join(f"w_{c} string" for c in columns) + ", w_level long")
    same = F.col("level") == F.col("w_level")
    for c in columns:
        same &= F.col(c).eqNullSafe(F.col(f"w_{c}"))
    both = counted.join(wanted, same, "full")
    return both.select(*[F.coalesce(c, f"w_{c}").alias(c) for c in columns], F.coalesce("level", "w_level").alias("level"), F.coalesce("n", F.lit(0)).alias("n"), F.col("w_level").isNotNull().alias("expected"))
