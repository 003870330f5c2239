"""Attributes of word-processing runs, from the strings that files hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from undertext.functions.numbers import half_up
from undertext.functions.text import trimmed

# What means on, lengths in English Metric Units, and such units in a point.
ON = ("1", "true", "on")
UNITS = {"mm": 36000, "cm": 360000, "in": 914400, "pt": 12700, "pc": 152400, "pi": 152400}
IN_A_POINT = 12700
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def switched_on(present: Column, value: Column) -> Column:
    """Whether an element is on: without a value it is, else only by ON, whatever its case. Null where there is no element."""
    return F.when(present, F.when(value.isNull(), True).otherwise(value.isin(*ON)))


def points(value: Column) -> Column:
    """A size in points: whole half-points, or a number with a unit, by whole Metric Units; a unit alone is 0. Null for all else."""
    unit, quantity = F.right(value, F.lit(2)), trimmed(F.left(value, F.length(value) - 2))
    number = F.when(quantity == "", 0.0).when(quantity.rlike(NUMBER), quantity.cast("double"))
    factor = F.lit(None).cast("double")
    for name, units in UNITS.items():
        factor = F.when(unit == name, float(units)).otherwise(factor)
    return F.when(value.rlike("[mnp]"), half_up(number * factor, 0) / IN_A_POINT).when(value.rlike("^[0-9]+$"), value.cast("double") / 2)
