"""Texts of nested values that do not depend on the order of keys, fields or rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)


def ordered(value: Column, kind: DataType) -> Column:
    """value with the keys of its maps and the fields of its structs in order, at all depths. Arrays keep their order."""
    if isinstance(kind, StructType):
        fields = [ordered(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: ordered(x, kind.elementType))
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), ordered(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, _by_key))
    return value


def stable(value: Column, kind: DataType) -> Column:
    """value of a nested kind as JSON with ordered keys; nulls inside are shown, and a null value is the text null."""
    return F.coalesce(F.to_json(ordered(value, kind), {"ignoreNullFields": "false"}), F.lit("null"))


def in_order(texts: Column) -> Column:
    """An array of texts, sorted, a line each."""
    return F.array_join(F.array_sort(texts), "\n")
