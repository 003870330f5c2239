"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from undertext.functions.lexicon import FAMILIES, GATE, INVISIBLE, LINE_ENDS, SPACES, dialect, escaped

LINE = rf"\r\n|[{escaped(LINE_ENDS, False)}]"


def decoded(content: Column) -> Column:
    """UTF-8 bytes as text: what is malformed is replaced, one leading byte order mark goes."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"^﻿", "")


def lines(text: Column) -> Column:
    """The lines of a text; an ending boundary starts no further line, and empty text has none."""
    parts = F.split(text, LINE, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def family(text: Column, name: str) -> Column:
    return text.rlike(dialect(FAMILIES[name], True))


def is_adversarial(text: Column) -> Column:
    """Whether the wording addresses a machine reader. Blank and null text does not: every pattern needs letters."""
    alone = family(text, "identity") | family(text, "conditional") | family(text, "in_your") | family(text, "jailbreak") | family(text, "hebrew")
    pairs = (family(text, "override") & family(text, "meta")) | (family(text, "directive") & family(text, "target"))
    return F.coalesce(text.rlike(dialect(GATE, True)) & (alone | pairs), F.lit(False))


def display_name(text: Column) -> Column:
    """text without invisible code points."""
    return F.regexp_replace(text, f"[{escaped(INVISIBLE, False)}]", "")


def shown(text: Column) -> Column:
    """text without invisible code points, trimmed."""
    return trimmed(display_name(text))
