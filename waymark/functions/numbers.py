"""Lenient integers of the dumps' fields.  Empty and unreadable fields are 0.

The parser that results must agree with loses a leading minus sign; `signed=True` keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _read(text: Column, kind: str, signed: bool) -> Column:
    value = text.try_cast(kind)
    # The least value has no positive one of its width.
    value = value if signed else F.abs(value.cast("bigint")).try_cast(kind)
    return F.coalesce(value, F.lit(0).cast(kind))


def to_int32(text: Column, signed: bool = False) -> Column:
    return _read(text, "int", signed)


def to_int16(text: Column, signed: bool = False) -> Column:
    return _read(text, "smallint", signed)


def to_int8(text: Column) -> Column:
    return _read(text, "tinyint", True)


def to_uint32(text: Column) -> Column:
    """A long, as there is no unsigned int; any minus sign gives 0."""
    return F.when(F.instr(text, "-") > 0, F.lit(0).cast("bigint")).otherwise(_read(text, "bigint", True))


def to_float(text: Column) -> Column:
    """NaN where unreadable."""
    return F.coalesce(text.try_cast("float"), F.lit(float("nan")).cast("float"))
