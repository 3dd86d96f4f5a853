"""Typed values: column types by name, coercion, colours and fonts as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import SPARK_TYPES, GraphError

_LIMITS = {T.IntegerType(): (-(2**31), 2**31 - 1), T.LongType(): (-(2**63), 2**63 - 1)}


def type_named(name: str) -> T.DataType:
    kind = SPARK_TYPES.get(name.strip().lower())
    if kind is None:
        raise GraphError(f"unknown column type: {name}")
    return kind


def type_of(value: object) -> T.DataType:
    """The type of a column made for a value."""
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.IntegerType() if -(2**31) <= value < 2**31 else T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    return T.StringType()


def coerce(text: Column, kind: T.DataType) -> Column:
    """Text as a value of a column's type: whole numbers are cut off and kept in range, only 'true' is true, what cannot be read is null."""
    if isinstance(kind, T.BooleanType):
        return F.lower(text) == "true"
    if isinstance(kind, T.IntegerType | T.LongType):
        low, high = _LIMITS[kind]
        number = F.expr("1D") * text.try_cast("double")
        whole = F.when(F.isnan(number), 0).otherwise(F.when(number >= float(high), F.lit(high)).when(number <= float(low), F.lit(low)).otherwise(F.when(F.abs(number) < 9e18, number).cast("long")))
        return whole.cast(kind)
    if isinstance(kind, T.StringType):
        return text
    return text.try_cast(kind)


def text_of(value: object) -> str | None:
    if value is None:
        return None
    return str(value).lower() if isinstance(value, bool) else str(value)


def colour(text: str) -> tuple[int, int, int]:
    m = re.fullmatch(r"#?([0-9a-fA-F]{2})([0-9a-fA-F]{2})([0-9a-fA-F]{2})", text.strip())
    if not m:
        raise GraphError(f"not a colour: {text}")
    return tuple(int(x, 16) for x in m.groups())


def check_colour(*channels: int) -> None:
    if any(c < 0 or c > 255 for c in channels):
        raise GraphError("colour channels go from 0 to 255")


def font(text: str) -> dict:
    """'Courier New 10 Bold': the name up to the first number, the size, the style."""
    m = re.match(r"\s*(.*?)\s*(?:(\d+)\s*(.*))?$", text)
    style = (m[3] or "").lower()
    return {"name": m[1] or "Arial", "size": int(m[2]) if m[2] else 12, "bold": "bold" in style, "italic": "italic" in style}
