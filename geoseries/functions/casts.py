"""Typed casts that say why a value was refused.

A checked cast is a struct of the value and a reason.  ``reason`` is NULL where
the cast held (or the text is missing and may be); otherwise the value is NULL
and the reason one of ``REASONS``, so a caller can raise, count or set the row
aside instead of losing it unseen.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_ws

REASONS = ("missing", "not_a_timestamp", "not_a_number", "not_whole", "not_finite", "out_of_range")
WHOLE = {"tinyint", "smallint", "int", "bigint"}
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NOT_FINITE = r"(?i)^[+-]?(nan|inf|infinity)$"


def _checked(text: Column, value: Column, good: Column, detail: Column, required: bool) -> Column:
    """The reason is worked out where the cast failed only, and not at all where nobody reads it."""
    missing = text.isNull() | (text == "")
    why = F.when(missing, F.lit("missing" if required else None)).when(~good, detail)
    return F.struct(F.when(good, value).alias("value"), why.cast("string").alias("reason"), text.alias("text"))


def checked_timestamp(name: str, required: bool = False) -> Column:
    """Text -> TIMESTAMP_NTZ, checked."""
    text = strip_ws(F.col(f"`{name}`"))
    value = text.try_cast("timestamp_ntz")
    return _checked(text, value, value.isNotNull(), F.lit("not_a_timestamp"), required)


def checked_number(name: str, to: str, required: bool = False) -> Column:
    """Text with ``,`` thousands separators -> number of type ``to``, checked.
    A whole type takes no fraction; NaN and infinities are refused."""
    text = strip_ws(F.col(f"`{name}`"))
    digits = F.replace(text, F.lit(","), F.lit(""))
    value = digits.try_cast(to)
    good = value.isNotNull()
    detail = F.when(digits.rlike(NOT_FINITE), F.lit("not_finite")).when(~digits.rlike(NUMBER), F.lit("not_a_number"))
    if to in WHOLE:
        wide = digits.try_cast("double")
        detail = detail.when(wide != F.rint(wide), F.lit("not_whole"))
    else:
        good = good & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return _checked(text, value, F.coalesce(good, F.lit(False)), detail.otherwise(F.lit("out_of_range")), required)


def rejects_of(checked: Mapping[str, Column]) -> Column:
    """array<struct<column, reason, text>> of the refused casts of a row, in the given order."""
    each = [F.when(c["reason"].isNotNull(), F.struct(F.lit(name).alias("column"), c["reason"].alias("reason"), c["text"].alias("text")))
            for name, c in checked.items()]
    return F.array_compact(F.array(*each))
