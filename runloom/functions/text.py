"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whole numbers take surrounding blanks and a sign; floats take decimals and exponents.
# "inf", "nan" and digits grouped by "_" count as text.
INT_PATTERN = r"^\s*[+-]?[0-9]+\s*$"
FLOAT_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def as_int(value: Column) -> Column:
    """The whole number in a text, or NULL."""
    return F.when(value.rlike(INT_PATTERN), F.trim(value).try_cast("bigint"))


def as_float(value: Column) -> Column:
    """The number in a text, or NULL."""
    return F.when(value.rlike(FLOAT_PATTERN), F.trim(value).try_cast("double"))


def is_number(value: Column) -> Column:
    return value.rlike(FLOAT_PATTERN)


def value_kind(value: Column) -> Column:
    """int, float, bool or string, tried in this order; NULL stays NULL."""
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(as_int(value).isNotNull(), "int")
        .when(as_float(value).isNotNull(), "float")
        .when(value.isin("True", "False"), "bool")
        .otherwise("string")
    )


def comma_list(value: Column) -> Column:
    """The trimmed parts of a comma text; empty parts stay."""
    return F.transform(F.split(value, ","), lambda part: F.regexp_replace(part, r"^\s+|\s+$", ""))


def extension(name: Column) -> Column:
    """The extension with its dot, empty if there is none; leading dots are not extensions."""
    return F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]*)$", 1)


def base_name(path: Column) -> Column:
    """The last part of a path after ``.`` , ``..`` and doubled slashes are resolved."""
    empty = F.array().cast("array<string>")
    parts = F.aggregate(
        F.split(path, "/"),
        empty,
        lambda kept, part: F.when(part.isin("", "."), kept)
        .when((part == "..") & (F.size(kept) > 0), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(part))),
    )
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
