"""Small value functions: percentages, ranks, ordering keys, typed coercion."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def percent(part: Column, total: Column) -> Column:
    """Share of ``total`` in percent, two decimals, ties to even; 0 for no total."""
    share = F.bround(part * F.lit(100.0) / F.nullif(total, F.lit(0)), 2)
    return F.coalesce(share, F.lit(0.0))


def code_order(code: Column) -> list[Column]:
    """Sort keys: numeric codes first and by value, the others by text."""
    numeric = code.rlike("^[0-9]+$")
    return [F.when(numeric, 0).otherwise(1), F.when(numeric, code.cast("decimal(38,0)")), code]


def priority_rank(raw: Column) -> Column:
    """Rank of a raw JSON value: integers and digit strings count, the rest is 99."""
    digits = F.regexp_extract(raw, r'^"?(-?[0-9]+)"?$', 1)
    signed_text = raw.startswith('"-')
    return F.coalesce(F.when(~signed_text, digits.try_cast("int")), F.lit(99))


def mime_essence(header: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(header, F.lit("")), ";", 1)))


def coerce_value(raw: Column, kind: T.DataType) -> Column:
    """Catalog text to its column type: ISO time as UTC, ISO date by its first ten."""
    if isinstance(kind, T.TimestampType):
        zoned = raw.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
        return F.try_to_timestamp(F.when(zoned, raw).otherwise(F.concat(raw, F.lit("Z"))))
    if isinstance(kind, T.DateType):
        return F.substring(raw, 1, 10).try_cast("date")
    return raw.cast(kind)


def coerce_list(values: Column) -> Column:
    """Compact JSON text of a list, as the flat tables store it."""
    return F.to_json(values)


def same_value(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def is_blank(col: Column) -> Column:
    return col.isNull() | (F.trim(col) == "")
