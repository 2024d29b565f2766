"""Compute-once columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters reuse instead of repeating.

    A plain projection lets the optimizer push a filter below it, copying the whole
    expression into every reference.  A one-row ``inline`` keeps the value computed once
    and still compiles into the surrounding stage.
    """
    kept = [c for c in df.columns if c not in columns]
    fresh = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[F.col(f"`{c}`") for c in kept], fresh)
