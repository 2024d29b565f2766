"""Rule checks as violation frames: no rows means the data is valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def violations(df: DataFrame, keys: list, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(keys..., field, rule) for every broken rule; all rules in one pass.

    A condition that is null counts as kept.
    """
    found = [
        F.when(broken, F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule")))
        for field, rule, broken in rules
    ]
    return df.select(*keys, F.inline(F.array_compact(F.array(*found))))


def check_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def check_distribution(df: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """Differences between actual and expected (``key``, ``n``) counts, both ways."""
    actual = df.groupBy(F.col(column).cast("string").alias("key")).agg(F.count("*").alias("actual"))
    wanted = expected.select(F.col("key").cast("string").alias("key"), F.col("n").cast("long").alias("expected"))
    joined = actual.join(wanted, "key", "full_outer")
    return joined.filter(~F.col("actual").eqNullSafe(F.col("expected")))


def check_set(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """One-column set comparison: value, side ('unexpected' or 'missing')."""
    a = actual.toDF("value").distinct()
    e = expected.toDF("value").distinct()
    extra = a.join(e, "value", "left_anti").select("value", F.lit("unexpected").alias("side"))
    return extra.unionByName(e.join(a, "value", "left_anti").select("value", F.lit("missing").alias("side")))


def check_totals(actual: DataFrame, expected: dict[str, int]) -> DataFrame:
    """One-row totals against expected numbers: name, actual, expected of every mismatch."""
    rows = F.array(*[
        F.struct(F.lit(k).alias("name"), F.col(k).cast("long").alias("actual"), F.lit(v).cast("long").alias("expected"))
        for k, v in expected.items()
    ])
    return actual.select(F.inline(rows)).filter(~F.col("actual").eqNullSafe(F.col("expected")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One row holding the columns of several one-row frames.

    Rows are stacked with nulls and folded by an aggregate, so no join is involved.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


class RuleViolation(ValueError):
    """Raised by publishing jobs when a violation frame is not empty."""


def require_empty(df: DataFrame, what: str) -> None:
    sample = df.limit(5).collect()
    if sample:
        raise RuleViolation(f"{what}: {[r.asDict() for r in sample]}")
