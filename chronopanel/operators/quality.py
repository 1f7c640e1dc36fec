"""Data-quality checks. Each gives violating rows, or counts in the form (check, n_failed) by ``summary``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_unique(df: DataFrame, col: str) -> DataFrame:
    return check_unique_combination(df.where(F.col(col).isNotNull()), [col])


def check_not_null(df: DataFrame, cols: list[str], where: Column | None = None) -> DataFrame:
    """(check, n_failed) for all columns in one pass."""
    cond = F.lit(True) if where is None else where
    row = df.agg(*[F.count_if(F.col(c).isNull() & cond).alias(f"_{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'not_null({c})', _{i}" for i, c in enumerate(cols))
    return row.selectExpr(f"stack({len(cols)}, {stack}) as (check, n_failed)")


def check_accepted_values(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(values)).groupBy(col).agg(F.count("*").alias("n"))


def check_relationship(df: DataFrame, col: str, to: DataFrame, field: str) -> DataFrame:
    """Rows whose value has no row in the other table."""
    keys = to.select(F.col(field).alias(col)).distinct()
    return df.where(F.col(col).isNotNull()).join(keys, col, "left_anti")


def check_range(df: DataFrame, col: str, low: float | None = None, high: float | None = None, where: Column | None = None) -> DataFrame:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(col) < low)
    if high is not None:
        bad = bad | (F.col(col) > high)
    return df.where(bad if where is None else bad & where)


def check_unique_combination(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")


def check_equal_rowcount(a: DataFrame, b: DataFrame) -> DataFrame:
    sides = a.agg(F.count("*").alias("rows_a")).crossJoin(b.agg(F.count("*").alias("rows_b")))  # one row each
    return sides.withColumn("equal", F.col("rows_a") == F.col("rows_b"))


def summary(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, n_failed) of named frames of violations."""
    parts = [df.agg(F.count("*").alias("n_failed")).select(F.lit(name).alias("check"), "n_failed") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, parts)
