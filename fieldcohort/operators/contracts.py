"""Contracts on tables: uniqueness, required columns, versions, counts, sets of keys.

A contract that fails raises ContractError; one that holds returns the table, so that calls can be chained.  Each is a
small aggregate; examples are limited before they reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXAMPLES = 5


class ContractError(ValueError):
    """A table breaks a contract."""


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_columns(df: DataFrame, columns: Iterable[str], label: str = "table") -> DataFrame:
    """All ``columns`` are there."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"{label} lacks columns: {missing}")
    return df


def require_unique(df: DataFrame, key: str, label: str = "table") -> DataFrame:
    """``key`` exists and no value of it repeats; one NULL is tolerated, two are not."""
    require_columns(df, [key], label)
    found = [r[0] for r in duplicate_keys(df, key).orderBy(key).limit(EXAMPLES).collect()]
    if found:
        raise ContractError(f"{label} has repeated {key}: {found}")
    return df


def distinct_versions(df: DataFrame, column: str) -> DataFrame:
    """The distinct trimmed values of a version column that are not null."""
    return df.select(F.trim(F.col(column).cast("string")).alias(column)).where(F.col(column).isNotNull()).distinct()


def require_version(df: DataFrame, column: str, expected: str, label: str = "table") -> DataFrame:
    """The version column holds ``expected`` and nothing else."""
    require_columns(df, [column], label)
    found = sorted(r[0] for r in distinct_versions(df, column).limit(EXAMPLES).collect())
    if found != [expected]:
        raise ContractError(f"{label} has {column} {found}, not {expected}")
    return df


def require_all(df: DataFrame, predicate: Column, label: str) -> DataFrame:
    """``predicate`` holds for every row; NULL counts as false."""
    row = df.agg(F.count_if(~F.coalesce(predicate, F.lit(False))).alias("n")).first()
    if row["n"]:
        raise ContractError(f"{label}: {row['n']} rows fail")
    return df


def require_count(df: DataFrame, expected: int, label: str = "rows") -> DataFrame:
    """The table has ``expected`` rows."""
    found = df.count()
    if found != expected:
        raise ContractError(f"expected {expected} {label}, found {found}")
    return df


def require_same_keys(a: DataFrame, b: DataFrame, key: str, label: str = "tables") -> None:
    """Both tables have the same set of keys."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    differ = left.join(right, key, "left_anti").unionByName(right.join(left, key, "left_anti"))
    found = [r[0] for r in differ.orderBy(key).limit(EXAMPLES).collect()]
    if found:
        raise ContractError(f"{label} differ in {key}: {found}")


def select_exact(df: DataFrame, selection: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key is in ``selection``, compared as text; every selected key must be there, once."""
    wanted = selection.select(F.col(key).cast("string").alias("__key")).distinct()
    have = df.withColumn("__key", F.col(key).cast("string"))
    missing = [r[0] for r in wanted.join(have, "__key", "left_anti").orderBy("__key").limit(EXAMPLES).collect()]
    if missing:
        raise ContractError(f"selected {key} not found: {missing}")
    got = have.join(wanted, "__key", "left_semi")
    if got.count() != wanted.count():
        raise ContractError(f"selected {key} are not unique")
    return got.drop("__key")
