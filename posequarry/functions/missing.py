"""Missing values: NaN becomes NULL at ingest, and predicates say what NULL means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every float and double column.

    Spark sorts NaN above all numbers and lets it through ``>=``; aggregates skip
    only NULL.  One projection at ingest makes both behave as "missing".
    """
    fixed = [
        F.when(~F.isnan(F.col(f"`{name}`")), F.col(f"`{name}`")).alias(name)
        if kind in ("float", "double")
        else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ]
    return df.select(*fixed)


def holds(keep: Column) -> Column:
    """Predicate as a plain boolean: a missing operand means "does not hold"."""
    return F.coalesce(keep, F.lit(False))


def fails(keep: Column) -> Column:
    """Rows a keep-predicate removes, those with missing operands included."""
    return ~holds(keep)


def differs(column: Column, value: object) -> Column:
    """``column != value`` where a missing column counts as different."""
    return ~column.eqNullSafe(F.lit(value))
