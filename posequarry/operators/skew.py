"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# At most this many keys can be called hot, whatever the data looks like: a hot
# key owns more than 1/MAX_HOT_KEYS of all rows.  That bounds every broadcast.
MAX_HOT_KEYS = 10_000
ROWS_PER_SLICE = 2_000_000


def hot_limit(df: DataFrame, keys: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE) -> float | None:
    """Row count above which a key is hot, or None when no key is.

    One job over the key columns: counts are combined map-side, and a single row
    (largest count, total) comes back.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    limit = max(float(rows_per_slice), (row["total"] or 0) / MAX_HOT_KEYS)
    return limit if (row["largest"] or 0) > limit else None


def hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    limit: float,
    screen: Sequence[str] | None = None,
) -> DataFrame:
    """Keys with more than ``limit`` rows and the slices each should get.

    At most ``MAX_HOT_KEYS`` rows.  With ``screen``, a coarser part of the keys,
    fine keys are counted only inside coarse ones that are hot already.
    """
    if screen:
        coarse = df.groupBy(*screen).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
        df = with_hot(df, coarse, list(screen)).where("_n IS NOT NULL").drop("_n")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    slices = F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_slices")
    return counts.where(F.col("_n") > limit).withColumn("_slices", slices).drop("_n")


def with_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of their hot key, null where there is none; a null key can be hot too."""
    named = F.broadcast(hot.withColumnsRenamed({k: f"_hot_{k}" for k in keys}))
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
    return df.join(named, condition, "left").drop(*[f"_hot_{k}" for k in keys])


def row_hash(df: DataFrame) -> Column:
    """Stable hash of a row (maps cannot be hashed and are left out)."""
    return F.xxhash64(*[F.col(f"`{name}`") for name, kind in df.dtypes if "map<" not in kind])


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    condition: Column | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
    screen: Sequence[str] | None = None,
    strategy: str | None = None,
) -> DataFrame:
    """Equi-join in which hot keys of ``left`` are cut into slices.

    Each left row goes to one slice; the right rows of a hot key are repeated
    once per slice.  Works for inner, left, left_semi and left_anti joins, since
    every left row still meets every right row of its key exactly once.  Without
    hot keys (checked by a count, on the ``screen`` part of the keys if given)
    it is the plain join.  ``condition`` may use columns of both sides; right
    columns other than the keys must then have names of their own. ``strategy`` is the join hint for a right
    side whose size Spark misjudges.
    """
    keys = list(keys)
    limit = hot_limit(left, screen or keys, rows_per_slice)
    if limit is None:
        return _join(left, right, keys, how, condition, strategy)
    hot = hot_keys(left, keys, limit, screen)
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    cut_left = (
        with_hot(left, hot, keys)
        .withColumn("_salt", F.pmod(row_hash(left), slices).cast("int"))
        .select(*[F.col(f"`{c}`") for c in left.columns], "_salt")
    )
    spread_right = (
        with_hot(right, hot, keys)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop("_slices")
    )
    return _join(cut_left, spread_right, [*keys, "_salt"], how, condition, strategy).drop("_salt")


def _join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, condition: Column | None, strategy: str | None = None
) -> DataFrame:
    right = right.hint(strategy) if strategy else right
    if condition is None:
        return left.join(right, keys, how)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])
