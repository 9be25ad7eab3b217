"""Split membership, required lookups and hash splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def membership_by_priority(membership: DataFrame) -> DataFrame:
    """One part per (source, id): that of the smallest priority."""
    return membership.groupBy("source", "pdb").agg(F.min_by("split", "priority").alias("split"))


def assign_splits(ids: DataFrame, membership: DataFrame, sources: Sequence[str]) -> DataFrame:
    """One column per source; ids in none of its lists stay NULL."""
    wide = (
        membership_by_priority(membership)
        .groupBy("pdb")
        .agg(*[F.max(F.when(F.col("source") == s, F.col("split"))).alias(s) for s in sources])
    )
    return ids.join(wide, "pdb", "left")


def required_lookup(rows: DataFrame, table: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left join that fails the job when a key has no match."""
    known = table.select(key, *columns, F.lit(True).alias("_found"))
    message = F.concat(F.lit(f"missing {key} "), F.col(key).cast("string"))
    checked = F.when(F.col("_found").isNull(), F.raise_error(message).cast("boolean")).otherwise(True)
    return rows.join(known, key, "left").where(checked).drop("_found")


def missing_keys(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return rows.select(key).distinct().join(table.select(key), key, "left_anti")


def members_of(rows: DataFrame, ids: DataFrame, key: str = "pdb") -> DataFrame:
    return rows.join(ids.select(key), key, "left_semi")


def without_ids(
    rows: DataFrame, remove: DataFrame, keep: DataFrame | None = None, key: str = "pdb"
) -> DataFrame:
    """Rows whose key is not removed; ids in ``keep`` are never removed."""
    gone = remove.select(key)
    if keep is not None:
        gone = gone.join(keep.select(key), key, "left_anti")
    return rows.join(gone, key, "left_anti")


def hash_percent(key: Column, seed: int = 42) -> Column:
    """Stable bucket 0-99 of an id: the same on every run and engine."""
    digest = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8)
    return F.conv(digest, 16, 10).cast("long") % 100


def hash_split(key: Column, train_frac: float = 0.8, seed: int = 42) -> Column:
    """Whole percents pick buckets; any finer share is taken of the last bucket by the rest of the hash."""
    whole = int(train_frac * 100 + 1e-9)
    rest = train_frac * 100 - whole
    bucket = hash_percent(key, seed)
    chosen = bucket < whole
    if rest > 1e-9:
        finer = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 9, 8), 16, 10).cast("long")
        chosen = chosen | ((bucket == whole) & (finer < F.lit(int(rest * 2**32))))
    return F.when(chosen, "train").otherwise("test")
