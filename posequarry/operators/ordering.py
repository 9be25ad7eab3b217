"""Order-dependent operators without a single-task sort of a large group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from posequarry.operators.skew import ROWS_PER_SLICE, hot_keys, hot_limit, row_hash, with_hot

SALTS = 64
# A hot key is cut into CUTS ** 2 blocks at quantiles of its order.
CUTS = 24


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Running sum of ``value`` per key in ``order``; the first order column is numeric.

    A window sorts a whole key in one task.  Keys too large for that (found by a
    count) are cut into blocks at approximate quantiles of their order column, so
    that one far value does not leave all others in one block; block sums are
    pre-aggregated, added up over the few blocks of the key, and joined to the
    running sums inside the blocks. Missing keys and orders are values like others.
    """
    keys = list(keys)
    limit = hot_limit(df, keys, rows_per_slice)
    if limit is None:
        return df.withColumn(name, F.sum(value).over(_so_far(keys, order)))
    first = F.col(order[0]).cast("double")
    # Cuts in CUTS groups, so that a row looks through one group and their heads.
    shares = [i / CUTS**2 for i in range(1, CUTS**2 + 1)]
    hot = hot_keys(df, keys, limit)
    cuts = (
        with_hot(df, hot, keys)
        .where("_slices IS NOT NULL")
        .groupBy(*keys)
        .agg(F.percentile_approx(first, shares, 20 * CUTS**2).alias("_cuts"))
    )
    heads = F.transform(F.sequence(F.lit(1), F.lit(CUTS)), lambda i: F.get("_cuts", i * CUTS - 1))
    group = F.least(F.size(F.filter(heads, lambda c: c < first)), F.lit(CUTS - 1))
    near = F.slice("_cuts", group * CUTS + 1, F.lit(CUTS))
    # Missing orders come first in a window, so they are the lowest block of a hot key.
    block = F.when(F.col("_cuts").isNull(), -2).when(first.isNull(), -1).otherwise(
        group * CUTS + F.size(F.filter(near, lambda c: c < first))
    )
    rows = with_hot(df, cuts, keys).withColumn("_block", block).drop("_cuts")
    sums = rows.where("_block >= -1").groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sums.select(*keys, F.col("_block").alias("_of"), F.sum("_sum").over(earlier).alias("_before"))
    inside = F.sum(value).over(_so_far([*keys, "_block"], order))
    offsets = offsets.withColumnsRenamed({k: f"_hot_{k}" for k in keys})
    same = F.col("_block") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
    # Offsets: at most CUTS ** 2 + 2 rows for each of MAX_HOT_KEYS keys; Spark checks their size.
    total = F.coalesce(F.col(name) + F.col("_before"), F.col(name), F.col("_before"))
    return (
        rows.withColumn(name, inside)
        .join(offsets, same, "left")
        .withColumn(name, total)
        .drop("_block", "_of", "_before", *[f"_hot_{k}" for k in keys])
    )


def _so_far(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )


def sequence_ids(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "type_seq_id",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Zero-based position of each row inside its key, in ``order``."""
    numbered = running_total(df, keys, order, F.lit(1), name, rows_per_slice)
    return numbered.withColumn(name, F.col(name) - 1)


def n_smallest(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int = 1,
    rank: str | None = None,
) -> DataFrame:
    """First ``n`` rows per key.

    Catalyst prunes each map task to ``n`` rows per key before the shuffle
    (window group limit); above that rule's threshold the same is done by hand
    with a salted first stage.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    name = rank or "_rank"
    if n > threshold:
        salt = F.pmod(row_hash(df), F.lit(SALTS))
        part = Window.partitionBy(*keys, salt).orderBy(*order)
        df = df.withColumn("_part_rank", F.row_number().over(part))
        df = df.where(F.col("_part_rank") <= n).drop("_part_rank")
    whole = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(whole)).where(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key; the order makes "first" a fact of the data."""
    return n_smallest(df, keys, order, 1)
