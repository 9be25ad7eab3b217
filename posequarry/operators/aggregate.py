"""Pose rows to one row (or one per cluster) per complex."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posequarry.functions import text
from posequarry.functions.terms import quoted
from posequarry.operators.ordering import first_per_key, n_smallest

KEY = "pdb"
ORDER = "row_idx"


def keep_refined_perturbed(poses: DataFrame) -> DataFrame:
    """Runs whose label has both words "relax" and "perturb"."""
    return poses.where(text.has_words(F.col("type"), "relax", "perturb"))


def keep_non_positive(poses: DataFrame) -> DataFrame:
    return poses.where((F.col("total_score") <= 0) & (F.col("idelta_score") <= 0))


def join_affinity(poses: DataFrame, affinity: DataFrame, allow_fanout: bool = False) -> DataFrame:
    """Inner join on the complex id.

    The affinity side is reduced to one row per id unless a fan-out is asked
    for.  No hint is given: Spark broadcasts it while it is under the size
    threshold and otherwise sorts and splits skewed partitions.
    """
    if not allow_fanout:
        first = [c for c in affinity.columns if c != KEY]
        affinity = first_per_key(affinity, [KEY], [F.col(c).asc_nulls_last() for c in first])
    return poses.join(affinity, KEY)


def lowest_pose(poses: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Whole row of the lowest score; the earlier row wins ties."""
    scored = poses.where(F.col(score).isNotNull())
    return first_per_key(scored, keys, [F.col(score).asc(), F.col(ORDER).asc()])


def aggregate_per_pdb(
    poses: DataFrame,
    score_col: str = "idelta_score",
    strategy: str = "min",
    n: int = 10,
    extra_cols: Sequence[str] | None = None,
    cluster_members: DataFrame | None = None,
) -> DataFrame:
    """Score and extra columns per complex, with a ``sample_weight``.

    ``min`` takes the row of the lowest score, ``mean_n`` the mean of the ``n``
    lowest rows, ``filtered_mean`` the mean of all rows, ``clustered`` one row
    per cluster (that of its representative).
    """
    cols = [score_col, *(extra_cols or [])]
    means = [F.avg(quoted(c).cast("double")).alias(c) for c in cols]
    if strategy == "min":
        rows = lowest_pose(poses.select(KEY, ORDER, *map(quoted, cols)), [KEY], score_col)
        rows = rows.select(KEY, *map(quoted, cols))
    elif strategy == "mean_n":
        order = [F.col(score_col).asc_nulls_last(), F.col(ORDER).asc()]
        rows = n_smallest(poses.select(KEY, ORDER, *map(quoted, cols)), [KEY], order, n)
        rows = rows.groupBy(KEY).agg(*means)
    elif strategy == "filtered_mean":
        rows = poses.groupBy(KEY).agg(*means)
    elif strategy == "clustered":
        if cluster_members is None:
            raise ValueError("strategy 'clustered' needs cluster_members")
        reps = cluster_members.where("is_rep").select(KEY, ORDER)
        rows = poses.join(reps, [KEY, ORDER]).select(KEY, *map(quoted, cols))
    else:
        raise ValueError(f"unknown aggregation strategy: {strategy!r}")
    return rows.withColumn("sample_weight", F.lit(1.0))


def join_kd_columns(
    per_pdb: DataFrame, source: DataFrame, merge_cols: Sequence[str] = ("log_kd",)
) -> DataFrame:
    """Bring per-complex columns back; complexes missing any of them are dropped."""
    merge_cols = list(merge_cols)
    order = [F.col(ORDER)] if ORDER in source.columns else []
    order += [F.col(c).asc_nulls_last() for c in merge_cols]
    wanted = source.select(KEY, *([ORDER] if ORDER in source.columns else []), *merge_cols)
    once = first_per_key(wanted, [KEY], order).select(KEY, *merge_cols)
    return per_pdb.join(once.dropna(subset=merge_cols), KEY)


def collapse_weighted(
    rows: DataFrame, feature_cols: Sequence[str], order: str, target: str = "log_kd"
) -> DataFrame:
    """Weighted mean of several rows per complex.

    With a zero weight sum the first row (by ``order``) stands for the complex.
    Every aggregate buffer is numeric, so this stays a partial hash aggregate.
    """
    weight = F.col("sample_weight")
    total = F.sum(weight)
    features = [
        F.when(total == 0, F.min_by(quoted(c), order))
        .otherwise(F.sum(weight * quoted(c)) / total)
        .alias(c)
        for c in feature_cols
    ]
    return rows.groupBy(KEY).agg(*features, F.min_by(target, order).alias(target))
