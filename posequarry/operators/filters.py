"""Named row filters and their reports, each in one pass over the table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posequarry.fixed_values import CARVED_TRAIN_SHARE
from posequarry.functions.missing import differs, fails, holds

Filters = Mapping[str, Column]


def feature_filters() -> dict[str, Column]:
    """Keep-predicates of the feature table, in reporting order."""
    return {
        "affinity_type": differs(F.col("affinity_type"), "IC50"),
        "vague_measures": ~F.col("vague_measures"),
        "covalent": ~F.col("covalent"),
        "fully_relaxed": F.col("fully_relaxed"),
        "qed": F.col("qed") >= 0.2,
        "has_rare_elem": ~F.col("has_rare_element"),
        "rmsd_RelToCry": F.col("rmsd_relax_to_crystal") <= 4.0,
        "relax_idelta": F.col("relax_idelta_score") >= -100000,
    }


def apply_filters(df: DataFrame, filters: Filters, names: Sequence[str] | None = None) -> DataFrame:
    """Rows that pass the chosen filters (all by default)."""
    chosen = [holds(filters[n]) for n in (names or filters)]
    return df.where(reduce(lambda a, b: a & b, chosen))


def filter_impact(df: DataFrame, filters: Filters) -> DataFrame:
    """(filter, removed) for each filter on its own, ascending."""
    counts = df.agg(*[F.count_if(fails(p)).alias(n) for n, p in filters.items()])
    position = {n: i for i, n in enumerate(filters)}
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("filter"), F.lit(position[n]).alias("position"), F.col(n).alias("removed"))
            for n in filters
        ]
    )
    return counts.select(F.inline(rows)).orderBy("removed", "position")


def filter_waterfall(df: DataFrame, filters: Filters, order: Sequence[str]) -> DataFrame:
    """(step, filter, remaining, removed) when filters apply one after another.

    All prefix conjunctions are counted in one aggregate, so the table is read
    once however many filters there are.
    """
    passed = [holds(filters[n]) for n in order]
    prefixes = [reduce(lambda a, b: a & b, passed[: i + 1]) for i in range(len(order))]
    counts = df.agg(
        F.count(F.lit(1)).alias("_0"),
        *[F.count_if(p).alias(f"_{i}") for i, p in enumerate(prefixes, start=1)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("step"),
                F.lit(n).alias("filter"),
                F.col(f"_{i}").alias("remaining"),
                (F.col(f"_{i - 1}") - F.col(f"_{i}")).alias("removed"),
            )
            for i, n in enumerate(order, start=1)
        ]
    )
    return counts.select(F.inline(rows))


def waterfall_by_impact(df: DataFrame, filters: Filters) -> DataFrame:
    """Waterfall in ascending order of each filter's own impact.

    The order is a handful of counters, read back to the driver.
    """
    order = [r["filter"] for r in filter_impact(df, filters).collect()]
    return filter_waterfall(df, filters, order)


def removal_overlap(df: DataFrame, filters: Filters) -> DataFrame:
    """(filter_a, filter_b, both_removed) for all pairs, from one aggregate."""
    names = list(filters)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    counts = df.agg(
        *[
            F.count_if(fails(filters[a]) & fails(filters[b])).alias(f"_{k}")
            for k, (a, b) in enumerate(pairs)
        ]
    )
    cells = [
        F.struct(F.lit(x).alias("filter_a"), F.lit(y).alias("filter_b"), F.col(f"_{k}").alias("both_removed"))
        for k, (a, b) in enumerate(pairs)
        for x, y in {(a, b), (b, a)}
    ]
    return counts.select(F.inline(F.array(*cells)))


def first_reason(reasons: Mapping[str, Column], kept: str = "kept") -> Column:
    """Name of the first removal condition that holds."""
    items = list(reasons.items())
    expr = F.when(holds(items[0][1]), F.lit(items[0][0]))
    for name, condition in items[1:]:
        expr = expr.when(holds(condition), F.lit(name))
    return expr.otherwise(F.lit(kept))


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of non-missing values, largest first."""
    present = df.where(F.col(column).isNotNull())
    return present.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def split_sizes(
    df: DataFrame,
    split_columns: Sequence[str],
    carved: str | None = None,
    test_condition: Column | None = None,
) -> DataFrame:
    """Rows per (split column, part).

    ``carved`` names a split without a validation part: 10 % of its train rows
    are reported as validation.  ``test_condition`` restricts the test counts.
    """
    on_test = F.lit(True) if test_condition is None else test_condition
    pairs = F.array(
        *[F.struct(F.lit(c).alias("split"), F.col(c).alias("part")) for c in split_columns]
    )
    long = df.select(on_test.alias("_test_ok"), F.inline(pairs))
    long = long.where(F.col("part").isin("train", "val", "test"))
    wide = long.groupBy("split").agg(
        F.count_if(F.col("part") == "train").alias("train"),
        F.count_if(F.col("part") == "val").alias("val"),
        F.count_if((F.col("part") == "test") & F.col("_test_ok")).alias("test"),
    )
    if carved is None:
        return wide
    share = F.lit(CARVED_TRAIN_SHARE)
    is_carved = F.col("split") == carved
    return wide.select(
        "split",
        F.when(is_carved, (F.col("train") * share).cast("long")).otherwise(F.col("train")).alias("train"),
        F.when(is_carved, (F.col("train") * F.lit(1 - CARVED_TRAIN_SHARE)).cast("long"))
        .otherwise(F.col("val"))
        .alias("val"),
        "test",
    )
