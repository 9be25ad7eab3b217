"""Exact quantiles and box-plot summaries of very large columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posequarry.functions.terms import quoted

# Of the sketches, and values that may be left to be put in order.
ACCURACY, LIMIT = 20_000, 20_000
BRACKETS = "column_name string, first long, last long, low double, high double"


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value) rows of the chosen columns, missing values left out."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), quoted(c).cast("double").alias("value"))
            for c in columns
        ]
    )
    return df.select(F.inline(cells)).where(F.col("value").isNotNull())


def _cuts(accuracy: int) -> list[float]:
    """Shares at which a sketch is read: steps some times as wide as its error."""
    steps = max(8, accuracy // 20)
    return [i / steps for i in range(steps + 1)]


def _bracket(cuts: list[float], first: int, last: int, n: int, low: float, high: float) -> tuple[float, float]:
    """The cuts around two ranks among ``n`` values between low and high, a step further out on both sides."""
    steps = len(cuts) - 1
    below, above = first * steps // n - 1, -(-(last + 1) * steps // n) + 1
    return cuts[below] if below > 0 else low, cuts[above] if above < steps else high


def _brackets(long: DataFrame, ranks: list[tuple[str, int, int]], totals: dict, accuracy: int, limit: int) -> list[tuple]:
    """(column_name, first, last, low, high): the values of both ranks lie in [low, high], with few between.

    A sketch of a whole column gives the first bracket. Each further pass counts what is below and
    between, and cuts the bracket by a sketch of the values between, until at most ``limit`` are left. A value at an
    end is not between, so one that makes up much of a column does not stop it.
    """
    group, value = "column_name", F.col("value")
    shares = _cuts(accuracy)
    open_, found = [], []
    for name, first, last in ranks:
        t = totals[name]
        if t["n"] <= limit:
            found.append((name, first, last, t["low"], t["high"]))
        else:
            open_.append((name, first, last, *_bracket(t["cuts"], first, last, t["n"], t["low"], t["high"])))
    keys = [group, "first", "last", "low", "high"]
    inside = (value > F.col("low")) & (value < F.col("high"))
    while open_:
        table = long.sparkSession.createDataFrame(open_, BRACKETS)
        counted = (
            long.join(F.broadcast(table), group)
            .where(value < F.col("high"))
            .groupBy(*keys)
            .agg(
                F.count_if(value <= F.col("low")).alias("upto"),
                F.count_if(inside).alias("n"),
                F.percentile_approx(F.when(inside, value), shares, accuracy).alias("cuts"),
            )
        )
        rows = {tuple(r[k] for k in keys[:3]): r for r in counted.collect()}
        again = []
        for name, first, last, low, high in open_:
            r = rows.get((name, first, last))
            upto, n = (r["upto"], r["n"]) if r else (0, 0)
            if last < upto:
                found.append((name, first, last, low, low))
            elif first >= upto + n:
                found.append((name, first, last, high, high))
            elif n <= limit:
                found.append((name, first, last, low, high))
            else:
                again.append((name, first, last, *_bracket(r["cuts"], first - upto, last - upto, n, low, high)))
        open_ = again
    return found


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY, limit: int = LIMIT
) -> DataFrame:
    """(column_name, p, quantile) with linear interpolation, exact at any size.

    Ranks are narrowed to brackets of at most ``limit`` values by passes that cut them some hundredfold each;
    then what lies below is counted and the values inside are walked in order. The
    brackets number columns x probabilities, so they are broadcast, and no task
    orders many more than ``limit`` values.
    """
    group, value = "column_name", "value"
    long = long_form(df, columns)
    sketch = long.groupBy(group).agg(
        F.count(value).alias("n"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.percentile_approx(value, _cuts(accuracy), accuracy).alias("cuts"),
    )
    totals = {r[group]: r for r in sketch.collect()}
    places = [(name, float(p), (t["n"] - 1) * float(p)) for name, t in totals.items() for p in probs]
    ranks = sorted({(name, math.floor(x), math.ceil(x)) for name, _, x in places})
    spark, keys = df.sparkSession, [group, "first", "last"]
    brackets = spark.createDataFrame(_brackets(long, ranks, totals, accuracy, limit), BRACKETS)
    tagged = long.join(F.broadcast(brackets), group).where(F.col(value) <= F.col("high"))
    inside = F.when(F.col(value) >= F.col("low"), F.col(value))
    counted = tagged.groupBy(*keys, inside.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    walked = counted.withColumn("end", F.sum("c").over(upto)).where(F.col("v").isNotNull())

    def at(rank: str) -> Column:
        return F.min(F.when(F.col("end") > F.col(rank), F.col("v")))

    picked = walked.groupBy(*keys).agg(at("first").alias("a"), at("last").alias("b"))
    wanted = [(name, math.floor(x), math.ceil(x), p, x - math.floor(x)) for name, p, x in places]
    table = spark.createDataFrame(wanted, f"{group} string, first long, last long, p double, share double")
    return picked.join(F.broadcast(table), keys).select(
        group, "p", (F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("quantile")
    )


def box_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, q1, median, q3, whisker_low, whisker_high) per column.

    The quartile table has one row per column and is broadcast.
    """
    long = long_form(df, columns)
    wide = (
        exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        .groupBy("column_name")
        .agg(
            *[
                F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(name)
                for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
            ]
        )
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    value = F.col("value")
    return (
        long.join(F.broadcast(wide), "column_name")
        .groupBy("column_name", "q1", "median", "q3")
        .agg(
            F.min(F.when(value >= F.col("q1") - reach, value)).alias("whisker_low"),
            F.max(F.when(value <= F.col("q3") + reach, value)).alias("whisker_high"),
        )
    )
