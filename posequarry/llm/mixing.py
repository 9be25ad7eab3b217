"""Mixing sources to target weights by pivotal dependent rounding.

A source with target rate r copies every document floor(r) times for sure and
once more with probability r - floor(r). The fractional copies are rounded
together: two documents exchange expected words at random until one of them is
settled, and the other carries on. The words both expect stay what they were,
so the words a whole source takes differ from its target by less than half of
the one document left at the end, while each document keeps its probability.

The exchange is a reduction tree. A task folds some ``FAN`` documents of one source
and leaves one residual; residuals fold again, up to one per source. The last
residual goes to the nearer whole copy.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posequarry.llm.common import WORD, let, occurrence, saved

FAN = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Target words per source: one row per source of ``sizes`` (source, source_size).

    Weights repeat over the sources by code point, null last. The total is
    ``share`` of all words; no source gets more than ``cap`` times its own, and
    what a full source leaves goes to the others by weight. Sources fill up in
    the order of cap * size / weight, so the level is found at the first source
    that stays below its cap. Works on one row per source.
    """
    place = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn(
        "_w", F.element_at(cycle, (F.pmod(F.row_number().over(place) - 1, len(weights)) + 1).cast("int"))
    )
    filling = W.orderBy((cap * F.col("source_size") / F.col("_w")), F.col("source").asc_nulls_last())
    past = filling.rowsBetween(W.unboundedPreceding, -1)
    rest = filling.rowsBetween(W.currentRow, W.unboundedFollowing)
    levels = (
        weighed.withColumn("_total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("_full", cap * F.coalesce(F.sum("source_size").over(past), F.lit(0)))
        .withColumn("_open", F.sum("_w").over(rest))
        .withColumn("_level", (share * F.col("_total") - F.col("_full")) / F.col("_open"))
        .withColumn("_fits", F.col("_level") * F.col("_w") <= cap * F.col("source_size"))
        .withColumn("_final", F.min(F.when(F.col("_fits"), F.struct("_full", "_level"))).over(W.partitionBy()))
    )
    level = F.col("_final")["_level"]
    return levels.select(
        "source",
        "source_size",
        F.when(level.isNull(), cap * F.col("source_size"))
        .otherwise(F.least(cap * F.col("source_size"), level * F.col("_w")))
        .cast("double")
        .alias("target"),
    )


def _exchange(carry: Column, item: Column, seed: int) -> Column:
    """One random transfer: struct(done row, its extra copy, what carries on)."""
    gain = F.least((1 - carry["p"]) * carry["w"], item["p"] * item["w"])
    loss = F.least(carry["p"] * carry["w"], (1 - item["p"]) * item["w"])

    def draw(x: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), carry["h"], item["h"]), 11) * F.lit(2.0**-53)
        odds = F.when(x["gain"] + x["loss"] > 0, x["loss"] / (x["gain"] + x["loss"])).otherwise(1.0)
        return F.struct((u < odds).alias("up"), x["gain"], x["loss"])

    def settle(x: Column) -> Column:
        moved = F.when(x["up"], x["gain"]).otherwise(-x["loss"])
        done = F.when(
            x["up"], (1 - carry["p"]) * carry["w"] <= item["p"] * item["w"]
        ).otherwise(carry["p"] * carry["w"] <= (1 - item["p"]) * item["w"])
        return F.struct(x["up"].alias("up"), moved.alias("moved"), done.alias("first"))

    def result(x: Column) -> Column:
        first = x["first"]
        p = F.when(first, item["p"] - x["moved"] / item["w"]).otherwise(carry["p"] + x["moved"] / carry["w"])
        return F.struct(
            F.when(first, carry["row"]).otherwise(item["row"]).alias("row"),
            (first == x["up"]).cast("int").alias("extra"),
            F.struct(
                F.when(first, item["h"]).otherwise(carry["h"]).alias("h"),
                F.when(first, item["w"]).otherwise(carry["w"]).alias("w"),
                F.when(first, item["row"]).otherwise(carry["row"]).alias("row"),
                F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"),
            ).alias("carry"),
        )

    start = F.struct(gain.alias("gain"), loss.alias("loss"))
    return let(let(let(start, draw), settle), result)


def _fold(items: Column, seed: int) -> Column:
    """struct(carry, done): the sorted items exchanged one after the other."""
    none = F.expr("CAST(array() AS array<struct<row: bigint, extra: int>>)")
    start = F.struct(F.element_at(items, 1).alias("carry"), none.alias("done"))
    return F.aggregate(
        F.slice(items, F.lit(2), F.size(items)),
        start,
        lambda state, item: let(
            _exchange(state["carry"], item, seed),
            lambda x: F.struct(
                x["carry"].alias("carry"),
                F.concat(state["done"], F.array(F.struct(x["row"].alias("row"), x["extra"].alias("extra")))).alias(
                    "done"
                ),
            ),
        ),
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 42,
    fan: int = FAN,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Copies per document so that each source meets its target words.

    Reads doc_id, source, text; other columns play no part. Returns a number of the row, doc_id,
    source, size, source_size, target, copies, taken, and the columns of ``carry``.
    Null or empty text has size 0 and takes nothing; a null source is a source
    of its own, a null doc_id counts like any other value; equal rows may get different copies;
    an empty table gives an empty one. The draw depends on seed, doc_id and size
    alone, so reruns and other partitionings agree.
    """
    base = saved(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            *carry,
        ),
        "mix-sizes",
    )
    sources = saved(
        targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap).join(
            base.groupBy(F.col("source").alias("_s")).agg(F.count_if(F.col("size") > 0).alias("_n")),
            F.col("source").eqNullSafe(F.col("_s")),
        ).drop("_s"),
        "mix-sources",
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # A rate within rounding of a whole number needs no draw.
    near = F.abs(rate - F.round(rate)) < 1e-12
    sources = sources.withColumns(
        {
            "_sure": F.when(near, F.round(rate)).otherwise(F.floor(rate)).cast("int"),
            "_p": F.when(near, 0.0).otherwise(rate - F.floor(rate)),
        }
    )
    rows = (
        base.withColumnRenamed("source", "_s")
        .join(sources, F.col("_s").eqNullSafe(F.col("source")), "left")
        .drop("source")
        .withColumnRenamed("_s", "source")
    )
    key = F.xxhash64(F.lit(seed), "doc_id", "size")
    # Of many rows alike in both, each has a key of its own.
    key = F.when(F.col("_nth") == 0, key).otherwise(F.xxhash64(F.lit(seed), "doc_id", "size", "_nth"))
    most = sources.filter("_p > 0").agg(F.max("_n")).first()[0] or 0
    drawn = occurrence(rows.filter("size > 0 AND _p > 0"), ["doc_id", "size"], "row", fan, "_nth")
    level = drawn.select(
        "source",
        F.pmod(F.shiftrightunsigned(key, 1), F.ceil(F.col("_n") / fan)).alias("cell"),
        F.struct(
            key.alias("h"), F.col("size").cast("double").alias("w"), "row", F.col("_p").alias("p")
        ).alias("item"),
    )
    done, cells = [], max(1, -(-most // fan))
    while most:
        folded = saved(
            level.groupBy("source", "cell")
            .agg(F.sort_array(F.collect_list("item")).alias("items"))
            .select("source", "cell", _fold(F.col("items"), seed).alias("f")),
            "mix-level",
        )
        done.append(folded.select(F.explode("f.done").alias("d")).select("d.row", "d.extra"))
        if cells == 1:
            done.append(folded.select("f.carry.row", F.round("f.carry.p").cast("int").alias("extra")))
            break
        cells = -(-cells // fan)
        level = folded.select(
            "source", F.floor(F.col("cell") / fan).cast("long").alias("cell"), F.col("f.carry").alias("item")
        )
    if done:
        rows = rows.join(reduce(DataFrame.unionAll, done), "row", "left")
    else:
        rows = rows.withColumn("extra", F.lit(0))
    copies = F.when(F.col("size") > 0, F.col("_sure") + F.coalesce("extra", F.lit(0))).otherwise(0).cast("int")
    return rows.select(
        "row",
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
        *carry,
    )
