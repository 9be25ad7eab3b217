"""Split lists in their three shapes, all as (source, pdb, split, priority)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posequarry.operators.ordering import first_per_key
from posequarry.sources.text_lines import read_lines


def load_json_lists(spark: SparkSession, path: str) -> DataFrame:
    """(list_name, pdb) of one JSON object of lists."""
    return parse_json_lists(spark.read.text(path, wholetext=True))


def parse_json_lists(documents: DataFrame, column: str = "value") -> DataFrame:
    lists = F.from_json(column, "map<string,array<string>>")
    named = documents.select(F.explode(lists).alias("list_name", "ids"))
    return named.select("list_name", F.explode("ids").alias("pdb"))


def parse_id_list(lines: DataFrame) -> DataFrame:
    """Ids of comma-separated lines, trimmed; every line counts."""
    ids = F.filter(F.transform(F.split("line", ","), lambda i: F.trim(i)), lambda i: i != "")
    return lines.select(F.explode(ids).alias("pdb"))


def load_id_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_id_list(read_lines(spark, path))


def load_split_index(
    spark: SparkSession, path: str, key: str = "entry_pdb_id", split: str = "split"
) -> DataFrame:
    """First row per id of an external index; only two columns are read."""
    return first_split(spark.read.parquet(path).select(key, split), key, [F.col(split)])


def first_split(index: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return first_per_key(index, [key], order)


def membership(ids: DataFrame, source: str, split: str, priority: int) -> DataFrame:
    return ids.select(
        F.lit(source).alias("source"), "pdb", F.lit(split).alias("split"), F.lit(priority).alias("priority")
    )


def membership_of_lists(
    lists: DataFrame, source: str, parts: Mapping[str, tuple[str, int]]
) -> DataFrame:
    """Named lists to membership rows; ``parts`` maps a name to (split, priority)."""
    (first, (split, rank)), *rest = parts.items()
    part = F.when(F.col("list_name") == first, F.struct(F.lit(split).alias("split"), F.lit(rank).alias("priority")))
    for name, (split, rank) in rest:
        part = part.when(
            F.col("list_name") == name, F.struct(F.lit(split).alias("split"), F.lit(rank).alias("priority"))
        )
    rows = lists.withColumn("_p", part).where(F.col("_p").isNotNull())
    return rows.select(F.lit(source).alias("source"), "pdb", "_p.split", "_p.priority")
