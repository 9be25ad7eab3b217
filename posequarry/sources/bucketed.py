"""Pose tables bucketed and sorted on the complex, read without a shuffle per complex."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

KEY, ORDER = "pdb", "row_idx"


def _name(path: str, buckets: int) -> str:
    return f"bucketed_{buckets}_{zlib.crc32(path.encode()):08x}"


def write_bucketed(rows: DataFrame, path: str, buckets: int) -> DataFrame:
    """Write a pose table in ``buckets`` files per partition, each sorted by complex and row.

    Joins and aggregates on the complex then read it without an exchange, and two tables with as many
    buckets join file by file. Spark prefers a shuffle to fewer buckets than it has shuffle partitions. One
    bucket is one task, so choose buckets by the size of the table, and keep a store in which one complex holds much of all rows as ``sinks.write_clustered`` writes it.
    """
    spark = rows.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {_name(path, buckets)}")
    dealt = rows.repartition(buckets, KEY).write.mode("overwrite").bucketBy(buckets, KEY).sortBy(KEY, ORDER)
    dealt.option("path", path).saveAsTable(_name(path, buckets))
    return open_bucketed(spark, path, buckets)


def open_bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The table at ``path``, made known to this session with its buckets if it is not yet."""
    name = _name(path, buckets)
    if not spark.catalog.tableExists(name):
        fields = spark.read.parquet(path).schema.fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}, {ORDER}) "
            f"INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)
