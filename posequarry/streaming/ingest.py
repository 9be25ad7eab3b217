"""Buffered append of pose rows that resumes where it stopped."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from posequarry.functions.missing import nan_to_null
from posequarry.operators.progress import label_counts


def append_new_files(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    table: str,
    checkpoint: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Append files that are new in ``landing`` to a pose table, then stop.

    The stream's checkpoint remembers what was taken, so a restarted run adds
    only what is missing, each row once.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    return (
        nan_to_null(rows)
        .writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .partitionBy("dataset")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


COUNTS = "dataset string, pdb string, type string, n long, batch long"


def record_batch(rows: DataFrame, batch: int, table: str, counts: str) -> None:
    """Add one numbered batch to a pose table and to its label counts.

    Both are written under the batch's number, so a batch that comes again after a failure
    replaces what it had written and counts stay those of the table.
    """
    nan_to_null(rows).write.mode("overwrite").partitionBy("dataset").parquet(f"{table}/batch={batch}")
    written = rows.sparkSession.read.parquet(f"{table}/batch={batch}")
    label_counts(written).write.mode("overwrite").parquet(f"{counts}/batch={batch}")


def append_counted(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    table: str,
    counts: str,
    checkpoint: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """``append_new_files`` with label counts kept up by every batch, for progress and resume plans.

    The checkpoint numbers the batches; it belongs to this table and counts table alone.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    return (
        rows.writeStream.foreachBatch(lambda batch, number: record_batch(batch, number, table, counts))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_counts(spark: SparkSession, counts: str) -> DataFrame:
    """(dataset, pdb, type, n) in a part per batch; a table not begun has none."""
    try:
        return spark.read.schema(COUNTS).parquet(counts).drop("batch")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COUNTS).drop("batch")


def total_counts(spark: SparkSession, counts: str) -> DataFrame:
    return read_counts(spark, counts).groupBy("dataset", "pdb", "type").agg(F.sum("n").alias("n"))
