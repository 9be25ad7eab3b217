"""Line-oriented text with a reliable order, for files of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posequarry.functions.text import file_stem
from posequarry.session import materialize

LINE_ORDER = ("path", "block_start", "seq")


def read_lines(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """(path, block_start, seq, line); the first three order the lines.

    Files are split as usual: ``block_start`` is the offset of the split inside
    its file and ``seq`` rises inside the split, so no file has to be read whole.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    )


def number_lines(lines: DataFrame, whole: Column | None = None) -> DataFrame:
    """(path, line_no, line) with zero-based line numbers per file.

    With ``whole``, a value of the path, all files of one value are numbered through, in the order of
    their paths. Lines of a split are consecutive, so a line number is the lines of earlier
    splits plus the distance to the first line of its own.  Only split counts
    are put in order, and only they are held in memory where the lines meet them. The input is
    checkpointed, because both sides must see the same splits.
    """
    fixed = materialize(lines)
    splits = fixed.groupBy("path", "block_start").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")
    )
    order = ["path", "block_start"]
    earlier = Window.partitionBy("path" if whole is None else whole).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = splits.select(
        *order, (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first_seq")).alias("shift")
    )
    numbered = fixed.join(offsets.hint("shuffle_hash"), order)
    return numbered.select("path", (F.col("shift") + F.col("seq")).alias("line_no"), "line")


def read_logs(
    spark: SparkSession, folder: str, glob: str | None = None, job_pattern: str | None = None
) -> DataFrame:
    """(job, path, block_start, seq, line) of a log folder.

    The job is the file stem, or what ``job_pattern`` captures in the path.
    """
    job = F.regexp_extract("path", job_pattern, 1) if job_pattern else file_stem(F.col("path"))
    return read_lines(spark, folder, glob).select(job.alias("job"), *LINE_ORDER, "line")


def nth_line_contains(numbered: DataFrame, line_no: int, phrase: str) -> DataFrame:
    """Files whose line ``line_no`` (zero-based) holds the phrase."""
    return numbered.where((F.col("line_no") == line_no) & F.col("line").contains(phrase)).select(
        "path", "line"
    )
