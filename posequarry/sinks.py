"""Writers.  Each returns the written table, read back."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posequarry.functions.missing import nan_to_null
from posequarry.functions.terms import quoted
from posequarry.functions.text import rename_ligand_chain
from posequarry.operators.clustering import cluster_poses
from posequarry.operators.splits import without_ids
from posequarry.session import materialize
from posequarry.sources.index import load_cleaned_index

# A range is sorted in one task: of MOST_BYTES at most, and of LEAST_BYTES where that takes no more ranges than
# FREE_RANGES, up to which a map task keeps no rows back (spark.shuffle.sort.bypassMergeThreshold).
LEAST_BYTES, MOST_BYTES, FREE_RANGES = 64 << 20, 256 << 20, 200
WIDTH_SAMPLE = 1_000
TEXTS = ("string", "binary", "array", "map", "struct")


def ranges(rows: DataFrame) -> int:
    """Ranges to sort a table in, by its size, as the session's shuffle partitions do not grow with it.

    Rows are counted; the width of their texts is that of a few of them.
    """
    texts = [F.octet_length(quoted(c).cast("string")) for c, kind in rows.dtypes if kind.startswith(TEXTS)]
    width = sum((F.coalesce(n, F.lit(0)) for n in texts), F.lit(8 * (len(rows.columns) + 1)))
    mean = rows.limit(WIDTH_SAMPLE).select(F.avg(width)).first()[0] or 0
    size = rows.count() * mean
    least = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(size / LEAST_BYTES))
    return max(min(least, FREE_RANGES), math.ceil(size / MOST_BYTES))


def append_poses(rows: DataFrame, path: str) -> DataFrame:
    """Append pose rows to a store table partitioned by dataset."""
    nan_to_null(rows).write.mode("append").partitionBy("dataset").parquet(path)
    return rows.sparkSession.read.parquet(path)


def write_clustered(rows: DataFrame, path: str) -> DataFrame:
    """Rewrite a store table range-clustered on the id, for row-group pruning.

    Ranges include the row number, so a very large complex spans several files.
    """
    order = ["dataset", "pdb", "row_idx"]
    ordered = rows.repartitionByRange(ranges(rows), *order).sortWithinPartitions(*order)
    ordered.write.mode("overwrite").partitionBy("dataset").parquet(path)
    return rows.sparkSession.read.parquet(path)


def write_table(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def write_report_csv(report: DataFrame, path: str) -> DataFrame:
    """CSV with header.  Files follow the partitions; nothing is gathered."""
    report.write.mode("overwrite").csv(path, header=True)
    return report.sparkSession.read.csv(path, header=True, schema=report.schema)


def write_index(rows: DataFrame, path: str) -> DataFrame:
    """Cleaned index (pdb, chains, cofactors) as ``pdb;a,b;x:1`` lines."""
    line = F.concat_ws(
        ";", "pdb", F.concat_ws(",", "chains"), F.concat_ws(",", "cofactors")
    )
    rows.select(line.alias("value")).write.mode("overwrite").text(path)
    return load_cleaned_index(rows.sparkSession, path)


def write_structures(lines: DataFrame, path: str, chain: str | None = None) -> str:
    """One folder per complex with its lines in order.

    Rows are range-partitioned by (pdb, line_no): small structures end up in one
    file, a huge one in several part files whose names follow the line order.
    """
    line = F.col("line") if chain is None else rename_ligand_chain(F.col("line"), chain)
    ordered = lines.select("pdb", "line_no", line.alias("value"))
    ordered = ordered.repartitionByRange(ranges(ordered), "pdb", "line_no").sortWithinPartitions("pdb", "line_no")
    ordered.drop("line_no").write.mode("overwrite").partitionBy("pdb").text(path)
    return path


def delete_from_index(
    spark: SparkSession, path: str, new_path: str, remove: DataFrame, keep: DataFrame | None = None
) -> DataFrame:
    """Index without the removed ids, written to a new path.

    A job must not overwrite what it reads; the caller swaps the paths.
    """
    return write_index(without_ids(load_cleaned_index(spark, path), remove, keep), new_path)


def cached_clusters(poses: DataFrame, rmsd_cutoff: float, cache: str, score_col: str = "score") -> DataFrame:
    """Clusters from the cache, computing and adding complexes it lacks.

    An entry holds for the poses it was made from, told by two sums over digests of their
    row number, score and coordinates, whatever their order. A complex with any change in these is computed anew, and its
    superseded entries leave the cache.
    """
    spark = poses.sparkSession
    digest = F.xxhash64("row_idx", quoted(score_col).cast("double"), F.col("xyz").cast("array<double>"))
    state = poses.groupBy("pdb").agg(
        F.count(F.lit(1)).alias("n_poses"),
        F.sum(F.shiftright(digest, 32)).alias("high_sum"),
        F.bit_xor(digest).alias("digest_xor"),
    )
    state = materialize(state)
    keys = state.columns

    def entries() -> DataFrame:
        return spark.read.parquet(cache).where(F.col("rmsd_cutoff") == rmsd_cutoff).drop("rmsd_cutoff")

    try:
        known = materialize(entries().select(*keys).distinct())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        known = state.limit(0)
    missing = state.join(known, keys, "left_anti")
    if not missing.isEmpty():
        found = cluster_poses(poses.join(missing.select("pdb"), "pdb", "left_semi"), rmsd_cutoff, score_col)
        found = found.join(missing, "pdb")
        stale = known.join(state.select("pdb"), "pdb", "left_semi").join(state, keys, "left_anti")
        mode = "append"
        if not stale.isEmpty():
            # The partition is written whole, from a copy, as a job must not overwrite what it reads.
            found = materialize(entries().join(stale, keys, "left_anti").unionByName(found))
            mode = "overwrite"
        writer = found.withColumn("rmsd_cutoff", F.lit(rmsd_cutoff)).write.mode(mode)
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("rmsd_cutoff").parquet(cache)
    return entries().join(state, keys, "left_semi").drop(*keys[1:])


def skipped_ids(poses: DataFrame, members: DataFrame) -> DataFrame:
    """Complexes without a single pose that could be clustered."""
    return poses.select("pdb").distinct().join(members.select("pdb"), "pdb", "left_anti")
