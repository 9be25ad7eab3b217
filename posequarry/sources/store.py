"""Pose stores: Parquet partitioned by dataset, clustered on the complex id."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posequarry.fixed_values import LEAD_COLUMNS
from posequarry.functions.missing import nan_to_null
from posequarry.functions.terms import quoted
from posequarry.operators import aggregate, ordering
from posequarry.operators.progress import extract_complete

TEXT_COLUMNS = ("lines", "delta", "xyz")


class PoseStore:
    """Docking and relax tables under one folder.

    Reads are lazy and pruned: filters on dataset, id and type reach the scan,
    and text columns are read only when asked for. With ``skip_unreadable`` files that cannot be
    opened are left out, and ``unreadable`` reports them; else one such file fails the job.
    """

    def __init__(
        self, spark: SparkSession, folder: str, docking: str = "docking", relax: str = "relax", skip_unreadable: bool = False
    ):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.docking, self.relax, self.skip = docking, relax, skip_unreadable
        try:
            first = self._open(docking).select("pdb").limit(1)
        except AnalysisException as error:
            raise ValueError(f"{folder} is not a pose store") from error
        if first.isEmpty():
            raise ValueError(f"no poses found in {folder}")

    def _open(self, table: str) -> DataFrame:
        return self.spark.read.option("ignoreCorruptFiles", self.skip).parquet(f"{self.folder}/{table}")

    def _read(self, table: str, structure: bool) -> DataFrame:
        df = self._open(table)
        return df if structure else df.drop(*TEXT_COLUMNS)

    def unreadable(self) -> DataFrame:
        """(path, reason): files of the store that reads leave out."""
        tables = [unreadable_files(self.spark, f"{self.folder}/{t}") for t in (self.docking, self.relax)]
        return tables[0].unionAll(tables[1])

    def ids(self) -> DataFrame:
        return self._read(self.docking, False).select("pdb").distinct()

    def poses(self, pdb: str | None = None, structure: bool = False) -> DataFrame:
        df = self._read(self.docking, structure)
        return df if pdb is None else df.where(F.col("pdb") == pdb)

    def relax_poses(self, pdb: str | None = None, structure: bool = False) -> DataFrame:
        df = self._read(self.relax, structure)
        return df if pdb is None else df.where(F.col("pdb") == pdb)

    def extract(self, target: int = 300) -> DataFrame:
        """Score rows of all complete runs, the id first."""
        rows = extract_complete(self.poses(), target)
        return rows.select("pdb", *[quoted(c) for c in rows.columns if c != "pdb"])


def unreadable_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, reason): Parquet files below a folder whose footer cannot be read.

    A probe of all footers gives the files that open; it reads no column. Only of the others that have
    rows missing is the end looked at, to tell a cut file from a complete one without rows.
    """
    plain = lambda path: F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    listed = found.load(folder)
    opened = spark.read.option("ignoreCorruptFiles", True).option("recursiveFileLookup", True)
    opened = opened.parquet(folder).select(plain(F.col("_metadata.file_path")).alias("_path")).distinct()
    unseen = listed.select("path", "length").join(opened, plain(F.col("path")) == F.col("_path"), "left_anti")
    ends = listed.join(unseen.select("path"), "path", "left_semi").select(
        "path", "length", F.expr("substring(content, -4, 4)").alias("_end")
    )
    reason = F.when(F.col("length") < 12, "too short").when(F.col("_end") != F.lit(b"PAR1"), "no footer at its end")
    return ends.select("path", reason.alias("reason")).where("reason IS NOT NULL")


def lead_scores(poses: DataFrame, run_type: str) -> DataFrame:
    """Leading score columns of one run label."""
    return poses.where(F.col("type") == run_type).select("pdb", "row_idx", *LEAD_COLUMNS)


def load_full_table(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def filtered_subset(poses: DataFrame, affinity: DataFrame) -> DataFrame:
    """Refined, perturbed, non-positive poses with a measured affinity.

    Sequence ids count all rows of a label, so they match the stores; rows of equal or missing
    ``row_idx`` are numbered one by one like any others. A store that
    already has ids is only filtered. Otherwise rows are numbered in place: one that the filters drop
    has given up its other columns by then, so only what stays is shuffled whole.
    """
    refined = aggregate.keep_refined_perturbed(poses)
    if "type_seq_id" in poses.columns:
        return aggregate.join_affinity(aggregate.keep_non_positive(refined), affinity)
    keys = ["pdb", "type", "row_idx"]
    good = F.coalesce((F.col("total_score") <= 0) & (F.col("idelta_score") <= 0), F.lit(False))
    whole = F.struct(*[quoted(c) for c in poses.columns if c not in keys])
    rows = refined.select(*keys, F.when(good, whole).alias("_row"))
    measured = [c for c in affinity.columns if c != "pdb"]
    once = ordering.first_per_key(affinity, ["pdb"], [F.col(c).asc_nulls_last() for c in measured])
    once = once.select("pdb", F.struct(*measured).alias("_affinity"))
    rows = rows.join(once, "pdb", "left")
    rows = rows.withColumn("_row", F.when(F.col("_affinity").isNotNull(), F.col("_row")))
    kept = ordering.sequence_ids(rows, keys[:2], keys[2:]).where("_row IS NOT NULL")
    columns = [quoted(c) if c in keys else F.col("_row").getField(c).alias(c) for c in poses.columns]
    return kept.select(*columns, *[F.col("_affinity").getField(c).alias(c) for c in measured], "type_seq_id")


def load_filtered(spark: SparkSession, path: str, poses: DataFrame, affinity: DataFrame) -> DataFrame:
    """Written subset, built first if it does not exist yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        filtered_subset(poses, affinity).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    """(term, weight) of a JSON object of numbers."""
    return parse_weights(spark.read.text(path, wholetext=True))


def parse_weights(documents: DataFrame, column: str = "value") -> DataFrame:
    return documents.select(
        F.explode(F.from_json(column, "map<string,double>")).alias("term", "weight")
    )
