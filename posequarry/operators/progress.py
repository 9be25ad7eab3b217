"""Run progress, status, resume planning and storage reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posequarry.fixed_values import LAST_DOCKING_LABEL, STAGE_TARGETS
from posequarry.functions.text import human_size
from posequarry.session import materialize

Targets = Mapping[str, int]


def complete_ids(poses: DataFrame, target: int = 300, labels: Sequence[str] = (LAST_DOCKING_LABEL,)) -> DataFrame:
    """Complexes with exactly ``target`` rows of every given label.

    Runs are sequential, so the last label alone decides by default.
    """
    reached = [F.count_if(F.col("type") == label) == target for label in labels]
    counted = poses.groupBy("pdb").agg(reduce(lambda a, b: a & b, reached).alias("_done"))
    return counted.where("_done").select("pdb")


def extract_complete(
    poses: DataFrame, target: int = 300, labels: Sequence[str] = (LAST_DOCKING_LABEL,)
) -> DataFrame:
    """Pose rows of the complete runs only.

    Their ids are written first, so that Spark knows their size and sends few ids to the poses rather than
    shuffling every pose.
    """
    return poses.join(materialize(complete_ids(poses, target, labels)), "pdb", "left_semi")


def label_counts(rows: DataFrame) -> DataFrame:
    """(dataset, pdb, type, n): rows of each run label."""
    return rows.groupBy("dataset", "pdb", "type").agg(F.count(F.lit(1)).alias("n"))


def progress_of_counts(counts: DataFrame, targets: Targets = STAGE_TARGETS) -> DataFrame:
    """(dataset, pdb, one share per stage) of label counts, which may come in parts."""
    shares = [
        (F.coalesce(F.sum(F.when(F.col("type") == stage, F.col("n"))), F.lit(0)) / F.lit(float(target))).alias(stage)
        for stage, target in targets.items()
    ]
    return counts.groupBy("dataset", "pdb").agg(*shares)


def progress_vector(poses: DataFrame, relax_poses: DataFrame, targets: Targets = STAGE_TARGETS) -> DataFrame:
    """(dataset, pdb, one share per stage) from a single aggregate over both stores."""
    keys = ["dataset", "pdb", "type"]
    labels = poses.select(*keys).unionByName(relax_poses.select(*keys))
    return progress_of_counts(labels.withColumn("n", F.lit(1).cast("long")), targets)


def stage_deficits(progress: DataFrame, targets: Targets = STAGE_TARGETS) -> DataFrame:
    """Per dataset and stage, how many complexes are below target."""
    return progress.groupBy("dataset").agg(
        *[F.count_if(F.col(stage) < 1.0).alias(stage) for stage in targets]
    )


def incomplete_ids(progress: DataFrame, targets: Targets = STAGE_TARGETS) -> DataFrame:
    below = reduce(lambda a, b: a | b, [F.col(stage) < 1.0 for stage in targets])
    return progress.where(below)


def run_status(poses: DataFrame, relax_poses: DataFrame, last_relax: str = "apo_relax",
               last_label: str = "apo_relax_docking_perturb") -> DataFrame:
    """(pdb, status): failed, half finished or success."""
    marks = poses.select(
        "pdb", F.lit(False).alias("relaxed"), (F.col("type") == last_label).alias("docked")
    ).unionByName(
        relax_poses.select(
            "pdb", (F.col("type") == last_relax).alias("relaxed"), F.lit(False).alias("docked")
        )
    )
    flags = marks.groupBy("pdb").agg(
        F.bool_or("relaxed").alias("relaxed"), F.bool_or("docked").alias("docked")
    )
    status = (
        F.when(~F.col("relaxed"), "failed").when(~F.col("docked"), "half_finished").otherwise("success")
    )
    return flags.select("pdb", status.alias("status"))


def run_summary(poses: DataFrame, reduction: str = "saved_share") -> DataFrame:
    """Best scores and mean text reduction per run."""
    return poses.groupBy("pdb", "type").agg(
        F.min("total_score").alias("best_score"),
        F.min("idelta_score").alias("best_idelta"),
        F.min("rmsd_to_crystal").alias("best_rmsd_to_crystal"),
        F.min("rmsd_to_input").alias("best_rmsd_to_input"),
        F.avg(reduction).alias("mean_reduction"),
    )


def resume_plan(work: DataFrame, rows: DataFrame, targets: Targets = STAGE_TARGETS) -> DataFrame:
    """(pdb, stage, done, remaining) for every work item and stage."""
    return resume_plan_of_counts(work, rows.select("pdb", "type", F.lit(1).cast("long").alias("n")), targets)


def resume_plan_of_counts(work: DataFrame, counts: DataFrame, targets: Targets = STAGE_TARGETS) -> DataFrame:
    """The same from label counts, which may come in parts, without reading a pose."""
    stages = F.array(
        *[
            F.struct(F.lit(s).alias("stage"), F.lit(t).alias("target"))
            for s, t in targets.items()
        ]
    )
    wanted = work.select("pdb").distinct().select("pdb", F.inline(stages))
    done = counts.groupBy("pdb", F.col("type").alias("stage")).agg(F.sum("n").alias("done"))
    count = F.coalesce(F.col("done"), F.lit(0))
    return wanted.join(done, ["pdb", "stage"], "left").select(
        "pdb",
        "stage",
        count.alias("done"),
        F.greatest(F.col("target") - count, F.lit(0)).alias("remaining"),
    )


def storage_report(df: DataFrame, columns: Sequence[str], group: str = "dataset") -> DataFrame:
    """Payload bytes per column and dataset, with totals over the columns."""
    width = {"float": 4, "int": 4, "double": 8, "bigint": 8, "boolean": 1}
    kinds = dict(df.dtypes)
    sizes = [
        (
            F.sum(F.octet_length(F.col(c)))
            if kinds[c] in ("string", "binary")
            else F.count(F.col(c)) * F.lit(width[kinds[c]])
        ).cast("long").alias(f"_{i}")
        for i, c in enumerate(columns)
    ]
    per_group = df.groupBy(group).agg(*sizes)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("bytes"))
            for i, c in enumerate(columns)
        ]
    )
    long = per_group.select(group, F.inline(cells))
    total = long.rollup(group, "column_name").agg(F.sum("bytes").alias("bytes"))
    return total.select(
        F.coalesce(F.col(group), F.lit("TOTAL")).alias(group),
        F.coalesce(F.col("column_name"), F.lit("TOTAL")).alias("column_name"),
        "bytes",
        human_size(F.col("bytes")).alias("size_text"),
    )
