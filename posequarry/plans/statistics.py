"""Statistics run: filtered subset, baseline grid, fits and result tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from posequarry import sinks
from posequarry.operators import fitting
from posequarry.operators.clustering import cluster_statistics
from posequarry.plans import experiment
from posequarry.session import materialize
from posequarry.sources.index import load_kd_index
from posequarry.sources.store import load_filtered


class Statistics(NamedTuple):
    subset: DataFrame
    baseline: DataFrame
    weights: DataFrame
    results: DataFrame
    cluster_report: DataFrame | None


def run_statistics(
    spark: SparkSession,
    index_path: str,
    poses: DataFrame,
    out: str,
    coordinates: DataFrame | None = None,
    rmsd_cutoff: float = 2.0,
    experiments: Sequence[experiment.Experiment] = tuple(experiment.DEFAULT_EXPERIMENTS),
    epochs: int = 2000,
) -> Statistics:
    """Write every result table of a statistics run under ``out``.

    ``coordinates`` (pdb, row_idx, xyz) adds the clustered experiments; poses are
    clustered in order of their interface score, and clusters are cached.
    """
    affinity = load_kd_index(spark, index_path)
    subset = load_filtered(spark, f"{out}/subset", poses, affinity)
    chosen, members, report = list(experiments), None, None
    if coordinates is not None:
        scored = subset.select("pdb", "row_idx", "idelta_score").join(coordinates, ["pdb", "row_idx"])
        members = sinks.cached_clusters(scored, rmsd_cutoff, f"{out}/clusters", "idelta_score")
        chosen += experiment.clustered_experiments(rmsd_cutoff)
        report = sinks.write_report_csv(cluster_statistics(members), f"{out}/cluster_report")
    grid = experiment.Grid(subset, affinity, chosen, cluster_members=members)
    baseline = sinks.write_report_csv(grid.baseline(), f"{out}/baseline_results")
    frame = materialize(grid.training_frame())
    fitted = materialize(fitting.fit_weights(frame, epochs=epochs))
    weights = sinks.write_report_csv(grid.named_weights(fitted), f"{out}/weights")
    results = sinks.write_report_csv(grid.results(fitted, frame), f"{out}/experiment_results")
    return Statistics(subset, baseline, weights, results, report)
