"""Reports on the feature table, and refitting of its interface energies."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posequarry.functions.terms import matching_columns, quoted
from posequarry.operators import density, features, filters, fitting, quantiles
from posequarry.session import materialize

# Filters applied before training; the others only describe the table.
TRAINING_FILTERS = (
    "vague_measures", "covalent", "fully_relaxed", "has_rare_elem", "rmsd_RelToCry", "relax_idelta",
)


class FeatureReport(NamedTuple):
    impact: DataFrame
    waterfall: DataFrame
    overlap: DataFrame
    split_sizes: DataFrame
    split_sizes_filtered: DataFrame
    metrics: DataFrame
    heatmap: DataFrame
    boxes: DataFrame


def training_rows(table: DataFrame) -> DataFrame:
    return filters.apply_filters(table, filters.feature_filters(), TRAINING_FILTERS)


def energy_columns(columns: Sequence[str], prefix: str = "relax_idelta_") -> list[str]:
    """Energy terms of one state: no constraints, no chain breaks, not the score."""
    return matching_columns(columns, prefix, ("chainbreak", "constraint"), (f"{prefix}score",))


def feature_report(table: DataFrame, split_columns: Sequence[str], carved: str | None = None) -> FeatureReport:
    """All reports of a feature table; each reads only the columns it needs."""
    keep, kept = filters.feature_filters(), training_rows(table)
    score, target = F.col("relax_idelta_score"), -F.col("dG")
    predictors = {
        "crystal_idelta": F.col("crystal_idelta_score"),
        "relax_idelta": score,
        "real_delta": F.col("relax_total_score") - F.col("ligaway_total_score"),
    }
    return FeatureReport(
        filters.filter_impact(table, keep),
        filters.waterfall_by_impact(table, keep),
        filters.removal_overlap(table, keep),
        filters.split_sizes(table, split_columns, carved),
        filters.split_sizes(kept, split_columns, carved, features.not_ic50()),
        features.split_metrics(kept, split_columns, predictors, target),
        density.histogram_2d(kept, score, target),
        quantiles.box_summary(kept, energy_columns(table.columns)),
    )


class Refit(NamedTuple):
    weights: DataFrame
    metrics: DataFrame


def refit_energies(
    table: DataFrame, split: str, prefix: str = "relax_idelta_", epochs: int = 1600, lr: float = 1e-3
) -> Refit:
    """Positive weights of the energy terms against -dG, best on validation.

    Steps use all training rows.  The default makes as many of them as 100 passes
    in batches of 512 would over 8 000 rows.
    """
    names = energy_columns(table.columns, prefix)
    energies = [quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]
    frame = training_rows(table).select(
        F.lit(split).alias("config"), quoted(split).alias("part"), (-F.col("dG")).alias("y"), *energies
    )
    frame = materialize(frame.dropna())
    fitted = materialize(fitting.fit_weights(frame, "softplus", epochs, lr, validate=True))
    metrics = fitting.fit_metrics(fitting.predict(frame, fitted))
    labels = table.sparkSession.createDataFrame(list(enumerate(names)), "position int, energy_term string")
    return Refit(fitted.join(labels, "position").select("energy_term", "weight"), metrics)
