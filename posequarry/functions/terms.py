"""Energy-term selection, combination and weighting."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posequarry.fixed_values import ZERO_VARIANCE_TERMS

PREFIX = "raw_delta_"


@dataclass(frozen=True)
class TermSelection:
    """Terms to drop, and named groups of terms to sum into one."""

    name: str
    exclude: tuple[str, ...] = ()
    combine: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def is_plain(self) -> bool:
        return not self.exclude and not self.combine


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def raw_delta_columns(columns: Iterable[str]) -> list[str]:
    """Informative interface terms, in table order."""
    flat = set(ZERO_VARIANCE_TERMS)
    return [c for c in columns if c.startswith(PREFIX) and "???" not in c and c not in flat]


def varying_columns(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """Columns that take a non-zero value somewhere, found in one aggregate."""
    names = list(columns)
    flags = df.agg(
        *[F.bool_or(F.coalesce(quoted(c), F.lit(0.0)) != 0).alias(str(i)) for i, c in enumerate(names)]
    ).first()
    return [c for i, c in enumerate(names) if flags[i]]


def matching_columns(
    columns: Iterable[str], contains: str, without: Iterable[str] = (), skip: Iterable[str] = ()
) -> list[str]:
    """Names holding one text, none of the others, and not listed in ``skip``."""
    barred, named = tuple(without), set(skip)
    return [
        c
        for c in columns
        if re.search(re.escape(contains), c) and not any(b in c for b in barred) and c not in named
    ]


def selected_features(columns: Iterable[str], selection: TermSelection) -> dict[str, tuple[str, ...]]:
    """Feature name -> source columns: survivors first, then the sums."""
    features = {c: (c,) for c in columns if c not in selection.exclude}
    for new, parts in selection.combine.items():
        sources = [features.pop(p) for p in parts if p in features]
        if sources:
            features[new] = tuple(s for group in sources for s in group)
    return features


def feature_column(sources: tuple[str, ...], combined: bool) -> Column:
    """One feature: the column itself, or a sum in which a missing part counts 0."""
    if not combined:
        return quoted(sources[0]).cast("double")
    return reduce(
        lambda a, b: a + b, [F.coalesce(quoted(s).cast("double"), F.lit(0.0)) for s in sources]
    )


def apply_term_selection(
    df: DataFrame, feature_cols: Iterable[str], selection: TermSelection
) -> tuple[DataFrame, list[str]]:
    """Add the summed columns and return the new feature list with the frame."""
    features = selected_features(feature_cols, selection)
    added = {
        name: feature_column(parts, True)
        for name, parts in features.items()
        if name in selection.combine
    }
    return (df.withColumns(added) if added else df), list(features)


def resolve_original_weights(
    feature_cols: Iterable[str], weights: Mapping[str, float], selection: TermSelection
) -> dict[str, float]:
    """Score-function weight per feature; a sum gets the mean of its parts."""

    def weight(column: str) -> float:
        return weights.get(column.replace(PREFIX, ""), 0.0)

    return {
        c: sum(map(weight, selection.combine[c])) / len(selection.combine[c])
        if selection.combine.get(c)
        else weight(c)
        for c in feature_cols
    }


def weighted_sum(weights: Mapping[str, float]) -> Column:
    """Linear score; one missing feature makes it missing."""
    parts = [quoted(name).cast("double") * F.lit(float(w)) for name, w in weights.items()]
    return reduce(lambda a, b: a + b, parts)


def unweighted(energy: Column, weight: float) -> Column:
    """Raw energy behind a weighted one; NULL for a vanishing weight."""
    return energy / F.lit(weight) if abs(weight) > 1e-100 else F.lit(None).cast("double")
