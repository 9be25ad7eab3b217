"""Curation of the annotated index and of ligands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posequarry.fixed_values import (
    ALLOWED_FLAGS,
    HEAVY_ATOM_RANGE,
    LIGAND_ELEMENTS,
    MAX_RESOLUTION,
    MIN_CURATION_QED,
    REMOVE_FLAGS,
)
from posequarry.operators.filters import first_reason


def clean_flags(flags: Column) -> Column:
    return F.transform(flags, lambda f: F.lower(F.trim(f)))


def _any_flag(flags: Column, phrase: str) -> Column:
    return F.exists(clean_flags(flags), lambda f: f.contains(phrase.lower()))


def with_removal_reason(
    index: DataFrame,
    remove_flags: Sequence[str] = REMOVE_FLAGS,
    max_resolution: float = MAX_RESOLUTION,
) -> DataFrame:
    """First reason an index entry is dropped, or "kept".

    The first flag with a match decides; both sides are compared in lower case.
    Then the resolution: too coarse, or not a number at all.
    """
    flags = clean_flags(F.col("flags"))
    tagged = F.transform(
        flags,
        lambda f: F.coalesce(*[F.when(f.contains(r.lower()), F.lit(r)) for r in remove_flags]),
    )
    by_flag = F.get(F.filter(tagged, lambda t: t.isNotNull()), 0)
    number = F.col("resolution").try_cast("double")
    by_resolution = F.when(number.isNull(), F.lit("NMR")).when(
        number > max_resolution, F.lit("resolution")
    )
    return index.withColumn("reason", F.coalesce(by_flag, by_resolution, F.lit("kept")))


def all_removal_flags(index: DataFrame, remove_flags: Sequence[str] = REMOVE_FLAGS) -> DataFrame:
    """(reason, n) over every bad flag, several per entry possible."""
    hits = F.array_compact(
        F.array(*[F.when(_any_flag(F.col("flags"), r), F.lit(r)) for r in remove_flags])
    )
    return (
        index.select(F.explode(hits).alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def unknown_flag_tally(kept: DataFrame, allowed: Sequence[str] = ALLOWED_FLAGS) -> DataFrame:
    """Sub-flags that match no known phrase, most frequent first."""
    parts = F.flatten(F.transform(clean_flags(F.col("flags")), lambda f: F.split(f, ", ")))
    words = kept.select(F.explode(parts).alias("flag")).where("flag != ''")
    known = words.flag.contains(allowed[0])
    for phrase in allowed[1:]:
        known = known | words.flag.contains(phrase)
    tally = words.where(~known).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    return tally.orderBy(F.desc("n"), "flag")


def ligand_profile(atoms: DataFrame, allowed: Sequence[str] = LIGAND_ELEMENTS) -> DataFrame:
    """(pdb, heavy_atoms, has_rare) from ligand atoms."""
    return atoms.groupBy("pdb").agg(
        F.count_if(F.col("element") != "H").alias("heavy_atoms"),
        F.bool_or(~F.col("element").isin(*allowed)).alias("has_rare"),
    )


def ligand_reason(profile: DataFrame, min_qed: float = MIN_CURATION_QED) -> DataFrame:
    """First ligand removal reason; a missing drug-likeness score means "parse"."""
    low, high = HEAVY_ATOM_RANGE
    reasons = {
        "parse": F.col("qed").isNull(),
        "qed": F.col("qed") <= min_qed,
        "heavy atom count": (F.col("heavy_atoms") < low) | (F.col("heavy_atoms") > high),
        "rare element": F.col("has_rare"),
    }
    return profile.withColumn("reason", first_reason(reasons))


def rare_element_flag(
    atoms: DataFrame, receptor_elements: Sequence[str], ligand_elements: Sequence[str]
) -> DataFrame:
    """(pdb, has_rare_element) with one allow-list per role.

    A boolean aggregate replaces the set of elements: nothing is collected.
    """
    element = F.upper(F.trim(F.col("element")))
    rare_receptor = (F.col("record") == "ATOM") & ~element.isin(*receptor_elements)
    rare_ligand = (
        (F.col("record") == "HETATM") & (F.col("residue") == "UNK") & ~element.isin(*ligand_elements)
    )
    return atoms.groupBy("pdb").agg(F.bool_or(rare_receptor | rare_ligand).alias("has_rare_element"))
