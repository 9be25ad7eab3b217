"""Feature table: one wide row per complex."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posequarry.fixed_values import FEATURE_TERMS
from posequarry.functions import affinity as aff
from posequarry.functions.missing import differs
from posequarry.functions.metrics import mae, pearson, rmse
from posequarry.operators.ordering import first_per_key
from posequarry.operators.splits import assign_splits, required_lookup

STATES = ("crystal", "relax", "ligaway")


def feature_columns(split_columns: Sequence[str]) -> list[str]:
    """All columns after the id, in output order."""
    named = [
        *split_columns, "affinity_type", "dG", "vague_measures", "covalent", "fully_relaxed",
        "nres", "qed", "has_rare_element", "rmsd_relax_to_crystal", "crystal_total_score",
        "relax_total_score", "ligaway_total_score", "crystal_idelta_score", "relax_idelta_score",
    ]
    for prefix in ("crystal_idelta_", "relax_idelta_", "relax_total_", "ligaway_total_"):
        named += [prefix + term for term in FEATURE_TERMS]
    return named


def parsed_affinity(table: DataFrame) -> DataFrame:
    """(pdb, affinity_type, vague_measures, dG, covalent, new_split)."""
    parts = table.withColumn("_m", aff.measure_parts(F.col("kd/ki")))
    molar = aff.ladder_molar(F.col("_m.value"), F.col("_m.unit"))
    return parts.select(
        "pdb",
        "new_split",
        "covalent",
        F.col("_m.affinity_type").alias("affinity_type"),
        F.col("_m.vague").alias("vague_measures"),
        aff.free_energy(molar).alias("dG"),
    )


def bad_units(table: DataFrame) -> DataFrame:
    """Measurements whose unit is on no step of the ladder."""
    parts = table.withColumn("_m", aff.measure_parts(F.col("kd/ki")))
    return parts.where(aff.ladder_steps(F.col("_m.unit")) == 6).select(
        "pdb", F.col("kd/ki").alias("measure"), F.col("_m.unit").alias("unit")
    )


def state_columns(states: DataFrame) -> DataFrame:
    """Three prepared states per complex turned into columns.

    ``states`` has (pdb, state, row_idx, lead scores, raw energies); the first
    row of a state counts.  A conditional aggregate pivots in one shuffle.
    """
    rows = first_per_key(states.where(F.col("state").isin(*STATES)), ["pdb", "state"], [F.col("row_idx")])

    def of(state: str, column: str, name: str) -> Column:
        return F.expr(f"max(CASE WHEN state = '{state}' THEN double(`{column}`) END) AS `{name}`")

    picked = {
        "rmsd_relax_to_crystal": ("relax", "rmsd_to_crystal"),
        "crystal_total_score": ("crystal", "total_score"),
        "relax_total_score": ("relax", "total_score"),
        "ligaway_total_score": ("ligaway", "total_score"),
        "crystal_idelta_score": ("crystal", "idelta_score"),
        "relax_idelta_score": ("relax", "idelta_score"),
    }
    for prefix, state, source in (
        ("crystal_idelta_", "crystal", "raw_delta_"),
        ("relax_idelta_", "relax", "raw_delta_"),
        ("relax_total_", "relax", "raw_"),
        ("ligaway_total_", "ligaway", "raw_"),
    ):
        picked |= {prefix + term: (state, source + term) for term in FEATURE_TERMS}
    present = [F.bool_or(F.col("state") == s).alias(f"_has_{s}") for s in STATES]
    return rows.groupBy("pdb").agg(*present, *[of(s, c, n) for n, (s, c) in picked.items()])


def residue_counts(atoms: DataFrame) -> DataFrame:
    """(pdb, nres): distinct residues of a structure."""
    residues = atoms.select("pdb", "chain", "res_no").distinct()
    return residues.groupBy("pdb").agg(F.count(F.lit(1)).cast("int").alias("nres"))


def feature_table(
    ids: DataFrame,
    affinity: DataFrame,
    membership: DataFrame,
    split_columns: Sequence[str],
    affinity_split: str,
    states: DataFrame,
    atom_facts: DataFrame,
) -> DataFrame:
    """One row per id of ``ids`` (pdb, healthy).

    ``membership`` feeds the split columns except ``affinity_split``, which is
    the split of the affinity table.  ``atom_facts`` holds (pdb, nres, qed,
    has_rare_element).  An id without an affinity row fails the job.
    """
    listed = [s for s in split_columns if s != affinity_split]
    rows = assign_splits(ids, membership, listed)
    columns = ["new_split", "covalent", "affinity_type", "vague_measures", "dG"]
    rows = required_lookup(rows, parsed_affinity(affinity), "pdb", columns)
    rows = rows.withColumnRenamed("new_split", affinity_split)
    rows = rows.join(state_columns(states), "pdb", "left").join(atom_facts, "pdb", "left")
    has_all = F.col("healthy")
    for state in STATES:
        has_all = has_all & F.coalesce(F.col(f"_has_{state}"), F.lit(False))
    rows = rows.withColumn("fully_relaxed", has_all)
    return rows.select("pdb", *feature_columns(split_columns))


def split_metrics(
    features: DataFrame, split_columns: Sequence[str], predictors: dict[str, Column], target: Column
) -> DataFrame:
    """rmse, mae and r on the test rows, per split and predictor.

    Splits and predictors become rows, so one aggregate serves all pairs.
    """
    splits = F.array(
        *[F.struct(F.lit(s).alias("split"), F.col(s).alias("part")) for s in split_columns]
    )
    guesses = F.array(
        *[F.struct(F.lit(n).alias("predictor"), c.alias("pred")) for n, c in predictors.items()]
    )
    long = features.select(target.alias("y"), guesses.alias("g"), F.inline(splits))
    long = long.where("part = 'test'").select("split", "y", F.inline("g"))
    long = long.where(F.col("y").isNotNull() & F.col("pred").isNotNull())
    y, p = F.col("y"), F.col("pred")
    return long.groupBy("split", "predictor").agg(
        rmse(p, y).alias("rmse"), mae(p, y).alias("mae"), pearson(p, y).alias("pcc")
    )


def not_ic50() -> Column:
    return differs(F.col("affinity_type"), "IC50")
