"""Structure text of poses and differences between prepared states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posequarry.functions import delta, text
from posequarry.functions.terms import quoted
from posequarry.operators.aggregate import lowest_pose
from posequarry.operators.ordering import first_per_key, sequence_ids
from posequarry.operators.skew import salted_join


def best_start_poses(relax_poses: DataFrame) -> DataFrame:
    """Lowest-total pose per (pdb, label): the base of every docking run."""
    return lowest_pose(relax_poses, ["pdb", "type"], "total_score")


def docked_text(poses: DataFrame, relax_poses: DataFrame) -> DataFrame:
    """Full lines of docked poses: base text of the start label, then the delta.

    ``relax_poses.lines`` is the base text as an array, ``poses.delta`` the map
    of changed lines.  A complex with very many poses is spread over slices.
    """
    base = best_start_poses(relax_poses).select(
        "pdb", F.col("type").alias("start"), F.col("lines").alias("base_lines")
    )
    keyed = poses.withColumn("start", text.start_label(F.col("type")))
    joined = salted_join(keyed, base, ["pdb", "start"], screen=["pdb"])
    return joined.withColumn("lines", delta.patched_lines(F.col("base_lines"), F.col("delta"))).drop(
        "base_lines", "delta", "start"
    )


def state_difference(
    relax_poses: DataFrame, columns: Sequence[str], bound: str = "relax", free: str = "apo_relax"
) -> DataFrame:
    """First bound row minus first free row per complex, for each column."""
    rows = relax_poses.where(F.col("type").isin(bound, free))
    first = first_per_key(rows, ["pdb", "type"], [F.col("row_idx")])

    def of(state: str, column: str) -> Column:
        return F.max(F.when(F.col("type") == state, quoted(column).cast("double")))

    return first.groupBy("pdb").agg(*[(of(bound, c) - of(free, c)).alias(c) for c in columns])


def map_sequence_ids(requested: DataFrame, store: DataFrame) -> DataFrame:
    """Requested (pdb, type, type_seq_id) to store rows, with a validity flag."""
    numbered = sequence_ids(store.select("pdb", "type", "row_idx"), ["pdb", "type"], ["row_idx"])
    keys = ["pdb", "type", "type_seq_id"]
    return requested.join(numbered, keys, "left").withColumn("valid", F.col("row_idx").isNotNull())


def pose_coordinates(ligand_lines: DataFrame, atom_map: DataFrame) -> DataFrame:
    """(pdb, row_idx, xyz) with atoms in map order.

    ``ligand_lines`` has one row per structure line of a pose; ``atom_map`` gives
    (pdb, atom_name, atom_index).  A list never exceeds one ligand's atoms.
    """
    line = F.col("line")
    atoms = ligand_lines.where(text.is_hetatm(line) & (text.cut(line, 17, 20) == "UNK"))
    atoms = atoms.select("pdb", "row_idx", *text.structure_fields(line))
    placed = salted_join(atoms, atom_map, ["pdb", "atom_name"], screen=["pdb"])
    ordered = F.array_sort(F.collect_list(F.struct("atom_index", "x", "y", "z")))
    flat = F.flatten(F.transform(ordered, lambda a: F.array(a["x"], a["y"], a["z"])))
    return placed.groupBy("pdb", "row_idx").agg(flat.alias("xyz"))
