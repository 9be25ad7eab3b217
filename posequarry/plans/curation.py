"""Corpus curation: annotated index to cleaned structures and index."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posequarry import sinks
from posequarry.fixed_values import MAX_PROTEIN_SIZE
from posequarry.operators import annotations, contacts, filters
from posequarry.session import materialize
from posequarry.sources.index import load_annotations


class Curation(NamedTuple):
    index: DataFrame
    removed: DataFrame
    unknown_flags: DataFrame
    size_report: DataFrame
    residues: DataFrame


def curate(
    spark: SparkSession,
    index_path: str,
    ligands: DataFrame,
    structure_lines: DataFrame,
    ligand_points: DataFrame,
    out: str,
    max_size: int = MAX_PROTEIN_SIZE,
) -> Curation:
    """Run all curation steps and write the cleaned corpus under ``out``.

    ``ligands`` has (pdb, heavy_atoms, has_rare, qed); ``structure_lines`` has
    (pdb, line_no, line); ``ligand_points`` has (pdb, x, y, z).  Parsed atoms and
    contacts are read by several steps and are checkpointed once.
    """
    index = annotations.with_removal_reason(load_annotations(spark, index_path))
    kept = index.where("reason = 'kept'")
    profiled = annotations.ligand_reason(ligands.join(kept.select("pdb"), "pdb", "left_semi"))
    ids = profiled.where("reason = 'kept'").select("pdb")
    lines = structure_lines.join(ids, "pdb", "left_semi")
    atoms = materialize(contacts.parsed_atoms(contacts.with_ter_blocks(lines)))
    hits = contacts.within_radius(atoms, ligand_points)
    table = materialize(contacts.contact_table(atoms, hits))
    sizes = contacts.protein_sizes(atoms, table)
    verdict = contacts.curation_verdict(sizes, table, max_size)
    final = sinks.write_index(contacts.index_lines(verdict, table), f"{out}/index")
    survivors = lines.join(final.select("pdb"), "pdb", "left_semi")
    sinks.write_structures(contacts.cleaned_lines(survivors, table), f"{out}/structures")
    stages = {"index": index, "ligand": profiled, "structure": verdict}
    counts = [
        filters.reason_counts(rows).select(F.lit(name).alias("stage"), "reason", "n")
        for name, rows in stages.items()
    ]
    removed = counts[0].unionByName(counts[1]).unionByName(counts[2]).where("reason <> 'kept'")
    residues = contacts.residue_frequency(table, "modified").unionByName(
        contacts.residue_frequency(table, "co_ligand")
    )
    return Curation(
        final,
        sinks.write_report_csv(removed, f"{out}/removed"),
        annotations.unknown_flag_tally(kept),
        contacts.size_report(sizes, table),
        residues,
    )
