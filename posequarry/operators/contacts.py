"""Ligand contacts: the radius join and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posequarry.fixed_values import (
    CONTACT_RADIUS,
    DROPPED_COFACTORS,
    KEPT_COFACTORS,
    MAX_PROTEIN_SIZE,
)
from posequarry.functions import coords, text
from posequarry.operators.filters import first_reason
from posequarry.operators.ordering import running_total
from posequarry.operators.skew import ROWS_PER_SLICE, salted_join


def within_radius(
    atoms: DataFrame,
    ligand: DataFrame,
    radius: float = CONTACT_RADIUS,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Atoms within ``radius`` (inclusive) of any ligand atom of the same complex.

    Space is cut into cells as wide as the radius.  Ligand atoms are repeated
    into their 27 neighbour cells, atoms stay in their own, and a semi join on
    the cell stops at the first hit: no pairs come out and nothing has to be
    made distinct afterwards.  Cells that hold very many atoms are salted. Both sides are sorted: Spark takes the
    copies for as few as the ligand atoms and would broadcast all of them.
    """
    shift = F.sequence(F.lit(-1), F.lit(1))
    points = ligand.select("pdb", *[F.col(a).alias(f"_l{a}") for a in "xyz"]).distinct()
    near = points.withColumn("_dx", F.explode(shift))
    near = near.withColumn("_dy", F.explode(shift)).withColumn("_dz", F.explode(shift))
    near = near.select(
        "pdb",
        *[
            (coords.cell(F.col(f"_l{a}"), radius) + F.col(f"_d{a}")).alias(f"_c{a}")
            for a in "xyz"
        ],
        "_lx",
        "_ly",
        "_lz",
    )
    placed = atoms.withColumns({f"_c{a}": coords.cell(F.col(a), radius) for a in "xyz"})
    close = coords.squared_distance(
        F.col("x"), F.col("y"), F.col("z"), F.col("_lx"), F.col("_ly"), F.col("_lz")
    ) <= F.lit(radius * radius)
    hits = salted_join(
        placed, near, ["pdb", "_cx", "_cy", "_cz"], "left_semi", close, rows_per_slice, ["pdb"], "merge"
    )
    return hits.drop("_cx", "_cy", "_cz")


def with_ter_blocks(
    lines: DataFrame, is_end: Column | None = None, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Number of TER lines up to each line of its file.

    ``is_end`` marks TER rows of a table that is parsed already.
    """
    ended = F.when(text.is_ter(F.col("line")) if is_end is None else is_end, 1).otherwise(0)
    return running_total(lines, ["pdb"], ["line_no"], ended, "ter_block", rows_per_slice)


def parsed_atoms(lines: DataFrame) -> DataFrame:
    """Atom rows of structure lines, with every other column kept."""
    line = F.col("line")
    atoms = lines.where(text.is_atom(line) | text.is_hetatm(line))
    return atoms.select(*[c for c in lines.columns if c != "line"], *text.structure_fields(line))


def contact_table(atoms: DataFrame, hits: DataFrame) -> DataFrame:
    """Distinct (pdb, role, name, atom_no) of atoms in contact.

    Roles: ``chain`` for protein chains, ``co_ligand`` for hetero residues in
    the last TER block of the file, ``cofactor`` for their atoms that are kept,
    ``modified`` for hetero residues inside a chain.
    """
    last = atoms.groupBy("pdb").agg(F.max("ter_block").alias("_last"))
    near = hits.select("pdb", "record", "chain", "residue", "atom_name", "atom_no", "ter_block")
    near = near.join(last, "pdb")
    hetero = F.col("record") == "HETATM"
    tail = F.col("ter_block") == F.col("_last")
    kept = F.col("residue").isin(*KEPT_COFACTORS) & ~F.col("residue").isin(*DROPPED_COFACTORS)
    none = F.lit(None)

    def entry(on: Column, role: str, name: Column, number: Column) -> Column:
        return F.when(
            on, F.struct(F.lit(role).alias("role"), name.alias("name"), number.cast("int").alias("atom_no"))
        )

    entries = F.array(
        entry(~hetero, "chain", F.col("chain"), none),
        entry(hetero & tail, "co_ligand", F.col("residue"), none),
        entry(hetero & tail & kept, "cofactor", F.col("atom_name"), F.col("atom_no")),
        entry(hetero & ~tail, "modified", F.col("residue"), none),
    )
    return near.select("pdb", F.inline(F.array_compact(entries))).distinct()


def residue_frequency(contacts: DataFrame, role: str, more_than: int = 19) -> DataFrame:
    """In how many complexes a residue name is in contact, most frequent first."""
    rows = contacts.where(F.col("role") == role).groupBy("name").agg(F.count(F.lit(1)).alias("n_pdbs"))
    return rows.where(F.col("n_pdbs") > more_than).orderBy(F.desc("n_pdbs"), F.desc("name"))


def protein_sizes(atoms: DataFrame, contacts: DataFrame) -> DataFrame:
    """Residues over the chains in contact, for every complex with atoms."""
    chains = contacts.where("role = 'chain'").select("pdb", F.col("name").alias("chain"))
    residues = atoms.select("pdb", "chain", "res_no").distinct()
    counted = (
        residues.join(chains, ["pdb", "chain"], "left_semi")
        .groupBy("pdb")
        .agg(F.count(F.lit(1)).alias("size"))
    )
    ids = residues.select("pdb").distinct()
    return ids.join(counted, "pdb", "left").select("pdb", F.coalesce("size", F.lit(0)).alias("size"))


def curation_verdict(sizes: DataFrame, contacts: DataFrame, max_size: int = MAX_PROTEIN_SIZE) -> DataFrame:
    """(pdb, size, reason): too large, foreign co-ligand, modified residue, or kept."""
    flags = contacts.groupBy("pdb").agg(
        F.bool_or((F.col("role") == "co_ligand") & ~F.col("name").isin(*KEPT_COFACTORS)).alias("foreign"),
        F.bool_or(F.col("role") == "modified").alias("modified"),
    )
    reasons = {
        "size": F.col("size") > max_size,
        "co ligand": F.col("foreign"),
        "mutated residue": F.col("modified"),
    }
    return sizes.join(flags, "pdb", "left").select(
        "pdb", "size", first_reason(reasons).alias("reason")
    )


def size_report(sizes: DataFrame, contacts: DataFrame) -> DataFrame:
    """Entries without any chain, the smallest size, and counts above two limits."""
    chains = contacts.where("role = 'chain'").select("pdb").distinct().withColumn("_has", F.lit(True))
    return sizes.join(chains, "pdb", "left").agg(
        F.count_if(F.col("_has").isNull()).alias("without_chain"),
        F.min("size").alias("min_size"),
        F.count_if(F.col("size") > 1000).alias("above_1000"),
        F.count_if(F.col("size") > 1500).alias("above_1500"),
    )


def cleaned_lines(lines: DataFrame, contacts: DataFrame) -> DataFrame:
    """Structure lines that survive cleaning, with their line numbers.

    TER lines stay; protein atoms stay in kept chains unless hydrogen; hetero
    atoms stay when (name, number) is a kept cofactor. One row per complex holds what is
    kept, bounded by the line format (one-letter chains and five-digit atom numbers), so the
    text is read and joined once.
    """
    line = F.col("line")
    cofactor = F.struct(F.col("name").alias("name"), F.col("atom_no").alias("number"))
    kept = contacts.groupBy("pdb").agg(
        F.collect_set(F.when(F.col("role") == "chain", F.col("name"))).alias("_chains"),
        F.collect_set(F.when(F.col("role") == "cofactor", cofactor)).alias("_cofactors"),
    )
    number = F.trim(text.cut(line, 6, 11)).try_cast("int")
    atom = F.struct(text.cut(line, 12, 16).alias("name"), number.alias("number"))
    protein = text.is_atom(line) & (text.cut(line, 76, 78) != " H")
    stays = (
        text.is_ter(line)
        | (protein & F.array_contains("_chains", text.cut(line, 21, 22)))
        | (text.is_hetatm(line) & number.isNotNull() & F.array_contains("_cofactors", atom))
    )
    return lines.join(kept, "pdb", "left").where(stays).select(*lines.columns)


def index_lines(verdict: DataFrame, contacts: DataFrame) -> DataFrame:
    """Cleaned-index rows of the kept complexes: (pdb, chains, cofactors).

    The lists are bounded by the line format: one-letter chains and five-digit
    atom numbers.
    """
    label = F.concat_ws(":", "name", "atom_no")
    lists = contacts.groupBy("pdb").agg(
        F.array_sort(F.collect_set(F.when(F.col("role") == "chain", F.col("name")))).alias("chains"),
        F.array_sort(F.collect_set(F.when(F.col("role") == "cofactor", label))).alias("cofactors"),
    )
    empty = F.array().cast("array<string>")
    return (
        verdict.where("reason = 'kept'")
        .select("pdb")
        .join(lists, "pdb", "left")
        .select(
            "pdb",
            F.coalesce("chains", empty).alias("chains"),
            F.coalesce("cofactors", empty).alias("cofactors"),
        )
    )
