"""Annotated index, cleaned index, work list, affinity CSV and ligand files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posequarry.functions import affinity as aff
from posequarry.functions import text
from posequarry.operators.ordering import running_total
from posequarry.schemas import AFFINITY_CSV
from posequarry.sources.text_lines import number_lines, read_lines


def _entries(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    return lines.where((F.trim(line) != "") & ~F.trim(line).startswith("#"))


def parse_kd_index(lines: DataFrame) -> DataFrame:
    """(pdb, kd_M, log_kd) of the exact Kd entries among index lines."""
    fields = _entries(lines).select(text.words(F.col("line")).alias("f")).where(F.size("f") >= 4)
    rows = fields.select(
        F.lower(F.col("f")[0]).alias("pdb"), aff.exact_kd_molar(F.col("f")[3]).alias("kd_M")
    )
    return rows.where(F.col("kd_M").isNotNull()).withColumn("log_kd", F.log10("kd_M"))


def load_kd_index(spark: SparkSession, path: str) -> DataFrame:
    return parse_kd_index(read_lines(spark, path))


def parse_annotations(lines: DataFrame) -> DataFrame:
    """(pdb, resolution, affinity_raw, ligand, flags) of index lines.

    The resolution stays text: a non-numeric one is meaningful.  Ligands named
    "...mer" get the peptide flag.
    """
    halves = F.split(F.trim("line"), "//")
    rows = _entries(lines).select(
        text.words(halves[0]).alias("f"), F.get(halves, F.lit(1)).alias("note")
    )
    ligand = F.regexp_extract("note", r"\(([^)]*)", 1)
    after = F.trim(F.replace(F.regexp_replace("note", r"^[^)]*\)?", ""), F.lit(")"), F.lit("")))
    flags = F.when(after == "", F.array().cast("array<string>")).otherwise(F.split(after, ";"))
    peptide = F.when(F.col("ligand").endswith("mer"), F.array(F.lit("peptide (xmer)"))).otherwise(
        F.array().cast("array<string>")
    )
    return rows.select(
        F.col("f")[0].alias("pdb"),
        F.get("f", 1).alias("resolution"),
        F.get("f", 3).alias("affinity_raw"),
        ligand.alias("ligand"),
        flags.alias("_flags"),
    ).select(
        "pdb", "resolution", "affinity_raw", "ligand", F.concat("_flags", peptide).alias("flags")
    )


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    return parse_annotations(read_lines(spark, path))


def load_affinity_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=AFFINITY_CSV)


def parse_cleaned_index(lines: DataFrame) -> DataFrame:
    """(pdb, chains, cofactors) of ``pdb;a,b;x:1,y:2`` lines."""
    part = F.split("line", ";")

    def items(i: int):
        text_part = F.coalesce(F.get(part, F.lit(i)), F.lit(""))
        return F.when(text_part == "", F.array().cast("array<string>")).otherwise(F.split(text_part, ","))

    rows = lines.where(F.col("line") != "")
    return rows.select(part[0].alias("pdb"), items(1).alias("chains"), items(2).alias("cofactors"))


def load_cleaned_index(spark: SparkSession, path: str) -> DataFrame:
    return parse_cleaned_index(read_lines(spark, path))


def load_work_list(spark: SparkSession, path: str) -> DataFrame:
    """(item_no, pdb): work items in file order, comment lines skipped."""
    numbered = number_lines(read_lines(spark, path))
    is_item = ~F.col("line").startswith("#")
    counted = running_total(
        numbered, ["path"], ["line_no"], F.when(is_item, 1).otherwise(0), "item_no"
    )
    return counted.where(is_item).select(
        (F.col("item_no") - 1).alias("item_no"), text.work_item(F.col("line")).alias("pdb")
    )


def work_item(spark: SparkSession, path: str, index: int) -> DataFrame:
    return load_work_list(spark, path).where(F.col("item_no") == index)


def ligand_atoms(lines: DataFrame) -> DataFrame:
    """(pdb, x, y, z) of ligand file lines (pdb, line)."""
    fields = lines.where(text.is_ligand_atom_line(F.col("line"))).select(
        "pdb", text.words(F.col("line")).alias("f")
    )
    return fields.select(
        "pdb", *[F.col("f")[i].try_cast("double").alias(axis) for i, axis in enumerate("xyz")]
    )


def ligand_probe(lines: DataFrame) -> DataFrame:
    """(pdb, has_hydrogen, has_aromatic) of ligand file lines."""
    return lines.groupBy("pdb").agg(
        F.bool_or(text.has_hydrogen_mark(F.col("line"))).alias("has_hydrogen"),
        F.bool_or(text.has_aromatic_mark(F.col("line"))).alias("has_aromatic"),
    )


def load_structure_lines(spark: SparkSession, path: str, pdb_pattern: str = r"([^/_]+)[^/]*$") -> DataFrame:
    """(pdb, line_no, line) of a folder of structure files."""
    numbered = number_lines(read_lines(spark, path))
    return numbered.select(F.regexp_extract("path", pdb_pattern, 1).alias("pdb"), "line_no", "line")
