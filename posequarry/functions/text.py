"""Fixed-width structure lines, ligand lines, log lines and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut(line: Column, start: int, stop: int) -> Column:
    """Characters ``start`` to ``stop`` (zero-based, end exclusive)."""
    return F.substring(line, start + 1, stop - start)


def _whole(line: Column, start: int, stop: int) -> Column:
    return F.trim(cut(line, start, stop)).try_cast("int")


def _real(line: Column, start: int, stop: int) -> Column:
    return F.trim(cut(line, start, stop)).try_cast("double")


def structure_fields(line: Column) -> list[Column]:
    """Typed fields of one structure line.  Names keep their padding."""
    return [
        F.rtrim(cut(line, 0, 6)).alias("record"),
        _whole(line, 6, 11).alias("atom_no"),
        cut(line, 12, 16).alias("atom_name"),
        cut(line, 17, 20).alias("residue"),
        cut(line, 21, 22).alias("chain"),
        _whole(line, 22, 26).alias("res_no"),
        _real(line, 30, 38).alias("x"),
        _real(line, 38, 46).alias("y"),
        _real(line, 46, 54).alias("z"),
        cut(line, 76, 78).alias("element"),
    ]


def is_atom(line: Column) -> Column:
    return line.startswith("ATOM")


def is_hetatm(line: Column) -> Column:
    return line.startswith("HETATM")


def is_ter(line: Column) -> Column:
    return line.startswith("TER")


def words(text: Column) -> Column:
    """Whitespace-separated words of the trimmed text."""
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")


def last_word(text: Column) -> Column:
    return F.element_at(words(text), -1)


def is_ligand_atom_line(line: Column) -> Column:
    """Ligand atom lines have 10 or 16 whitespace fields."""
    return F.size(words(line)).isin(10, 16)


def has_hydrogen_mark(line: Column) -> Column:
    """Atom line (longer than 49 characters) of a hydrogen."""
    return (F.length(line) > 49) & (cut(line, 31, 32) == "H")


def has_aromatic_mark(line: Column) -> Column:
    """Bond line (18 characters) of aromatic order."""
    return (F.length(line) == 18) & (cut(line, 8, 9) == "4")


def file_stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def job_family(stem: Column) -> Column:
    return F.substring_index(stem, "_", 1)


def start_label(run_type: Column) -> Column:
    """Run label without its last two words (the protocol)."""
    return F.regexp_replace(run_type, r"_[^_]*_[^_]*$", "")


def has_words(run_type: Column, *needed: str) -> Column:
    """Label holds every word as a whole ``_``-separated token."""
    tokens = F.split(run_type, "_")
    result = F.array_contains(tokens, needed[0])
    for word in needed[1:]:
        result = result & F.array_contains(tokens, word)
    return result


def clean_term(name: Column) -> Column:
    return F.regexp_replace(name, "^raw_delta_", "")


def human_size(size: Column) -> Column:
    """Bytes as text with two decimals (ties to even), in steps of 1024 up to TB."""
    units = ("B", "KB", "MB", "GB")
    expr = F.when(size == 0, F.lit("0 B"))
    for power, unit in enumerate(units):
        expr = expr.when(
            size < 1024.0 ** (power + 1),
            F.format_string(f"%.2f {unit}", F.bround(size / F.lit(1024.0**power), 2)),
        )
    return expr.otherwise(F.format_string("%.2f TB", F.bround(size / F.lit(1024.0**4), 2)))


def rename_ligand_chain(line: Column, chain: str) -> Column:
    """Put ``chain`` in the chain column of ligand lines."""
    ligand = is_hetatm(line) & (cut(line, 17, 20) == "UNK")
    return F.when(ligand, F.overlay(line, F.lit(chain), 22, 1)).otherwise(line)


def work_item(line: Column) -> Column:
    """Complex id of a work-list line: the 8-character form or the first four."""
    text = F.trim(line)
    return F.when(text.contains("_") & (F.length(text) == 8), text).otherwise(
        F.substring(text, 1, 4)
    )
