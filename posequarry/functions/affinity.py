"""Parsing of measured affinities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from posequarry.fixed_values import (
    EXACT_KD_PATTERN,
    GAS_CONSTANT,
    MEASURE_DELIMITERS,
    TEMPERATURE,
    UNIT_LADDER,
    UNIT_TO_MOLAR,
)


def exact_kd_value(measure: Column) -> Column:
    """Number of an exact ``Kd=`` measurement; NULL for anything else."""
    text = F.regexp_extract(measure, EXACT_KD_PATTERN, 1)
    return F.when(text != "", text).try_cast("double")


def exact_kd_unit(measure: Column) -> Column:
    text = F.regexp_extract(measure, EXACT_KD_PATTERN, 2)
    return F.when(text != "", text)


def molar_factor(unit: Column) -> Column:
    """Unit name to molar factor as one CASE; NULL for unknown units."""
    (first, factor), *rest = UNIT_TO_MOLAR.items()
    expr = F.when(unit == first, F.lit(factor))
    for name, value in rest:
        expr = expr.when(unit == name, F.lit(value))
    return expr


def exact_kd_molar(measure: Column) -> Column:
    return exact_kd_value(measure) * molar_factor(exact_kd_unit(measure))


def measure_delimiter(measure: Column) -> Column:
    """First delimiter, in trial order, that cuts the text in exactly two."""
    tried = [
        F.when(F.size(F.split(measure, delim, -1)) == 2, F.lit(delim))
        for delim in MEASURE_DELIMITERS
    ]
    return F.coalesce(*tried)


def measure_parts(measure: Column) -> Column:
    """Struct (affinity_type, value, unit, vague) of a general measurement."""
    delim = measure_delimiter(measure)
    quantity = F.split_part(measure, delim, F.lit(2))
    return F.struct(
        F.split_part(measure, delim, F.lit(1)).alias("affinity_type"),
        F.substring(quantity, F.lit(1), F.length(quantity) - 2).try_cast("double").alias("value"),
        F.right(quantity, F.lit(2)).alias("unit"),
        (delim != "=").alias("vague"),
    )


def ladder_steps(unit: Column) -> Column:
    """Factor-1000 steps below molar; unknown units get the last, "bad" step."""
    expr = F.when(unit == UNIT_LADDER[0], F.lit(1))
    for step, name in enumerate(UNIT_LADDER[1:-1], start=2):
        expr = expr.when(unit == name, F.lit(step))
    return expr.otherwise(F.lit(len(UNIT_LADDER)))


def ladder_molar(value: Column, unit: Column) -> Column:
    return value * F.pow(F.lit(1000.0), -ladder_steps(unit))


def free_energy(molar: Column) -> Column:
    """Binding free energy in kcal/mol."""
    return F.lit(-GAS_CONSTANT * TEMPERATURE) * F.ln(molar) / F.lit(1000.0)
