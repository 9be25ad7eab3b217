"""Coordinate arithmetic on flattened (x, y, z) arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rmsd(a: Column, b: Column) -> Column:
    """Unaligned RMSD over atoms stored as one flat array; 0 without atoms."""
    squares = F.aggregate(
        F.zip_with(a, b, lambda p, q: (p.cast("double") - q) * (p.cast("double") - q)),
        F.lit(0.0),
        lambda total, value: total + value,
    )
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.sqrt(squares * 3.0 / F.size(a)))


def cell(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width))


def squared_distance(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by) + (az - bz) * (az - bz)
