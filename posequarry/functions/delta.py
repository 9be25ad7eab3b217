"""Delta encoding of structure text against a base text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def changed_lines(base: Column, new: Column) -> Column:
    """Map line index -> new line for the lines that differ by position.

    A new text that is longer than the base has its further lines in the map; a
    shorter one has a null line where it ends.
    """
    indexed = F.transform(new, lambda v, i: F.struct(i.cast("int").alias("i"), v.alias("v")))
    changed = F.filter(
        indexed, lambda e: ~e["v"].eqNullSafe(F.get(base, e["i"].cast("int")))
    )
    end = F.array(F.struct(F.size(new).alias("i"), F.lit(None).cast("string").alias("v")))
    return F.map_from_entries(F.when(F.size(new) < F.size(base), F.concat(changed, end)).otherwise(changed))


def saved_share(base: Column, delta: Column) -> Column:
    """Share of base lines the delta does not repeat."""
    return F.lit(1.0) - F.size(delta) / F.size(base)


def patched_lines(base: Column, delta: Column) -> Column:
    """Base lines with the delta applied, as long as the new text was.

    Both sides meet as maps over the line index, which hashes the keys: linear in
    the lines, where a lookup per line would search the delta every time.
    """
    indexed = F.map_from_arrays(F.transform(base, lambda _, i: i), base)
    merged = F.map_zip_with(indexed, delta, lambda _, old, new: F.coalesce(new, old))
    ends = F.map_keys(F.map_filter(delta, lambda _, line: line.isNull()))
    last = F.greatest(F.size(base), F.coalesce(F.array_max(F.map_keys(delta)) + 1, F.lit(0)))
    return F.slice(F.map_values(merged), F.lit(1), F.coalesce(F.get(ends, F.lit(0)), last))
