"""Helpers the operators here share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posequarry.session import scratch_path

# One word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet under the shared folder and read back.

    Cuts the lineage in a way that outlives executors, and later readers prune
    columns, which a row checkpoint does not allow.
    """
    path = scratch_path(df.sparkSession, name)
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Tables written since each scope that is open was entered.
_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A scope whose ``saved`` tables are deleted at its end, but for those that the function it gives writes.

    What leaves the scope must read none of the others. In a scope within another, kept tables belong to that one.
    """
    _OPEN.append([])

    def kept(df: DataFrame, name: str) -> DataFrame:
        out = saved(df, name)
        path = _OPEN[-1].pop()
        if len(_OPEN) > 1:
            _OPEN[-2].append(path)
        return out

    try:
        yield kept
    finally:
        for path in _OPEN.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until none of them is a column of the table."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def located(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table with two long columns that identify a row, and their names.

    Rows of a table read from Parquet (also filtered, not joined or exploded) carry a digest of their
    file's path and their place in it, which no other scan of the files can number otherwise. Any other
    table is written first.
    """
    ids = fresh(df, "_file", "_at")
    place = (F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index"))
    try:
        return df.select("*", *[c.alias(n) for c, n in zip(place, ids)]), ids
    except AnalysisException:
        written = saved(df, "rows")
        return written.select("*", *[c.alias(n) for c, n in zip(place, ids)]), ids


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run in this scope hand at most so many rows at a time to Python."""
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def lower_batches(spark: SparkSession, rows: int) -> None:
    """The same for all later jobs of the session, where a result is computed only after its function has returned."""
    if not 0 < int(spark.conf.get(_BATCH_ROWS)) <= rows:
        spark.conf.set(_BATCH_ROWS, str(rows))


def marks(keys: DataFrame, ids: list[str]) -> DataFrame:
    """One bit per row: 64 places in a row of a file share a long, 1 where ``keys`` has the row. Written."""
    file, at = ids
    bit = F.expr(f"shiftleft(1L, cast(pmod(`{at}`, 64) as int))")
    packed = keys.groupBy(F.col(file).alias("_m_file"), F.expr(f"`{at}` div 64").alias("_m_block"))
    return saved(packed.agg(F.bit_or(bit).alias("_m_bits")), "row-marks")


def selected(df: DataFrame, ids: list[str], marked: DataFrame) -> DataFrame:
    """The rows of a ``located`` table that are marked.

    Marks are so small (a long for 64 rows) that Spark broadcasts them for tables of tens of millions of rows
    under its usual threshold, and the wide rows stay where they are; beyond it joins by sorting.
    """
    file, at = ids
    same = (F.col(file) == F.col("_m_file")) & (F.expr(f"`{at}` div 64") == F.col("_m_block"))
    bit = F.expr(f"(shiftrightunsigned(_m_bits, cast(pmod(`{at}`, 64) as int)) & 1) = 1")
    return df.join(marked, same).filter(bit).select(*df.columns)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def offsets(counts: DataFrame, group: list[str], index: str, n: str, block: int = 1024) -> DataFrame:
    """Adds ``before``: the sum of ``n`` over smaller ``index`` values of the group.

    Two levels, so that no window spans more than ``block`` rows of one group
    or one row per ``block`` of them.
    """
    from pyspark.sql import Window as W

    wide = (F.floor(F.col(index) / block)).cast("long")
    marked = counts.withColumn("_wide", wide)
    inside = W.partitionBy(*group, "_wide").orderBy(index).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*group).orderBy("_wide").rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        marked.groupBy(*group, "_wide")
        .agg(F.sum(n).alias("_sum"))
        .withColumn("_past", F.coalesce(F.sum("_sum").over(across), F.lit(0)))
        .drop("_sum")
    )
    near = marked.withColumn("_near", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_wide"]]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    return (
        near.alias("a")
        .join(blocks.alias("b"), condition)
        .select("a.*", (F.col("_near") + F.col("_past")).alias("before"))
        .drop("_near", "_wide")
    )


def occurrence(rows: DataFrame, keys: list[str], row: str, least: int, name: str) -> DataFrame:
    """Adds ``name``: the place of each row among those alike in ``keys`` where there are more than ``least``, else 0.

    ``row`` is a stored ``monotonically_increasing_id``. Rows are numbered within the part that their
    number names, and parts are put in order by their counts, so however many rows are alike no
    task numbers more than a part's. Places are given to rows alike in any order.
    """
    from pyspark.sql import Window as W

    often = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > least)
    often = saved(often.select(*[F.col(c).alias(f"_often_{c}") for c in keys]), "often")
    if often.isEmpty():
        return rows.withColumn(name, F.lit(0).cast("long"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_often_{c}"))
    alike = rows.join(often, same, "left_semi").select(*keys, row, F.shiftright(row, 33).alias("_part"))
    parts = alike.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = offsets(parts, keys, "_part", "_n").select(
        *[F.col(c).alias(f"_often_{c}") for c in keys], F.col("_part").alias("_of"), "before"
    )
    inside = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(row)) - 1
    placed = alike.withColumn("_in", inside).join(before, same & (F.col("_part") == F.col("_of")))
    placed = placed.select(F.col(row).alias("_row"), (F.col("_in") + F.col("before")).cast("long").alias(name))
    found = rows.join(placed, F.col(row) == F.col("_row"), "left").drop("_row")
    return found.withColumn(name, F.coalesce(name, F.lit(0)))
