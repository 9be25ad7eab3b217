"""Histograms and kernel density of two-column data."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posequarry.fixed_values import HEATMAP_BINS, HEATMAP_X, HEATMAP_Y
from posequarry.functions.metrics import bin_index
from posequarry.operators.skew import salted_join
from posequarry.session import materialize

# Cells are one kernel bandwidth wide.  The series order keeps the truncation
# error below 1e-9 and the reach drops kernel values below 1e-14.
ORDER = 20
REACH = 8


def histogram_2d(
    df: DataFrame,
    x: Column,
    y: Column,
    bins: int = HEATMAP_BINS,
    x_range: tuple[float, float] = HEATMAP_X,
    y_range: tuple[float, float] = HEATMAP_Y,
) -> DataFrame:
    """(x_bin, y_bin, n) of the occupied bins; points outside are dropped."""
    placed = df.select(
        bin_index(x, *x_range, bins).alias("x_bin"), bin_index(y, *y_range, bins).alias("y_bin")
    )
    return (
        placed.where(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
        .groupBy("x_bin", "y_bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def histogram(df: DataFrame, value: Column, bins: int, keep: Column | None = None) -> DataFrame:
    """(bin, n) over the data's own range, of the rows that pass ``keep``."""
    rows = df.where(keep) if keep is not None else df
    rows = rows.select(value.cast("double").alias("v")).where(F.col("v").isNotNull())
    ends = rows.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high"))).scalar()
    low, high = ends["low"], ends["high"]
    placed = rows.select(bin_index(F.col("v"), low, high, bins).alias("bin"))
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def _derivatives() -> dict[int, np.ndarray]:
    """For each cell offset d, the matrix coupling powers of the two local offsets.

    exp(-(d + u - v)^2 / 2) = sum over a, i of u^a v^i T_d[a, i], cut at
    a + i <= ORDER; the derivatives of the Gaussian follow Hermite's recurrence.
    """
    tables = {}
    for d in range(-REACH, REACH + 1):
        hermite = [1.0, float(d)]
        for k in range(1, ORDER):
            hermite.append(d * hermite[k] - k * hermite[k - 1])
        g = [(-1) ** k * hermite[k] * math.exp(-d * d / 2.0) for k in range(ORDER + 1)]
        table = np.zeros((ORDER + 1, ORDER + 1))
        for a in range(ORDER + 1):
            for i in range(ORDER + 1 - a):
                table[a, i] = g[a + i] * (-1) ** i / (math.factorial(a) * math.factorial(i))
        tables[d] = table
    return tables


def _shifted(axis: int):
    """Sum of coefficient matrices moved along one axis into the target cell."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        tables = _derivatives()
        total = np.zeros((ORDER + 1, ORDER + 1))
        for step, flat in zip(frame["step"], frame["m"], strict=True):
            matrix = np.asarray(flat, dtype=float).reshape(ORDER + 1, ORDER + 1)
            total += tables[step] @ matrix if axis == 0 else matrix @ tables[step].T
        return pd.DataFrame(
            {"cx": frame["cx"].iloc[:1], "cy": frame["cy"].iloc[:1], "m": [total.ravel()]}
        )

    return run


def _spread_along(cells: DataFrame, axis: int, targets: DataFrame) -> DataFrame:
    """Send each cell's matrix to the cells within reach on one axis and add up."""
    name = ("cx", "cy")[axis]
    sent = cells.withColumn("step", F.explode(F.sequence(F.lit(-REACH), F.lit(REACH))))
    sent = sent.withColumn(name, F.col(name) + F.col("step"))
    received = sent.join(targets, targets.columns, "left_semi")
    return received.groupBy("cx", "cy").applyInPandas(_shifted(axis), "cx int, cy int, m array<double>")


def kernel_density(df: DataFrame, x: str, y: str) -> DataFrame:
    """Gaussian kernel density (Scott bandwidth) at every point of the table.

    All pairs of points contribute, but no pair is formed.  Points are reduced
    to power sums per cell of the whitened plane (a partial hash aggregate), the
    sums of nearby cells are turned into one polynomial per cell - first along
    x, then along y - and each point evaluates the polynomial of its cell.  Work
    grows linearly with the rows.
    """
    rows = materialize(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()))
    m = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mx"),
        F.avg(y).alias("my"),
        F.var_samp(x).alias("vx"),
        F.var_samp(y).alias("vy"),
        F.covar_samp(x, y).alias("cxy"),
    ).first()
    factor = m["n"] ** (-1.0 / 6.0)
    covariance = np.array([[m["vx"], m["cxy"]], [m["cxy"], m["vy"]]]) * factor**2
    lower = np.linalg.cholesky(covariance)
    white = np.linalg.inv(lower)
    scale = 1.0 / (m["n"] * 2.0 * math.pi * lower[0, 0] * lower[1, 1])

    px, py = F.col(x) - F.lit(m["mx"]), F.col(y) - F.lit(m["my"])
    placed = rows.withColumn("_z1", px * F.lit(float(white[0, 0])))
    placed = placed.withColumn("_z2", px * F.lit(float(white[1, 0])) + py * F.lit(float(white[1, 1])))
    placed = placed.withColumns({"cx": F.floor("_z1").cast("int"), "cy": F.floor("_z2").cast("int")})
    placed = placed.withColumns(
        {"_u": F.col("_z1") - F.col("cx") - 0.5, "_v": F.col("_z2") - F.col("cy") - 0.5}
    )
    powers = [
        f"pow(_{axis}, {k}) AS {axis}{k}" for axis in "uv" for k in range(ORDER + 1)
    ]
    sums = [
        f"sum(u{i} * v{j})" if i + j <= ORDER else "0.0D"
        for i in range(ORDER + 1)
        for j in range(ORDER + 1)
    ]
    cells = placed.selectExpr("cx", "cy", *powers)
    cells = cells.groupBy("cx", "cy").agg(F.expr(f"array({', '.join(sums)}) AS m"))
    occupied = cells.select("cx", "cy")
    columns = _spread_along(cells, 0, occupied.select("cx").distinct())
    series = _spread_along(columns, 1, occupied)

    def horner(coefficients: Column, at: Column, term) -> Column:
        return F.aggregate(
            F.reverse(coefficients), F.lit(0.0), lambda total, c: total * at + term(c)
        )

    width = ORDER + 1
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(ORDER)), lambda i: F.slice("m", i * width + 1, width)
    )
    value = horner(rows, F.col("_u"), lambda row: horner(row, F.col("_v"), lambda c: c))
    evaluated = salted_join(placed, series, ["cx", "cy"])
    return evaluated.select(*df.columns, (value * F.lit(scale)).alias("density"))
