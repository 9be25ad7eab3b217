"""Whitening of vectors: blockwise QR, bidiagonal form, dqds and twisted factorisations.

Tasks reduce blocks of centred rows to triangles, a tree of tasks stacks triangles and
reduces them again, and the one left, as wide as a vector, is all the driver sees. Householder
reflections from both sides make it bidiagonal; dqds finds its singular values, small ones as
accurately as large ones, and one twisted factorisation each gives the directions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posequarry.llm.common import saved

# Rows a QR takes at a time beyond the triangle, and triangles that one task stacks.
BLOCK, FAN = 4096, 16
EPS = np.finfo(float).eps
TOO_LARGE = 9.2e18


# --- small matrices


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and orthogonal V with R = U B V' for some orthogonal U."""
    m = r.astype(float).copy()
    d = len(m)
    v = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        w = x.copy()
        largest = np.abs(x).max(initial=0.0)
        if largest == 0:
            return w, 0.0
        w[0] += np.copysign(np.linalg.norm(x / largest) * largest, x[0])
        w /= np.abs(w).max()
        return w, 2.0 / (w @ w)

    for k in range(d):
        w, c = reflector(m[k:, k])
        m[k:, k:] -= np.outer(c * w, w @ m[k:, k:])
        if k < d - 2:
            w, c = reflector(m[k, k + 1 :])
            m[k:, k + 1 :] -= np.outer(m[k:, k + 1 :] @ w, c * w)
            v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ w, c * w)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One step of the differential qd algorithm with shift, and the least d, negative if the shift was too large."""
    n = len(q)
    above, over = np.empty(n), np.empty(n - 1)
    d = least = q[0] - shift
    for i in range(n - 1):
        above[i] = d + e[i]
        if d < 0 or above[i] <= 0:
            return above, over, -1.0
        t = q[i + 1] / above[i]
        over[i] = e[i] * t
        d = d * t - shift
        least = min(least, d)
    above[n - 1] = d
    return above, over, least


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal matrix (a, b) with no zeros, largest first."""
    found: list[float] = []
    parts = [(a * a, b * b, 0.0)]
    while parts:
        q, e, moved = parts.pop()
        while len(q):
            n = len(q)
            if n == 1:
                found.append(moved + q[0])
                break
            # An e that no longer moves the value below it splits the matrix.
            small = np.flatnonzero(e <= EPS * EPS * (moved + q[1:]))
            if len(small):
                k = int(small[-1])
                if k < n - 2:
                    parts.append((q[: k + 1], e[:k], moved))
                    q, e = q[k + 1 :], e[k + 1 :]
                else:
                    found.append(moved + q[-1])
                    q, e = q[:-1], e[:-1]
                continue
            if q[0] < q[-1] and e.max() > q.min():
                # The larger end goes to the top, as zeros form at the bottom.
                q, e = _turned(q, e)
            shift = _shift(q, e)
            while True:
                above, over, least = _dqds(q, e, shift)
                if least >= 0:
                    break
                shift = shift / 4 if shift > EPS * q.min() else 0.0
            q, e, moved = above, over, moved + shift
    return np.sort(np.array(found))[::-1]


def _turned(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrix read from the other end: q and e of the transposed flipped factor, which has the same values."""
    return q[::-1].copy(), e[::-1].copy()


def _shift(q: np.ndarray, e: np.ndarray) -> float:
    """A lower bound, or nearly, of the least eigenvalue of the tridiagonal matrix that q and e stand for."""
    # Johnson's bound of the least singular value from the sums of each row and column.
    a, b = np.sqrt(q), np.sqrt(e)
    right, up = np.append(b, 0.0), np.insert(b, 0, 0.0)
    low = (a - (right + up) / 2).min()
    # The last two by two block's value, less what couples it.
    trace, det = q[-2] + e[-1] + q[-1], q[-2] * q[-1]
    least = 2 * det / (trace + np.sqrt(max(trace * trace - 4 * det, 0.0)))
    near = least - np.sqrt(e[-2] * q[-1]) if len(e) > 1 else least * (1 - 4 * EPS)
    return max(low * abs(low), near * 0.999, 0.0) if max(low, near) > 0 else 0.0


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """|gamma| of every twist of B'B - value, and the two triangular factors' multipliers."""
    n = len(a)
    d, low = a * a, b / a[:-1]
    tiny = EPS * EPS * max(value, d.max())
    stationary, multiply = np.empty(n), np.empty(max(n - 1, 0))
    s = -value
    for i in range(n - 1):
        stationary[i] = s
        pivot = s + d[i]
        pivot = pivot if abs(pivot) > tiny else np.copysign(tiny, pivot)
        multiply[i] = d[i] * low[i] / pivot
        s = multiply[i] * low[i] * s - value
    stationary[n - 1] = s
    progressive, upper = np.empty(n), np.empty(max(n - 1, 0))
    p = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        progressive[i + 1] = p
        pivot = d[i] * low[i] * low[i] + p
        pivot = pivot if abs(pivot) > tiny else np.copysign(tiny, pivot)
        t = d[i] / pivot
        upper[i] = low[i] * t
        p = p * t - value
    progressive[0] = p
    return np.abs(stationary + progressive + value), [multiply, upper]


def _vector(factors: list[np.ndarray], k: int) -> np.ndarray:
    multiply, upper = factors
    z = np.zeros(len(multiply) + 1)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -multiply[i] * z[i + 1]
    for i in range(k, len(upper)):
        z[i + 1] = -upper[i] * z[i]
    return z / np.linalg.norm(z)


def _purged(a: np.ndarray, b: np.ndarray, value: float, z: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    t = np.diag(a) + np.diag(b, 1)
    t = t.T @ t - value * (1 + 4 * EPS) * np.eye(len(a))
    for _ in range(2):
        z = np.linalg.lstsq(t, z, rcond=EPS * EPS)[0]
        for _ in range(2):
            z = reduce(lambda x, y: x - y * (x @ y), basis, z / np.linalg.norm(z))
        z = z / np.linalg.norm(z)
    return z


def right_singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the singular values of a square matrix, largest first, and its right singular vectors as columns."""
    d = len(r)
    if not d or not np.abs(r).max():
        return np.zeros(d), np.eye(d)
    scale = np.abs(r).max()
    a, b, v = bidiagonal(r / scale)
    size = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    # A zero on the diagonal moves by less than the rounding of R.
    a = np.where(np.abs(a) < EPS * size, EPS * size, a)
    # A coupling lost in the rounding of both its neighbours splits the matrix.
    least = np.minimum(np.abs(a[:-1]), np.abs(a[1:]))
    cuts = [0, *(np.flatnonzero(np.abs(b) <= d * EPS * least) + 1).tolist(), d]
    values, vectors = [], []
    for lo, hi in zip(cuts, cuts[1:]):
        aa, bb = a[lo:hi], b[lo : hi - 1]
        near: list[tuple[float, np.ndarray]] = []
        for value in squared_singular_values(aa, bb):
            gamma, factors = twisted(aa, bb, value)
            # Values this close, or lost in R's rounding, share a space: a vector must add to what the others span.
            close = any(other - value <= 1e-3 * other or other <= (10 * d * EPS * size) ** 2 for other, _ in near)
            basis = [z for _, z in near] if close else []
            best, most = None, -1.0
            for k in np.argsort(gamma, kind="stable"):
                z, left = _vector(factors, int(k)), 1.0
                for _ in range(3 if basis else 0):
                    z = reduce(lambda x, y: x - y * (x @ y), basis, z)
                    norm = max(np.linalg.norm(z), EPS)
                    z, left = z / norm, left * norm
                if left > most:
                    best, most = z, left
                if left > 0.5:
                    break
            if most < 0.5:  # What little a twist added holds other values' directions; inverse iteration takes them out.
                best = _purged(aa, bb, value, best, basis)
            near.append((value, best))
            whole = np.zeros(d)
            whole[lo:hi] = best
            values.append(value)
            vectors.append(whole)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order] * scale * scale, (v @ np.array(vectors).T)[:, order]


# --- tables


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the vector in whole numbers, of rows with no null and no non-finite entry."""
    each = F.col("embedding")
    bad = F.exists(each, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    rows = vectors.select("vec_id", "embedding").filter(each.isNotNull() & ~bad)
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * 64) + 1_000_000)
    return rows.select("vec_id", whole.cast("array<bigint>").alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly; far beyond any corpus it would not fit a long, which is an error."""
    if np.abs(x).max(initial=0) * float(n) > TOO_LARGE:
        raise OverflowError("n * x does not fit 64 bits")
    return x * n - sums


def triangle(rows: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of all rows' (x - S / n): blocks in tasks, then a tree of stacks."""
    d = len(sums)
    schema = "part long, r array<double>"

    def reduced(parts: list[np.ndarray]) -> np.ndarray:
        r = np.linalg.qr(np.concatenate(parts), mode="r")
        return np.concatenate([r, np.zeros((d - len(r), d))]) if len(r) < d else r

    def out(part: int, r: np.ndarray) -> pa.Table:
        values = pa.ListArray.from_arrays(pa.array([0, d * d], pa.int32()), pa.array(r.ravel()))
        return pa.table({"part": pa.array([part], pa.int64()), "r": values})

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, part = None, 0
        for batch in batches:
            part = batch.column(1)[0].as_py() if batch.num_rows else part
            x = _matrix(batch.column(0), d)
            for s in range(0, len(x), BLOCK):
                y = _centred(x[s : s + BLOCK], n, sums) / n
                r = reduced([y] if r is None else [r, y])
        if r is not None:
            yield from out(part, r).to_batches()

    def stack(group: pa.Table) -> pa.Table:
        r = None
        for row in group.sort_by("part")["r"]:
            one = row.values.to_numpy().reshape(d, d)
            r = one if r is None else reduced([r, one])
        return out(group["part"][0].as_py() // FAN, r)

    level = saved(rows.select("x", F.spark_partition_id().alias("part")).mapInArrow(blocks, schema), "triangles")
    while level.count() > 1:
        level = level.withColumn("up", F.expr(f"part div {FAN}")).groupBy("up")
        level = saved(level.applyInArrow(lambda key, group: stack(group.drop_columns(["up"])), schema), "triangles")
    return np.array(level.first()["r"]).reshape(d, d)


def projected(x: Column, n: int, sums: np.ndarray, weights: np.ndarray) -> Column:
    """deviation and whitened of each vector: the sum of (n x - S)^2, and the centred vector times ``weights``."""
    d = len(sums)

    @F.arrow_udf("struct<deviation:bigint,whitened:array<double>>")
    def column(values: pa.Array) -> pa.Array:
        far = _centred(_matrix(values, d), n, sums)
        if (far.astype(float) ** 2).sum(axis=1).max(initial=0) > TOO_LARGE:
            raise OverflowError("a deviation does not fit 64 bits")
        white = (far / n) @ weights
        ends = pa.array(np.arange(len(far) + 1) * weights.shape[1], pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(white.ravel()))
        return pa.StructArray.from_arrays([pa.array((far**2).sum(axis=1)), lists], ["deviation", "whitened"])

    return column.asNondeterministic()(x)


def _products(whitened: DataFrame, k: int) -> np.ndarray:
    """Sum of z z' over all rows: one matrix a task, whose entries Spark adds up."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            z = batch.column(0).flatten().to_numpy().reshape(-1, k)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["at", "v"])

    rows = whitened.select("whitened").mapInArrow(sums, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(k * k)
    for row in rows.collect():
        out[row["at"]] = row["v"]
    return out.reshape(k, k)


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """Whitened vectors, a row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Reads vec_id and embedding. Rows whose vector is null or holds a null or non-finite entry take no part, nor do
    those of another length than most have (the longer of two as frequent). Repeated rows count each, a null
    vec_id stays. Entries become whole numbers x; components are unit eigenvectors of their covariance (divisor n) by falling eigenvalue,
    as many as asked or as a vector is long. A direction without spread (as of equal rows, fewer rows than
    entries, or a constant entry) has whitened null and takes no part in identity_error; explained is null if
    no direction has any. No row left gives an empty table, vectors of no entries too.

    The driver holds one number per entry, the triangle (entries squared) and the directions.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("x").alias("d")).count()
    length = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    empty = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if length is None or not length["d"]:
        return spark.createDataFrame([], empty.format(vectors.schema["vec_id"].dataType.simpleString()))
    d = length["d"]
    rows = rows.filter(F.size("x") == d)
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("x", i)).alias(f"s{i}") for i in range(d)]).first()
    n, sums = totals["n"], np.array([totals[f"s{i}"] for i in range(d)], np.int64)
    values, directions = right_singular(triangle(rows, n, sums))
    values = values / n
    k = min(components, d)
    spread = values[:k] > values[0] * (d * EPS) ** 2 * max(n, d)
    weights = np.where(spread, directions[:, :k] / np.sqrt(np.where(spread, values[:k], 1.0)), 0.0)
    made = rows.select("vec_id", projected(F.col("x"), n, sums, weights).alias("r"))
    made = saved(made.select("vec_id", "r.deviation", "r.whitened"), "whitened")
    real = np.flatnonzero(spread)
    error = None
    if len(real):
        error = float(np.abs(_products(made, k)[np.ix_(real, real)] / n - np.eye(len(real))).max())
    total = values.sum()
    shares = [float(v / total) if total else None for v in values[:k]]
    out = made.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "z"))
    lookup = lambda xs, kind: F.get(F.array(*[F.lit(x).cast(kind) for x in xs]), F.col("at"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(lookup(spread.tolist(), "boolean"), F.col("z")).alias("whitened"),
        lookup(shares, "double").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
