"""Contacts, density, quantiles and fits against numpy."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from posequarry.functions.coords import rmsd
from posequarry.operators import contacts, density, fitting, quantiles
from tests.conftest import rows


def atoms_frame(spark, points, record="ATOM"):
    data = [(p, i, record, i, " C  ", "ALA", "A", i, *map(float, xyz), " C", 0) for i, (p, xyz) in enumerate(points)]
    return spark.createDataFrame(
        data,
        "pdb string, line_no long, record string, atom_no int, atom_name string, residue string, chain string, "
        "res_no int, x double, y double, z double, element string, ter_block long",
    )


def ligand_frame(spark, points):
    return spark.createDataFrame([(p, *map(float, xyz)) for p, xyz in points], "pdb string, x double, y double, z double")


def test_radius_edges(spark):
    points = [
        ("a", (7.0, 0, 0)),  # exactly at the radius
        ("a", (7.000001, 0, 0)),  # just beyond
        ("a", (-0.5, -3.0, -2.0)),  # across negative cell borders
        ("a", (-7.0, 0, 0)),
        ("a", (4.2, 5.6, 0)),  # 7.0 on a diagonal
        ("b", (0, 0, 0)),  # other complex
    ]
    hits = contacts.within_radius(atoms_frame(spark, points), ligand_frame(spark, [("a", (0, 0, 0)), ("a", (0, 0, 0))]))
    assert rows(hits.select("line_no")) == [(0,), (2,), (3,), (4,)]


@pytest.mark.parametrize("rows_per_slice", [10**6, 5])
def test_radius_equals_brute_force(spark, rows_per_slice):
    rng = np.random.default_rng(8)
    points = [(p, xyz) for p in "ab" for xyz in rng.uniform(-30, 30, (400, 3))]
    points += [("a", xyz) for xyz in rng.uniform(0, 5, (300, 3))]  # one crowded cell
    ligand = [(p, xyz) for p in "ab" for xyz in rng.uniform(-25, 25, (12, 3))]
    want = sorted(
        (i,)
        for i, (p, xyz) in enumerate(points)
        if any(q == p and ((xyz - lig) ** 2).sum() <= 49.0 for q, lig in ligand)
    )
    atoms = atoms_frame(spark, points)
    hits = contacts.within_radius(atoms, ligand_frame(spark, ligand), rows_per_slice=rows_per_slice)
    assert rows(hits.select("line_no")) == want
    assert hits.columns == atoms.columns or set(hits.columns) == set(atoms.columns)


def test_contact_roles_and_verdict(spark):
    lines = [
        ("1abc", 0, "ATOM      1  N   ALA A   1       1.000   0.000   0.000  1.00  0.00           N"),
        ("1abc", 1, "ATOM      2  H   ALA A   1       2.000   0.000   0.000  1.00  0.00           H"),
        ("1abc", 2, "ATOM      3  N   ALA B   7      90.000   0.000   0.000  1.00  0.00           N"),
        ("1abc", 3, "TER"),
        ("1abc", 4, "HETATM    4 ZN    ZN A 301       3.000   0.000   0.000  1.00  0.00          ZN"),
        ("1abc", 5, "HETATM    5  O   HOH A 302       4.000   0.000   0.000  1.00  0.00           O"),
        ("1abc", 6, "HETATM    6 MG    MG A 303      80.000   0.000   0.000  1.00  0.00          MG"),
        ("2def", 0, "HETATM    1  SE  MSE A   2       1.000   0.000   0.000  1.00  0.00          SE"),
        ("2def", 1, "TER"),
        ("2def", 2, "HETATM    2  C   ACE A   3       1.500   0.000   0.000  1.00  0.00           C"),
        ("3ghi", 0, "HETATM    1  SE  MSE A   2       1.000   0.000   0.000  1.00  0.00          SE"),
        ("3ghi", 1, "TER"),
        ("3ghi", 2, "ATOM      2  C   ALA A   3      99.000   0.000   0.000  1.00  0.00           C"),
    ]
    text = spark.createDataFrame(lines, "pdb string, line_no long, line string")
    atoms = contacts.parsed_atoms(contacts.with_ter_blocks(text))
    points = ligand_frame(spark, [(p, (0, 0, 0)) for p in ("1abc", "2def", "3ghi")])
    table = contacts.contact_table(atoms, contacts.within_radius(atoms, points))
    got = {(r["pdb"], r["role"], r["name"], r["atom_no"]) for r in table.collect()}
    assert got == {
        ("1abc", "chain", "A", None),
        ("1abc", "co_ligand", " ZN", None),
        ("1abc", "cofactor", "ZN  ", 4),
        ("1abc", "co_ligand", "HOH", None),
        ("2def", "modified", "MSE", None),
        ("2def", "co_ligand", "ACE", None),
        ("3ghi", "modified", "MSE", None),
    }
    sizes = contacts.protein_sizes(atoms, table)
    assert rows(sizes) == [("1abc", 4), ("2def", 0), ("3ghi", 0)]
    verdict = contacts.curation_verdict(sizes, table)
    assert rows(verdict.select("pdb", "reason")) == [("1abc", "kept"), ("2def", "co ligand"), ("3ghi", "mutated residue")]
    assert rows(contacts.curation_verdict(sizes, table, 3).where("pdb = '1abc'").select("reason")) == [("size",)]
    assert rows(contacts.cleaned_lines(text, table).where("pdb = '1abc'").select("line_no")) == [(0,), (3,), (4,)]
    index = contacts.index_lines(verdict, table)
    assert rows(index) == [("1abc", ["A"], ["ZN  :4"])]
    report = contacts.size_report(sizes, table).first()
    assert tuple(report) == (2, 0, 0, 0)


@pytest.mark.parametrize("n", [40, 700])
def test_kernel_density_equals_all_pairs(spark, n):
    rng = np.random.default_rng(n)
    x, y = rng.normal(0, 3, n), rng.gamma(2.0, 2.0, n)
    y[:5] += 25.0  # far points
    y += 0.6 * x
    df = spark.createDataFrame(pd.DataFrame({"i": range(n), "x": x, "y": y}))
    got = density.kernel_density(df, "x", "y").orderBy("i").toPandas()["density"].to_numpy()
    cov = np.cov(np.vstack([x, y])) * n ** (-1 / 3)
    diff = np.stack([x[:, None] - x, y[:, None] - y])
    q = np.einsum("iab,ij,jab->ab", diff, np.linalg.inv(cov), diff)
    want = np.exp(-q / 2).sum(axis=1) / (n * 2 * np.pi * np.sqrt(np.linalg.det(cov)))
    assert np.abs(got / want - 1).max() < 1e-7


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 9, 500), [5.0, -30.0]])
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = {r["bin"]: r["n"] for r in density.histogram(df, F.col("v"), 20).collect()}
    counts, _ = np.histogram(values, 20)
    assert got == {i: c for i, c in enumerate(counts) if c}
    flat = df.select(F.col("v").alias("x"), (F.col("v") / 3).alias("y"))
    cells = density.histogram_2d(flat, F.col("x"), F.col("y"), 7, (-10, 5), (-3, 1)).collect()
    want, _, _ = np.histogram2d(values, values / 3, 7, ((-10, 5), (-3, 1)))
    assert {(r["x_bin"], r["y_bin"]): r["n"] for r in cells} == {
        (i, j): int(want[i, j]) for i, j in zip(*np.nonzero(want), strict=True)
    }


@pytest.mark.parametrize(("accuracy", "limit"), [(20_000, 20_000), (2_000, 30), (50, 5)])
def test_quantiles_equal_numpy(spark, accuracy, limit):
    rng = np.random.default_rng(2)
    table = pd.DataFrame({"a": rng.normal(size=5001), "b": rng.integers(0, 5, 5001).astype(float), "c": 7.0})
    # One value makes up a third, right between many others.
    table["d"] = np.where(rng.random(5001) < 1 / 3, 0.25, rng.random(5001))
    table.loc[::9, "a"] = np.nan
    df = spark.createDataFrame(table).replace(float("nan"), None).repartition(5)
    probs = [0.0, 0.25, 0.5, 0.77, 1.0]
    got = {(r[0], r[1]): r[2] for r in quantiles.exact_quantiles(df, list(table), probs, accuracy, limit).collect()}
    for name in table:
        for p in probs:
            assert got[name, p] == pytest.approx(np.quantile(table[name].dropna(), p)), (name, p)


def test_quantiles_of_many_values_order_few(spark):
    n = 10_000_000
    value = (F.col("id") * 7919 % n).cast("double")
    # A permutation, and one with a value that half of all rows have.
    df = spark.range(n).select(value.alias("a"), F.when(value < n / 2, 3.0).otherwise(value).alias("b"))
    probs = [0.1, 0.5, 0.9]
    got = {(r[0], r[1]): r[2] for r in quantiles.exact_quantiles(df, ["a", "b"], probs).collect()}
    for p in probs:
        assert got["a", p] == pytest.approx(p * (n - 1), rel=1e-12)
    assert got["b", 0.1] == 3.0 and got["b", 0.9] == pytest.approx(0.9 * (n - 1), rel=1e-12)
    assert got["b", 0.5] == pytest.approx((3.0 + n / 2) / 2, rel=1e-12)
    long = quantiles.long_form(df, ["a", "b"])
    totals = {r["column_name"]: r for r in long.groupBy("column_name").agg(
        F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.percentile_approx("value", quantiles._cuts(20_000), 20_000).alias("cuts")).collect()}
    found = quantiles._brackets(long, [("a", n // 3, n // 3), ("b", n // 3, n // 3), ("b", n // 2, n // 2)], totals, 20_000, 1_000)
    assert len(found) == 3 and all(high - (low if name == "a" else max(low, n / 2)) <= 1_001 for name, *_, low, high in found)


def test_box_whiskers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 50.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = quantiles.box_summary(df, ["v"]).first()
    assert tuple(row) == ("v", 2.25, 3.5, 4.75, 1.0, 5.0)


def test_rmsd_expression(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0, 1.0, 1.0, 1.0], [3.0, 0.0, 0.0, 1.0, 1.0, 5.0]), ([], [])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(rmsd(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(np.sqrt(25 / 2)), 0.0]


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(4)
    parts = []
    for config, true in (("one", [0.8, 0.0, 0.3]), ("two", [0.0, 1.2, 0.0])):
        x = rng.normal(size=(400, 3))
        y = x @ np.array(true) - (x[:, 2] * 0.4 if config == "two" else 0) + rng.laplace(0, 0.1, 400)
        part = np.where(rng.random(400) < 0.7, "train", np.where(rng.random(400) < 0.5, "val", "test"))
        parts.append(pd.DataFrame({"config": config, "part": part, "pdb": [str(i) for i in range(400)], "y": y,
                                   "x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2]}))
    table = pd.concat(parts)
    return table, spark.createDataFrame(table)


def train_error(table, weights):
    out = {}
    for config, group in table[table["part"] == "train"].groupby("config"):
        w = weights[weights["config"] == config].sort_values("position")["weight"].to_numpy()
        out[config] = np.abs(group[["x0", "x1", "x2"]].to_numpy() @ w - group["y"].to_numpy()).mean()
    return out


def grid_minimum(table, config):
    """Best train error over a fine grid of non-negative weights."""
    group = table[(table["part"] == "train") & (table["config"] == config)]
    x, y = group[["x0", "x1", "x2"]].to_numpy(), group["y"].to_numpy()
    best, centre, width = np.inf, np.array([0.7, 0.7, 0.7]), 0.7
    for _ in range(7):
        axes = [np.clip(np.linspace(c - width, c + width, 9), 0, None) for c in centre]
        for w in np.stack(np.meshgrid(*axes), -1).reshape(-1, 3):
            error = np.abs(x @ w - y).mean()
            if error < best:
                best, centre = error, w
        width /= 3
    return best


def test_fits_reach_the_minimum(training):
    table, df = training
    adam = fitting.fit_weights(df, epochs=1500, lr=0.01).toPandas()
    fast = fitting.fit_reweighted(df, steps=25).toPandas()
    assert (adam["weight"] >= 0).all() and (fast["weight"] >= 0).all()
    for weights in (adam, fast):
        for config, error in train_error(table, weights).items():
            assert error <= grid_minimum(table, config) * 1.01


@pytest.mark.parametrize("kind", ["clamped", "softplus"])
def test_both_places_take_the_same_steps(training, kind):
    _, df = training
    local = fitting.fit_weights(df, kind, epochs=12, lr=0.05, validate=True)
    summed = fitting.fit_weights(df, kind, epochs=12, lr=0.05, validate=True, task_rows=10)
    a = local.toPandas().sort_values(["config", "position"])["weight"].to_numpy()
    b = summed.toPandas().sort_values(["config", "position"])["weight"].to_numpy()
    assert np.abs(a - b).max() < 1e-9


def test_batches_take_the_same_steps_in_both_places(training):
    _, df = training
    local = fitting.fit_weights(df, "softplus", epochs=3, lr=0.05, validate=True, batch=64)
    summed = fitting.fit_weights(df, "softplus", epochs=3, lr=0.05, validate=True, batch=64, task_rows=10)
    a = local.toPandas().sort_values(["config", "position"])["weight"].to_numpy()
    b = summed.toPandas().sort_values(["config", "position"])["weight"].to_numpy()
    assert np.abs(a - b).max() < 1e-9


def test_validation_keeps_the_best_weights(training):
    table, df = training
    weights = fitting.fit_weights(df, "softplus", epochs=200, lr=0.05, validate=True)
    metrics = fitting.fit_metrics(fitting.predict(df, weights))
    got = {(r["config"], r["part"]): r for r in metrics.collect()}
    assert got["one", "test"]["mae"] < 0.2 and got["one", "test"]["r"] > 0.95
    assert got["one", "train"]["n"] == ((table["config"] == "one") & (table["part"] == "train")).sum()


def test_nonnegative_minimum():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(50, 4))
    y = x @ np.array([1.0, -2.0, 0.5, 0.0])
    w = fitting.nonnegative_minimum(x.T @ x, x.T @ y)
    gradient = x.T @ x @ w - x.T @ y
    assert (w >= 0).all() and (gradient[w > 0] ** 2 < 1e-12).all() and (gradient[w == 0] >= -1e-9).all()


def optimal(a, b, w):
    """No allowed move of one weight lowers the value beyond rounding."""
    slope, size = b - a @ w, np.sqrt(np.diag(a))
    slope = slope / np.where(size > 0, size, 1)
    scale = max(np.abs(b / np.where(size > 0, size, 1)).max(), (np.abs(a / np.where(size > 0, size, 1)[:, None]) @ np.abs(w)).max(), 1e-300)
    assert (w >= 0).all()
    assert (slope <= 1e-6 * scale).all() and (np.abs(slope[w > 0]) <= 1e-6 * scale).all()


def test_nonnegative_minimum_of_dependent_terms():
    """Equal, opposite, missing and nearly equal terms, and any number of them, end at the minimum."""
    draw = np.random.default_rng(3)
    for trial in range(200):
        n, k = int(draw.integers(1, 40)), int(draw.integers(1, 12))
        x = draw.normal(size=(n, k)) * 10.0 ** draw.integers(-3, 4, k)
        for _ in range(int(draw.integers(0, 3))):
            i, j = draw.integers(0, k, 2)
            x[:, i] = x[:, j] * draw.choice([1.0, -1.0, 0.0, 3.0]) + draw.choice([0.0, 1e-9]) * draw.normal(size=n)
        y = draw.normal(size=n) + draw.choice([0.0, 5.0])
        a, b = x.T @ x, x.T @ y
        w = fitting.nonnegative_minimum(a, b)
        optimal(a, b, w)
        # No point nearby, and none with one term left out, is better.
        value = lambda v: float(((x @ v - y) ** 2).sum())
        for _ in range(5):
            near = np.maximum(w + draw.normal(size=k) * 1e-3 * (np.abs(w).max() + 1e-3), 0)
            assert value(w) <= value(near) * (1 + 1e-9) + 1e-9


def test_nonnegative_minimum_equals_all_supports():
    draw = np.random.default_rng(4)
    for _ in range(40):
        x, y = draw.normal(size=(9, 5)), draw.normal(size=9)
        best = np.inf
        for bits in range(32):
            at = [i for i in range(5) if bits >> i & 1]
            w = np.zeros(5)
            if at:
                w[at] = np.linalg.lstsq(x[:, at], y, rcond=None)[0]
            if (w >= 0).all():
                best = min(best, ((x @ w - y) ** 2).sum())
        w = fitting.nonnegative_minimum(x.T @ x, x.T @ y)
        assert ((x @ w - y) ** 2).sum() <= best + 1e-9


def test_weights_are_sorted_by_size(spark):
    weights = spark.createDataFrame([("c", 0, 0.1), ("c", 1, -0.5), ("c", 2, 0.3)], fitting.WEIGHTS)
    assert [r["position"] for r in fitting.sorted_weights(weights).collect()] == [1, 2, 0]


def test_digests_of_many_keys():
    """The vectorised digests are those of ``shuffle_digest``, also of long and empty keys."""
    keys = [str(k * 7919) for k in range(300)] + ["", "é-key", "x" * 40]
    for more in ([], ["y" * 90]):
        listed = keys + more
        found = fitting.shuffle_digests(42, [0, 7, 10, 99], pa.array([*listed, None]), at_once=64)
        for epoch, places in zip([0, 7, 10, 99], found, strict=True):
            assert places.tolist() == [*(fitting.shuffle_digest(42, epoch, k) for k in listed), -1]
