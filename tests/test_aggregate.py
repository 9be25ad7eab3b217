"""Per-complex aggregation, ties, missing values and the experiment grid."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from posequarry.fixed_values import SCORE_WEIGHTS
from posequarry.functions import metrics, terms
from posequarry.functions.missing import nan_to_null
from posequarry.operators import aggregate, filters
from posequarry.plans import experiment
from posequarry.sources import store
from tests.conftest import rows

TERMS = ["fa_atr", "fa_rep", "fa_sol", "fa_elec", "fa_pair", "hbond_bb_sc", "hbond_sc"]


@pytest.fixture(scope="module")
def table():
    """Poses with ties, few rows, failing rows and missing values."""
    rng = np.random.default_rng(11)
    data = []
    for pdb, n in (("1aaa", 40), ("2bbb", 25), ("3ccc", 4), ("4ddd", 30), ("5eee", 12)):
        for i in range(n):
            row = {
                "pdb": pdb,
                "type": ["relax_docking_perturb", "apo_relax_docking_perturb", "prerelax_docking_perturb"][i % 3],
                "row_idx": i,
                "total_score": float(rng.integers(-9, 3)) if pdb != "5eee" else 5.0,
                "idelta_score": float(rng.integers(-9, 2)),
                "raw_delta_???": 0.0,
                "raw_delta_rama": 0.0,
            }
            row |= {f"raw_delta_{t}": float(rng.normal()) for t in TERMS}
            if rng.random() < 0.15:
                row["raw_delta_hbond_sc"] = float("nan")
            if rng.random() < 0.1:
                row["raw_delta_fa_pair"] = float("nan")
            if rng.random() < 0.08:
                row["idelta_score"] = float("nan")
            data.append(row)
    return pd.DataFrame(data)


@pytest.fixture(scope="module")
def poses(spark, table):
    return nan_to_null(spark.createDataFrame(table))


@pytest.fixture(scope="module")
def affinity(spark):
    data = [("1aaa", -5.5), ("2bbb", -7.25), ("3ccc", -3.0), ("4ddd", -6.0), ("5eee", -1.0)]
    return spark.createDataFrame(data, "pdb string, log_kd double")


@pytest.fixture(scope="module")
def kept(table):
    words = table["type"].str.split("_")
    mask = words.map(lambda w: "relax" in w and "perturb" in w)
    return table[mask & (table["total_score"] <= 0) & (table["idelta_score"] <= 0)]


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            if isinstance(b, float):
                assert (a is None and math.isnan(b)) or a == pytest.approx(b)
            else:
                assert a == b


def test_nan_rows_fail_the_score_filter(poses, kept):
    got = aggregate.keep_non_positive(aggregate.keep_refined_perturbed(poses))
    want = sorted(zip(kept["pdb"], kept["row_idx"], strict=True))
    assert rows(got.select("pdb", "row_idx")) == want


def test_min_takes_the_first_of_tied_rows(poses, table):
    got = aggregate.aggregate_per_pdb(poses, extra_cols=["raw_delta_fa_atr"])
    want = table.loc[table.groupby("pdb")["idelta_score"].idxmin(), ["pdb", "idelta_score", "raw_delta_fa_atr"]]
    close(rows(got), [(*r, 1.0) for r in sorted(want.itertuples(index=False, name=None))])


@pytest.mark.parametrize("n", [3, 10])
def test_mean_of_the_lowest(poses, table, n):
    cols = ["idelta_score", "raw_delta_hbond_sc"]
    got = aggregate.aggregate_per_pdb(poses, strategy="mean_n", n=n, extra_cols=cols[1:])
    ordered = table.sort_values(["idelta_score", "row_idx"], na_position="last")
    want = ordered.groupby("pdb").head(n).groupby("pdb")[cols].mean().reset_index()
    close(rows(got), [(*r, 1.0) for r in sorted(want.itertuples(index=False, name=None))])


def test_mean_of_all(poses, table):
    got = aggregate.aggregate_per_pdb(poses, strategy="filtered_mean", extra_cols=["raw_delta_fa_pair"])
    want = table.groupby("pdb")[["idelta_score", "raw_delta_fa_pair"]].mean().reset_index()
    close(rows(got), [(*r, 1.0) for r in sorted(want.itertuples(index=False, name=None))])


def test_bad_strategies(poses):
    with pytest.raises(ValueError):
        aggregate.aggregate_per_pdb(poses, strategy="median")
    with pytest.raises(ValueError):
        aggregate.aggregate_per_pdb(poses, strategy="clustered")


def test_affinity_is_joined_once_per_id(spark, poses):
    twice = spark.createDataFrame([("1aaa", -5.0), ("1aaa", -4.0)], "pdb string, log_kd double")
    n = poses.where("pdb = '1aaa'").count()
    assert aggregate.join_affinity(poses, twice).count() == n
    assert aggregate.join_affinity(poses, twice, allow_fanout=True).count() == 2 * n


def test_join_kd_drops_missing(spark):
    means = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "pdb string, s double")
    source = spark.createDataFrame(
        [("a", 2, 9.0), ("a", 1, 8.0), ("b", 1, None)], "pdb string, row_idx long, log_kd double"
    )
    assert rows(aggregate.join_kd_columns(means, source)) == [("a", 1.0, 8.0)]


def test_collapse(spark):
    data = [("a", 1, 1.0, 2.0, -5.0), ("a", 2, 3.0, 4.0, -5.0), ("b", 2, 0.0, 7.0, -6.0), ("b", 1, 0.0, 6.0, -6.0)]
    df = spark.createDataFrame(data, "pdb string, row_idx long, sample_weight double, x double, log_kd double")
    assert rows(aggregate.collapse_weighted(df, ["x"], "row_idx")) == [("a", 3.5, -5.0), ("b", 6.0, -6.0)]


def by_hand(kept, affinity, aggregation, selection, members=None):
    """Baseline row of one experiment, straight from the definitions."""
    raw = [f"raw_delta_{t}" for t in TERMS]
    df, cols = kept.copy(), [c for c in raw if c not in selection.exclude]
    for new, parts in selection.combine.items():
        df[new] = df[[p for p in parts if p in cols]].sum(axis=1)
        cols = [c for c in cols if c not in parts] + [new]
    use = ["idelta_score", *cols]
    if aggregation.strategy == "min":
        per = df.loc[df.groupby("pdb")["idelta_score"].idxmin()].set_index("pdb")[use]
    elif aggregation.strategy == "mean_n":
        lowest = df.sort_values(["idelta_score", "row_idx"]).groupby("pdb").head(aggregation.params["n"])
        per = lowest.groupby("pdb")[use].mean()
    elif aggregation.strategy == "filtered_mean":
        per = df.groupby("pdb")[use].mean()
    else:
        reps = df.merge(members, on=["pdb", "row_idx"]).dropna(subset=cols)
        per = reps.groupby("pdb")[use].mean()
    per = per.join(affinity.set_index("pdb"), how="inner").dropna(subset=cols)
    if selection.is_plain:
        score = per["idelta_score"]
    else:
        weights = {c: SCORE_WEIGHTS[c.removeprefix("raw_delta_")] for c in raw}
        weights |= {n: np.mean([weights[p] for p in ps]) for n, ps in selection.combine.items()}
        score = sum(per[c] * weights[c] for c in cols)
    x = per["log_kd"]
    return np.corrcoef(x, score)[0, 1], (x - score).abs().mean(), len(x)


def test_grid_equals_the_definitions(spark, poses, kept, affinity):
    subset = aggregate.keep_non_positive(aggregate.keep_refined_perturbed(poses))
    reps = kept.groupby("pdb").head(3)[["pdb", "row_idx"]]
    members = spark.createDataFrame(reps.assign(is_rep=True))
    experiments = [*experiment.DEFAULT_EXPERIMENTS, *experiment.clustered_experiments()]
    grid = experiment.Grid(subset, affinity, experiments, cluster_members=members)
    got = {(r["aggregation"], r["term_selection"]): r for r in grid.baseline().collect()}
    assert len(got) == 16
    for e in experiments:
        r, mae, n = by_hand(kept, affinity.toPandas(), e.aggregation, e.terms, reps)
        row = got[e.aggregation.name, e.terms.name]
        assert (row["n"], row["mae"]) == (n, pytest.approx(mae))
        assert row["r"] == pytest.approx(r)


def test_clustered_grid_needs_members(poses, affinity):
    with pytest.raises(ValueError):
        experiment.Grid(poses, affinity, experiment.clustered_experiments()).baseline()


def test_collapsed_clusters_match_the_grid(spark, poses, kept, affinity):
    subset = aggregate.keep_non_positive(aggregate.keep_refined_perturbed(poses))
    reps = kept.groupby("pdb").head(3)[["pdb", "row_idx"]]
    members = spark.createDataFrame(reps.assign(is_rep=True))
    features = [f"raw_delta_{t}" for t in TERMS]
    got = experiment.collapsed_clusters(subset, members, affinity, features)
    clustered = experiment.clustered_experiments()[:1]
    grid = experiment.Grid(subset, affinity, clustered, cluster_members=members).scatter()
    close(rows(got.select("pdb", "idelta_score")), rows(grid.select("pdb", "agg_score")))


def test_feature_discovery(poses):
    found = terms.raw_delta_columns(poses.columns)
    assert found == [f"raw_delta_{t}" for t in TERMS]
    assert terms.varying_columns(poses, [*found, "raw_delta_rama"]) == found
    chosen = terms.selected_features(found, experiment.COMBINED_VDW)
    assert list(chosen) == ["raw_delta_fa_elec", "raw_delta_hbond_combined", "raw_delta_fa_vdw"]
    weights = terms.resolve_original_weights(chosen, SCORE_WEIGHTS, experiment.COMBINED_VDW)
    assert weights["raw_delta_fa_vdw"] == pytest.approx(0.6)
    assert terms.resolve_original_weights(["raw_delta_odd"], SCORE_WEIGHTS, experiment.ALL_TERMS) == {"raw_delta_odd": 0.0}


def test_combination_of_absent_columns_is_left_out(poses):
    partial = poses.drop("raw_delta_fa_rep", "raw_delta_fa_atr")
    chosen = terms.selected_features(terms.raw_delta_columns(partial.columns), experiment.COMBINED_VDW)
    assert "raw_delta_fa_vdw" not in chosen


def test_feature_filters_treat_missing_as_removed_or_kept(spark):
    keep = filters.feature_filters()
    data = [
        (None, None, 0.5, False),
        ("IC50", False, None, None),
        ("Kd", False, 0.1, True),
        ("Kd", False, 0.2, False),
    ]
    df = spark.createDataFrame(data, "affinity_type string, vague_measures boolean, qed double, has_rare_element boolean")
    df = df.withColumns(
        {"covalent": F.lit(False), "fully_relaxed": F.lit(True), "rmsd_relax_to_crystal": F.lit(1.0),
         "relax_idelta_score": F.lit(float("nan"))}
    )
    df = nan_to_null(df)
    got = {r["filter"]: r["removed"] for r in filters.filter_impact(df, keep).collect()}
    assert got == {"affinity_type": 1, "vague_measures": 1, "covalent": 0, "fully_relaxed": 0, "qed": 2,
                   "has_rare_elem": 2, "rmsd_RelToCry": 0, "relax_idelta": 4}
    overlap = {(r[0], r[1]): r[2] for r in filters.removal_overlap(df, keep).collect()}
    assert overlap["qed", "has_rare_elem"] == overlap["has_rare_elem", "qed"] == 2
    assert overlap["qed", "qed"] == 2 and len(overlap) == 64


def test_p_value_of_a_correlation():
    # Exact cases: with four points the p-value is 1 - |r|; with three it is an arc cosine.
    assert metrics.pearson_p_value(0.3, 4) == pytest.approx(0.7)
    assert metrics.pearson_p_value(-0.5, 3) == pytest.approx(2 * math.acos(0.5) / math.pi)
    assert metrics.pearson_p_value(1.0, 9) == 0.0 and math.isnan(metrics.pearson_p_value(0.1, 2))
    assert metrics.p_value_label(1e-9) == "p-value ≈ 0" and metrics.p_value_label(0.012) == "p-value = 1.20e-02"


def test_subset_is_built_once(spark, poses, affinity, tmp_path):
    path = str(tmp_path / "subset")
    first = store.load_filtered(spark, path, poses, affinity)
    again = store.load_filtered(spark, path, poses.limit(0), affinity)
    assert rows(first.select("pdb", "row_idx")) == rows(again.select("pdb", "row_idx"))
    numbered = {}
    for r in poses.orderBy("pdb", "row_idx").collect():
        numbered.setdefault((r["pdb"], r["type"]), []).append(r["row_idx"])
    for r in first.collect():
        assert numbered[r["pdb"], r["type"]][r["type_seq_id"]] == r["row_idx"]


def test_store_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        store.PoseStore(spark, str(tmp_path / "missing"))
    empty = spark.createDataFrame([], "dataset string, pdb string, type string")
    empty.write.partitionBy("dataset").parquet(str(tmp_path / "empty" / "docking"))
    with pytest.raises(ValueError):
        store.PoseStore(spark, str(tmp_path / "empty"))


def test_pushdown_reaches_the_scan(spark, poses, tmp_path):
    path = str(tmp_path / "poses")
    poses.write.parquet(path)
    kept = aggregate.keep_non_positive(spark.read.parquet(path)).select("pdb", "idelta_score")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(total_score,0.0)" in plan and "raw_delta_fa_sol" not in plan


def test_weight_values_survive_json():
    assert json.loads(json.dumps(SCORE_WEIGHTS)) == SCORE_WEIGHTS
