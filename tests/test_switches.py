"""Operators give the same result on both sides of every size switch, and on rows that lack values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from posequarry import sinks
from posequarry.functions import delta
from posequarry.operators import fitting, ordering
from posequarry.operators.skew import salted_join


def test_running_total_with_missing_keys_orders_and_a_far_value(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in ("a", None):
        rows += [(k, int(o), int(v)) for o, v in zip(rng.permutation(200), rng.integers(0, 9, 200))]
        rows += [(k, None, 1)] * 5 + [(k, 10**12, 3)]
    rows += [("b", 1, None), ("b", 2, 4), ("c", None, 7)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(4)
    plain, cut = (
        sorted(map(str, ordering.running_total(df, ["k"], ["o", "v"], F.col("v"), "t", n).collect())) for n in (10**6, 20)
    )
    assert plain == cut
    ids = ordering.sequence_ids(df, ["k"], ["o", "v"], "id", 20).groupBy("k").agg(F.countDistinct("id").alias("n"), F.max("id").alias("m"))
    assert {(r["k"], r["n"], r["m"]) for r in ids.collect()} == {("a", 206, 205), (None, 206, 205), ("b", 2, 1), ("c", 1, 0)}


def test_one_far_order_does_not_fill_one_block(spark):
    df = spark.range(2000).select(F.lit("k").alias("k"), F.col("id").alias("o")).unionAll(spark.createDataFrame([("k", 10**12)], "k string, o long"))
    got = ordering.sequence_ids(df, ["k"], ["o"], "id", 100)
    assert got.filter("id <> o").count() == 1 and got.agg(F.max("id")).first()[0] == 2000


def test_salted_join_with_missing_keys(spark):
    left = spark.createDataFrame([(None, i) for i in range(50)] + [("x", i) for i in range(50)], "k string, i int")
    right = spark.createDataFrame([("x", "y"), (None, "z")], "k string, r string")
    for how in ("inner", "left", "left_anti"):
        plain, cut = (sorted(map(str, salted_join(left, right, ["k"], how, rows_per_slice=n).collect())) for n in (10**6, 10))
        assert plain == cut


@pytest.mark.parametrize("new", [["a", "x"], ["a"], [], ["a", "b"], ["q", "b", "c", "d"], ["z"]])
def test_text_delta_of_unequal_lengths(spark, new):
    df = spark.createDataFrame([(["a", "b"], new)], "base array<string>, new array<string>")
    df = df.withColumn("d", delta.changed_lines(F.col("base"), F.col("new")))
    assert df.select(delta.patched_lines(F.col("base"), F.col("d"))).first()[0] == new


def test_fit_leaves_out_incomplete_rows_in_both_places(spark):
    rng = np.random.default_rng(1)
    rows = [("c", "train", float(x @ [2, 1]), float(x[0]), float(x[1])) for x in rng.random((60, 2))]
    whole = spark.createDataFrame(rows, "config string, part string, y double, x0 double, x1 double")
    holes = whole.unionAll(spark.createDataFrame([("c", "train", 1.0, None, 1.0), ("c", "train", None, 1.0, 1.0)], whole.schema))
    fits = [
        [r["weight"] for r in fitting.fit_weights(f, epochs=20, task_rows=n).orderBy("position").collect()]
        for f in (whole, holes)
        for n in (10**6, 1)
    ]
    for other in fits[1:]:
        np.testing.assert_allclose(fits[0], other, atol=1e-9)


def test_cluster_cache_follows_the_poses(spark, tmp_path):
    rows = [("p", i, float(i), [float(i % 3) * 10, 0.0, 0.0]) for i in range(6)]
    poses = spark.createDataFrame(rows, "pdb string, row_idx long, score double, xyz array<double>")
    cache = str(tmp_path / "cache")
    assert sinks.cached_clusters(poses.filter("row_idx < 3"), 1.0, cache).count() == 3
    assert sinks.cached_clusters(poses, 1.0, cache).count() == 6
    again = sinks.cached_clusters(poses, 1.0, cache)
    assert again.count() == 6 and again.columns.count("n_poses") == 0
    assert sinks.cached_clusters(poses.filter("row_idx < 3"), 1.0, cache).count() == 3
