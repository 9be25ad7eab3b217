"""Order-dependent operators and skew handling against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from posequarry.operators import ordering, skew
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """One key owns most rows; order values are uneven and unique per key."""
    rng = random.Random(5)
    data = []
    for key, n in (("hot", 3000), ("warm", 300), ("cold", 7), ("one", 1)):
        order = rng.sample(range(-50, 200), min(n, 200)) + rng.sample(range(10**6, 10**9), max(0, n - 200))
        data += [(key, o, rng.randrange(4)) for o in order]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, o long, v int").repartition(6)


def expected_running(data):
    out, state = [], {}
    for k, o, v in sorted(data):
        state[k] = state.get(k, 0) + v
        out.append((k, o, state[k]))
    return out


@pytest.mark.parametrize("rows_per_slice", [10**6, 100, 7])
def test_running_total(skewed, rows_per_slice):
    data, df = skewed
    got = ordering.running_total(df, ["k"], ["o"], F.col("v"), "t", rows_per_slice)
    assert rows(got.select("k", "o", "t")) == expected_running(data)


@pytest.mark.parametrize("rows_per_slice", [10**6, 100])
def test_sequence_ids(skewed, rows_per_slice):
    data, df = skewed
    seen, want = {}, []
    for k, o, _ in sorted(data):
        want.append((k, o, seen.get(k, 0)))
        seen[k] = seen.get(k, 0) + 1
    got = ordering.sequence_ids(df, ["k"], ["o"], "s", rows_per_slice)
    assert rows(got.select("k", "o", "s")) == want


@pytest.mark.parametrize("n", [1, 10, 1500])
def test_n_smallest(skewed, n):
    data, df = skewed
    want = []
    for key in {k for k, _, _ in data}:
        want += sorted((k, o) for k, o, _ in data if k == key)[:n]
    got = ordering.n_smallest(df, ["k"], [F.col("o")], n)
    assert rows(got.select("k", "o")) == sorted(want)


def test_group_limit_runs_before_the_shuffle(skewed):
    _, df = skewed
    plan = ordering.n_smallest(df, ["k"], [F.col("o")], 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("rows_per_slice", [10**6, 50])
def test_salted_join(spark, skewed, how, rows_per_slice):
    _, df = skewed
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("cold", 3), ("none", 4)], "k string, w int")
    got = skew.salted_join(df, right, ["k"], how, rows_per_slice=rows_per_slice)
    assert rows(got) == rows(df.join(right, "k", how)) or how == "left"
    if how == "left":
        key = [F.coalesce("w", F.lit(-1)).alias("w")]
        assert rows(got.select("k", "o", *key)) == rows(df.join(right, "k", how).select("k", "o", *key))


def test_salted_join_with_condition_and_screen(spark, skewed):
    _, df = skewed
    right = spark.createDataFrame([("hot", 1, 100), ("hot", 2, 10**8), ("warm", 0, 50)], "k string, v int, top long")
    condition = F.col("o") < F.col("top")
    for limit in (10**6, 20):
        got = skew.salted_join(df, right, ["k", "v"], "left_semi", condition, limit, ["k"])
        tops = {("hot", 1): 100, ("hot", 2): 10**8, ("warm", 0): 50}
        want = sorted(tuple(r) for r in df.collect() if r["o"] < tops.get((r["k"], r["v"]), -(10**9)))
        assert rows(got) == want


def test_hot_keys_are_few_and_sliced(skewed):
    _, df = skewed
    limit = skew.hot_limit(df, ["k"], 100)
    assert limit == 100.0
    assert rows(skew.hot_keys(df, ["k"], limit)) == [("hot", 30), ("warm", 3)]
    assert skew.hot_limit(df, ["k"], 10_000) is None
