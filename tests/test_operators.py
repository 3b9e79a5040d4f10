import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import shares
from lodestone.operators.ordering import with_sequence
from lodestone.operators.quantiles import exact_percentiles
from lodestone.operators.sampling import sample_rows
from lodestone.operators.sizing import BROADCAST_CONF, hot_keys, lookup_join, measured_bytes, on_all_cores


@pytest.fixture
def nothing_fits(spark):
    """Make every lookup table count as too large to broadcast."""
    spark.conf.set(BROADCAST_CONF, "-1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset(BROADCAST_CONF)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_lookup_join_paths_agree(spark, nothing_fits, how):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, (F.col("id") / 4).cast("int").cast("string"))
    facts = spark.range(3000).select("id", key.alias("k"))  # a third hot, a third null, a third nearly unique
    names = spark.createDataFrame([("hot", 1), ("7", 2), ("9", 3)], "k string, v int")
    salted = lookup_join(facts, names, ["k"], how, ["id"])
    assert "_salt" in _plan(salted)
    got = sorted(map(tuple, salted.collect()), key=str)
    spark.conf.unset(BROADCAST_CONF)
    joined = lookup_join(facts, names, ["k"], how, ["id"])
    assert "BroadcastHashJoin" in _plan(joined)
    assert sorted(map(tuple, joined.select(*salted.columns).collect()), key=str) == got


def test_hot_keys_are_few(spark):
    facts = spark.range(1000).select(F.when(F.col("id") < 400, -1).otherwise(F.col("id")).alias("k"))
    assert [r["k"] for r in hot_keys(facts, ["k"]).collect()] == [-1]
    assert hot_keys(facts.limit(0), ["k"]).collect() == []


def test_measured_bytes(spark):
    df = spark.createDataFrame([("ab", 1), ("é", 2), (None, 3)], "s string, n int")
    assert measured_bytes(df) == 3 * 32 + 4
    assert measured_bytes(df.limit(0)) == 0


def test_one_part_is_spread(spark):
    df = spark.range(100).coalesce(1)
    assert on_all_cores(df, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, 16)
    assert on_all_cores(wide, "id").rdd.getNumPartitions() == 16


@pytest.mark.parametrize("fits", [True, False])
def test_sequence_within_hot_and_null_groups(spark, fits):
    rng = random.Random(3)
    groups = ["hot"] * 400 + [None] * 100 + [f"g{i % 30}" for i in range(200)]
    rows = [(i, g, rng.randrange(5)) for i, g in enumerate(groups)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, g string, t int").repartition(7)
    if not fits:
        spark.conf.set(BROADCAST_CONF, "-1")
    try:
        got = {r["id"]: (r["a"], r["b"]) for r in with_sequence(
            with_sequence(df, ["t", "id"], "a"), ["t", "id"], "b", ["g"]).collect()}
    finally:
        spark.conf.unset(BROADCAST_CONF)
    in_order = sorted(rows, key=lambda r: (r[2], r[0]))
    seen = {}
    for place, (i, g, _) in enumerate(in_order, 1):
        seen[g] = seen.get(g, 0) + 1
        assert got[i] == (place, seen[g])


def test_sequence_has_no_single_task_window(spark):
    plan = _plan(with_sequence(spark.range(100), ["id"]))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("slices", [None, 1, 5, 40])
def test_percentiles_equal_numpy(spark, slices):
    rng = np.random.default_rng(1)
    values = {
        "hot": np.r_[np.zeros(300), rng.exponential(20, 200)],
        "few": np.array([1.0, 2.0, 10.0]),
        "one": np.array([4.5]),
        None: rng.normal(size=17),
    }
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r["k"]: r for r in exact_percentiles(df, "v", {"p50": 0.5, "p95": 0.95}, ["k"], slices).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        assert got[k]["n"] == len(vs)
        assert got[k]["max"] == vs.max()
        assert got[k]["p50"] == pytest.approx(np.percentile(vs, 50))
        assert got[k]["p95"] == pytest.approx(np.percentile(vs, 95))


def test_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert exact_percentiles(empty, "v", {"p50": 0.5}, ["k"]).collect() == []


def test_shares_and_histogram(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 3)], "k string, n long")
    assert {r["k"]: r["share"] for r in shares.share_of_total(counts, "n").collect()} == {"a": 0.25, "b": 0.75}
    assert {r["k"]: r["scale"] for r in shares.share_of_max(counts, "n").collect()} == {"a": 0.333333, "b": 1.0}
    zero = counts.withColumn("n", F.lit(0))
    assert [r["share"] for r in shares.share_of_total(zero, "n").collect()] == [0.0, 0.0]
    scores = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.05, 0.1, 0.99, 1.0, 7.0)], "v double")
    bins = shares.histogram(scores, "v", 10, 0.0, 1.0).orderBy("bin").collect()
    assert [r["n"] for r in bins] == [3, 1, 0, 0, 0, 0, 0, 0, 0, 3]
    assert bins[0]["mid"] == 0.05
    same = shares.histogram(scores.filter("v = 7"), "v", 2).orderBy("bin").collect()
    assert [(r["mid"], r["n"]) for r in same] == [(7.25, 1), (7.75, 0)]
    assert [r["n"] for r in shares.histogram(scores.limit(0), "v", 3).collect()] == [0, 0, 0]


def test_cross_tab_leaves_out_other_values(spark):
    rows = spark.createDataFrame([("x", "p"), ("x", "p"), ("x", None), ("y", "q"), ("y", "zz")], "e string, o string")
    got = {r["e"]: (r["p"], r["q"]) for r in shares.cross_tab(rows, "e", "o", ["p", "q"]).collect()}
    assert got == {"x": (2, 0), "y": (0, 1)}


def test_sample_is_repeatable(spark):
    df = spark.range(500)
    first = sample_rows(df, "id", 10, "a").collect()
    assert first == sample_rows(df.repartition(9), "id", 10, "a").collect()
    assert first != sample_rows(df, "id", 10, "b").collect()
