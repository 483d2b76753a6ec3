"""The building blocks that keep hot keys from landing in one task."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jurispark.functions.ordering import shuffle_bucket, shuffle_key, value_bucket
from jurispark.operators import knn, skew


def test_value_bucket_follows_the_order(spark):
    rng = random.Random(0)
    values = [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(2000)]
    values += [0.0, 1.0, -1.0, 5e-324, -5e-324, 1.7e308]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = rows.select("v", value_bucket(F.col("v")).alias("b")).collect()
    ordered = [r["b"] for r in sorted(got, key=lambda r: r["v"])]
    assert ordered == sorted(ordered)


def test_running_totals(spark):
    rng = random.Random(1)
    data = [(k, v, rng.randint(1, 9)) for k in "ab" for v in {round(rng.gauss(0, 3), 2) for _ in range(300)}]
    df = spark.createDataFrame(data, "k string, v double, n long")
    got = skew.running_totals(df, ["k"], "v", ["n"], value_bucket(F.col("v"))).collect()
    assert len(got) == len(data)
    for r in got:
        assert r["n_before"] == sum(n for k, v, n in data if k == r["k"] and v < r["v"])


def test_close_values_are_cut_by_counts(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SLICE", 5000)
    u = F.col("id") / 1_000_000
    df = spark.range(1_000_000).select(
        F.lit("a").alias("k"), (1 + u * u * u * u * 0.02 + u * 1e-8).alias("v"), F.lit(1).alias("n"), "id"
    )
    plain = df.groupBy(value_bucket(F.col("v")).alias("b")).count().agg(F.max("count")).first()[0]
    assert plain > 900_000
    parts, _ = skew.cut_buckets(df, ["k"], "v", ["n"], value_bucket(F.col("v")))
    assert max(r["count"] for r in parts.groupBy("_bucket").count().collect()) <= 5000
    got = skew.running_totals(df, ["k"], "v", ["n"], value_bucket(F.col("v")))
    assert got.count() == 1_000_000 and got.where("n_before <> id").isEmpty()


def test_cut_buckets_keep_the_order_of_extremes(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SLICE", 2)
    values = sorted({0.0, 5e-324, 1e-323, 1.5e-323, -5e-324, 1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1.0 + 3 * 2**-52, -1.7e308})
    df = spark.createDataFrame([(0, v, 1) for v in values], "k long, v double, n long")
    for bucket in (value_bucket(F.col("v")), F.when(F.col("v") < -1, 0).otherwise(1)):
        got = skew.running_totals(df, ["k"], "v", ["n"], bucket).orderBy("v").collect()
        assert [r["n_before"] for r in got] == list(range(len(values)))


def test_row_numbers_equal_a_plain_window(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7 == 0).cast("int").alias("label"))
    keyed = df.withColumn("key", shuffle_key(3, F.col("id")))
    got = skew.row_numbers(keyed, ["label"], ["key", "id"], shuffle_bucket(F.col("key"), 2), "rn")
    rows = got.collect()
    for label in (0, 1):
        part = sorted((r for r in rows if r["label"] == label), key=lambda r: (r["key"], r["id"]))
        assert [r["rn"] for r in part] == list(range(1, len(part) + 1))


@pytest.mark.parametrize("right_rows", [None, 3])
def test_weighted_join_slices_hot_keys(spark, monkeypatch, right_rows):
    monkeypatch.setattr(skew, "ROWS_PER_SLICE", 10)
    left = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
        (F.col("id") % 50).cast("string")).alias("k"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("w"), F.max("id").alias("m")).where("k <> '7'")
    got = skew.weighted_join(left, right, ["k"], "w", ["id"], right_rows).select("id", "k", "m")
    want = left.join(right.select("k", "m"), "k").select("id", "k", "m")
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("limit", [0, 10])
def test_counted_join_keeps_unmatched_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(skew, "ROWS_PER_SLICE", 7)
    left = spark.range(200).select("id", F.when(F.col("id") % 3 > 0, 0).when(F.col("id") > 9, F.col("id") % 4).alias("k"))
    right = spark.createDataFrame([(0, "a"), (1, "b"), (9, "never")], "k long, v string")
    for how in ("left", "inner"):
        got = skew.counted_join(left, right, "k", ["id"], how).select("id", "k", "v")
        want = left.join(right, "k", how).select("id", "k", "v")
        order = lambda r: r["id"]
        assert sorted(got.collect(), key=order) == sorted(want.collect(), key=order)


@pytest.mark.parametrize("metric", knn.METRICS)
def test_nearest_in_block_agrees_with_all_distances(metric):
    rng = np.random.default_rng(3)
    for x, z in (
        (rng.normal(size=(30, 7)), rng.normal(size=(200, 7))),
        (rng.integers(-1, 2, (30, 4)) * 1.0, rng.integers(-1, 2, (200, 4)) * 1.0),  # many ties
        (rng.normal(size=(3, 2)) * 1e200, rng.normal(size=(4, 2)) * 1e200),
        (np.array([[np.nan, 1.0], [0.0, 1.0]]), np.array([[2.0, 1.0], [0.0, np.nan]])),
    ):
        with np.errstate(all="ignore"):
            d = knn.distances(x, z, metric)
            order = np.argsort(d, axis=1, kind="stable")[:, :5]
            rows, cols, gaps = knn.nearest_in_block(x, z, 5, metric)
        assert np.array_equal(cols.reshape(len(x), -1), order)
        assert np.array_equal(gaps, np.take_along_axis(d, order, axis=1).ravel(), equal_nan=True)
        assert np.array_equal(rows, np.repeat(np.arange(len(x)), order.shape[1]))


def test_neighbour_blocks_keep_their_own_tasks(spark):
    """Blocks have few bytes and much work: adaptive execution must not put them into one task."""
    rows = spark.range(64).select("id", (F.col("id") % 2).alias("label"), F.array(F.col("id") * 1.0).alias("features"))
    found = knn.nearest_neighbours(rows, rows.select("id", "features"), k=1, n_pivots=1, block_rows=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and ", 64), REPARTITION_BY_NUM" in plan
    assert found.where("id = train_id AND distance = 0").count() == 64
