import pytest
from pyspark.sql import functions as F

from jurispark.operators import compare, folds, metrics, selection


def preds(spark, pairs):
    return spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(pairs)], "id long, y_true int, y_pred int")


def test_golden_macro_f1(spark):
    table = preds(spark, [(1, 0), (1, 0), (0, 0), (0, 0), (0, 0), (0, 0)])
    v = metrics.metric_vector(table).first()
    assert metrics.macro_scores(table).first()["f1_macro"] == pytest.approx(0.4)
    assert (v["f1_0"], v["f1_1"], v["f1_macro"]) == pytest.approx((0.8, 0.0, 0.4))
    assert (v["acc"], v["balanced_acc"], v["err_0"], v["err_1"]) == pytest.approx((4 / 6, 0.5, 0.0, 1.0))
    assert v["mcc"] == 0.0 and (v["nb0"], v["nb1"]) == (4, 2)


def test_one_class_fold_gives_null_for_the_other(spark):
    v = metrics.metric_vector(preds(spark, [(0, 0), (0, 0)])).first()
    assert v["err_1"] is None and v["f1_1"] is None and v["f1_macro"] == 1.0 and v["acc"] == 1.0


def test_swapping_labels_swaps_class_metrics(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (1, 1), (1, 0), (0, 0), (1, 1)]
    a = metrics.metric_vector(preds(spark, pairs)).first()
    b = metrics.metric_vector(preds(spark, [(1 - t, 1 - p) for t, p in pairs])).first()
    assert (a["f1_0"], a["err_0"], a["mcc"]) == pytest.approx((b["f1_1"], b["err_1"], b["mcc"]))


def test_three_class_matthews(spark):
    perfect = [(0, 0), (1, 1), (2, 2), (2, 2)]
    assert metrics.matthews(preds(spark, perfect)).first()["mcc"] == pytest.approx(1.0)


def test_folds_are_even_and_repeatable(spark):
    rows = spark.range(103).select("id", (F.col("id") % 5 == 0).cast("int").alias("label"))
    a = folds.stratified_folds(rows, 4, "label", "id", seed=1)
    counts = {(r["label"], r["fold"]): r["count"] for r in a.groupBy("label", "fold").count().collect()}
    for label in (0, 1):
        sizes = [counts[(label, f)] for f in range(4)]
        assert max(sizes) - min(sizes) <= 1
    b = folds.stratified_folds(rows.repartition(7), 4, "label", "id", seed=1)
    assert sorted(a.select("id", "fold").collect()) == sorted(b.select("id", "fold").collect())
    cv = folds.cv_expand(a, 4)
    assert cv.where("split = 'test'").count() == 103 and cv.count() == 412


def test_inner_folds_need_two_rows_per_class(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)], "id long, label int")
    assert folds.clamped_fold_count(rows, 5, "label") == 2
    with pytest.raises(ValueError):
        folds.clamped_fold_count(rows.where("id < 4"), 5, "label")


def test_balancing(spark):
    rows = spark.range(100).select("id", (F.col("id") < 15).cast("int").alias("label"))
    got = selection.balance_classes(rows, "label", "id").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {0: 15, 1: 15}


def test_single_claims(spark):
    claims = spark.createDataFrame(
        [("a", "o", "n", " accepte "), ("b", "o", "n", "rejette"), ("b", "o", "n", "accepte"), ("c", "o", "m", "x")],
        "decision string, object string, norm string, outcome string",
    )
    chosen = selection.single_claims(
        selection.matching_claims(claims, "object", "norm", "o", "n"), "decision", F.col("outcome")
    )
    assert [tuple(r) for r in chosen.collect()] == [("a", "accepte")]


def test_parameter_choice(spark):
    scores = spark.createDataFrame(
        [(1.0, 1, 0, 0.5), (1.0, 2, 0, 0.7), (1.5, 1, 0, 0.7), (1.5, 1, 1, None), (1.0, 2, 1, 0.0), (1.0, 1, 1, 0.1)],
        "nu double, n_comp int, fold int, score double",
    )
    best = compare.best_params(scores, ["nu", "n_comp"]).first()
    assert (best["nu"], best["n_comp"], best["mean_score"]) == (1.0, 2, 0.35)
    assert compare.best_params(scores.withColumn("score", F.lit(0.0)), ["nu", "n_comp"]).first() is None


def test_best_config(spark):
    rows = [
        ("z1", "v", "Tree", "a", 0.5), ("z1", "v", "Tree", "b", 0.9), ("z1", "v", "pls_gini", "a", 0.6),
        ("z1", "v", "pls_gini", "b", 0.6), ("z2", "v", "pls_gini", "a", 0.1), ("z2", "v", "pls_gini", "b", 0.2),
    ]
    scores = spark.createDataFrame(rows, "zone string, vectorization string, classifier string, category string, score double")
    config = ["zone", "vectorization", "classifier"]
    summary = compare.config_summary(scores.withColumn("metric", F.lit("f1")), config)
    ranked = compare.rank_configs(summary, config, "classifier", compare.PLS_CLASSIFIERS)
    top = {(r["scope"], r["classifier"]): r for r in ranked.collect()}
    average = top[("Average", "Tree")]
    assert (average["rank"], average["worst_category"], average["best_category"]) == (1, "a", "b")
    assert average["stability"] == pytest.approx(0.4)
    assert top[("Average", "pls_gini")]["gap_to_best"] == pytest.approx(0.1)
    assert top[("a", "pls_gini")]["rank"] == 1
