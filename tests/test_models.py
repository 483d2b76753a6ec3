import numpy as np
import pytest
from pyspark.sql import functions as F

from jurispark.operators import knn, search
from jurispark.operators.matrix import Matrix
from jurispark.operators.pls import PLS
from jurispark.operators.registry import classifier, transformation
from jurispark.plans import jobs
from jurispark.sources import readers
from jurispark.streaming.scoring import predict_stream, score_texts


def points(spark, X, y=None):
    rows = [(i, int(y[i]) if y is not None else 0, [float(v) for v in x]) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "id long, label int, features array<double>")


def blobs(seed, n, k=4):
    rng = np.random.default_rng(seed)
    y = (np.arange(n) % 3 == 0).astype(int)
    return rng.normal(0, 1, (n, k)) + y[:, None] * np.array([3, -2, 0, 1]), y


def as_matrix(spark, X, y):
    table = points(spark, X, y)
    return Matrix.from_arrays(table, "id", F.col("label"), F.col("features"))


@pytest.mark.parametrize("metric,block_rows", [("euclidean", 7), ("manhattan", 4096), ("chebyshev", 16)])
def test_neighbours_equal_brute_force(spark, metric, block_rows):
    rng = np.random.default_rng(3)
    # A third of the train rows are copies of one point.
    X = rng.normal(0, 1, (120, 3))
    X[:40] = X[0]
    X[60:90] += 20
    Q = np.vstack([rng.normal(0, 1, (25, 3)), X[:3], X[60:63]])
    got = knn.nearest_neighbours(
        points(spark, X, np.arange(120) % 2), points(spark, Q).select("id", "features"), 5, metric,
        n_pivots=6, block_rows=block_rows,
    ).collect()
    d = knn.distances(Q, X, metric)
    for q in range(len(Q)):
        want = sorted(range(120), key=lambda i: (d[q, i], i))[:5]
        mine = sorted((r["rank"], r["train_id"]) for r in got if r["id"] == q)
        assert [t for _, t in mine] == want


def test_votes(spark):
    near = spark.createDataFrame(
        [(0, 1, 0.0), (0, 0, 1.0), (0, 0, 1.0), (1, 1, 0.5), (1, 0, 4.0), (1, 0, 4.0), (2, 0, 1.0), (2, 1, 1.0)],
        "id long, label int, distance double",
    )
    assert {r["id"]: r["y_pred"] for r in knn.vote(near).collect()} == {0: 0, 1: 0, 2: 0}
    assert {r["id"]: r["y_pred"] for r in knn.vote(near, "distance").collect()} == {0: 1, 1: 1, 2: 0}


@pytest.mark.parametrize(
    "name", ["linearDA", "quadraticDA", "GaussianNB", "KNN", "SVM", "Tree", "RandomForest", "ExtraTrees",
             "pls_standard", "pls_canonical", "pls_regression"],
)
def test_classifiers_beat_the_majority(spark, name):
    train, test = as_matrix(spark, *blobs(0, 90)), as_matrix(spark, *blobs(1, 45))
    preds = classifier(name).fit(train).predict(test)
    good = preds.where("label = y_pred").count()
    assert preds.count() == 45 and good > 34  # the majority class has 30


def test_discriminants_by_hand(spark):
    X, y = blobs(2, 60)
    Q, yq = blobs(3, 20)
    got = classifier("linearDA").fit(as_matrix(spark, X, y)).predict(as_matrix(spark, Q, yq)).collect()
    cov = sum((sum(y == c) - 1) * np.cov(X[y == c].T) for c in (0, 1)) / (len(y) - 2)
    inv = np.linalg.inv(cov)
    means = [X[y == c].mean(0) for c in (0, 1)]
    score = [Q @ inv @ m - 0.5 * m @ inv @ m + np.log((y == c).mean()) for c, m in enumerate(means)]
    assert {r["id"]: r["y_pred"] for r in got} == dict(enumerate(np.argmax(score, axis=0)))


def test_latent_semantics(spark):
    X, y = blobs(4, 30)
    m = as_matrix(spark, X, y)
    model = transformation("lsa", n_components=2).fit(m)
    s = np.linalg.svd(X, compute_uv=False)
    np.testing.assert_allclose(model.values, s[:2], rtol=1e-6)
    wide = model.transform(m).to_wide(["s1", "s2"]).toPandas()
    np.testing.assert_allclose(np.linalg.norm(wide["s1"]), s[0], rtol=1e-6)


def test_unknown_names(spark):
    for f in (classifier, transformation):
        with pytest.raises(ValueError):
            f("nope")


def test_searches(spark):
    m = as_matrix(spark, *blobs(5, 45))
    nu, h = search.select_pls_two_stage(m, PLS("standard"), [2.0], [1, 2], n_folds=2)
    assert nu == 2.0 and h in (1, 2)
    scores = search.pls_scores(m, PLS("standard"), [2.0], [1, -1], n_folds=2)
    assert scores.where("n_comp = -1 and score is null").count() == 2
    best = search.grid_search(m, "Tree", {"maxDepth": [2, 3]}, n_folds=2, smallest="maxDepth")
    assert best["maxDepth"] in (2, 3)
    some = search.random_candidates({"a": range(10), "b": range(10)}, 20, seed=1)
    assert len(some) == 20 and some == search.random_candidates({"a": range(10), "b": range(10)}, 20, seed=1)


TEXTS = [("accepte", "la cour condamne au paiement de la somme demandée"), ("rejette", "la cour déboute et rejette la demande")]


def corpus(spark, n=24):
    rows = [(f"d{i}", TEXTS[i % 2][0], f"{TEXTS[i % 2][1]} mot{i % 5}") for i in range(n)]
    return spark.createDataFrame(rows, "id string, label string, text string")


def test_text_jobs(spark, tmp_path):
    for i, (label, text) in enumerate(TEXTS * 4):
        (tmp_path / "raw" / label).mkdir(parents=True, exist_ok=True)
        (tmp_path / "raw" / label / f"d{i}.txt").write_text(text, encoding="utf-8")
    jobs.preprocess(spark, str(tmp_path / "raw"), str(tmp_path / "clean"))
    docs = readers.text_table(spark, str(tmp_path / "clean"))
    assert docs.count() == 8
    model, _ = jobs.vectorize(docs, str(tmp_path / "vsm"))
    again, _ = jobs.vectorize(docs.limit(1), str(tmp_path / "vsm"))
    assert again.n_docs == model.n_docs == 8
    vectorizer, pls = jobs.train_on_texts(corpus(spark), n_components_range=[1], nu_range=[2.0])
    preds = jobs.apply_on_texts(corpus(spark, 6), vectorizer, pls, str(tmp_path / "preds"))
    assert preds.count() == 6
    assert jobs.accuracy_of_file(spark, str(tmp_path / "preds")) == 1.0
    assert jobs.f1_of_file(spark, str(tmp_path / "preds")) == 1.0


def test_streamed_predictions_equal_batch_ones(spark, tmp_path):
    docs = corpus(spark)
    vectorizer, pls = jobs.train_on_texts(docs, n_components_range=[1], nu_range=[2.0])
    run = score_texts(vectorizer, pls)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = (
        predict_stream(stream, run, str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "y_pred")
    assert sorted(got.collect()) == sorted(run(docs).select("id", "y_pred").collect())


def test_dataset_and_grid_jobs(spark, tmp_path):
    jobs.build_dataset(corpus(spark, 16), str(tmp_path / "ds"), k=2, schemes=["tfidf"], nmax=1)
    from jurispark.sources.writers import read_vectors

    folds = [
        (f, *[read_vectors(spark, str(tmp_path / f"ds/vectors/scheme=tfidf/cv={f}/split={s}")) for s in ("train", "test")])
        for f in range(2)
    ]
    names = ["pls_canonical", "GaussianNB"]
    table = jobs.evaluate_grid({"tfidf": folds}, "acpa", names, cache=str(tmp_path / "cache"), balance=True)
    first = sorted(table.collect())
    again = jobs.evaluate_grid({"tfidf": folds}, "acpa", names, cache=str(tmp_path / "cache"))
    assert sorted(again.collect()) == first and len(first) == 2
    cv = jobs.crossval(folds, names[:1]).first()
    assert (cv["n_0"], cv["n_1"]) == (4, 4)
    best = jobs.compare_all(table.withColumn("zone", F.lit("context")))
    assert best.where("scope = 'Average' and rank = 1").count() == 3
    assert jobs.run_all_classifiers(folds[0][1], folds[0][2]).first()["classifier"] == "Tree"
