"""Jobs: classes from training, the outer experiment, selection, lemmas in preprocessing."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jurispark.operators import clusters, lemmas
from jurispark.operators.matrix import Matrix, encode_labels
from jurispark.operators.pls import PLS
from jurispark.plans import jobs
from jurispark.sources import readers, writers


def test_codes_come_from_training(spark):
    preds = spark.createDataFrame([(1, "b", "b"), (2, "b", "a"), (3, "z", "b")], "id long, label string, y_pred string")
    got = {(r["id"], r["y_true"], r["y_pred"]) for r in jobs.encoded(preds, ["b", "a"]).collect()}
    assert got == {(1, 1, 1), (2, 1, 0), (3, -1, 1)}


def matrix(spark, n=40):
    rows = spark.range(n).select("id", (F.col("id") % 2).cast("int").alias("label"))
    cells = rows.select(
        "id", F.explode(F.array(F.lit("u"), F.lit("v"), F.lit("w"))).alias("feature"), "label"
    ).withColumn("value", F.when(F.col("feature") == "u", F.col("label") * 3.0 + F.col("id") % 5).otherwise(F.col("id") % 7 + 1.0))
    return Matrix(rows, cells.select("id", "feature", "value"))


def test_outer_experiment_reuses_models(spark, tmp_path):
    folds = jobs.outer_folds(matrix(spark).written(), 2)
    args = (folds, PLS("standard", 1), [1.5], [1, 2], 2, f"file://{tmp_path}/models")
    first = jobs.outer_experiment(*args).orderBy("fold", "part").collect()
    assert len(first) == 4 and all(0 <= r["f1_macro"] <= 1 and 0 <= r["accuracy"] <= 1 for r in first)
    assert jobs.outer_experiment(*args).orderBy("fold", "part").collect() == first


def test_selection_job(spark, tmp_path):
    lines = ["CA\tBésançon\t13/00752\tdam\tx\tn700\taccept \t.\t.\t.", "CA\tLyon\t14/1\tdam\tx\tn700\treject\t.\t.\t."]
    lines += ["CA\tParis\t1/1\tdam\tx\tn700\ta\t.\t.\t.", "CA\tParis\t1/1\tdam\tx\tn700\tb\t.\t.\t."]
    (tmp_path / "a.tsv").write_text("\n".join(lines))
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "CABES1300752.txt").write_text("text")
    got = jobs.select_decisions(spark, str(tmp_path / "a.tsv"), str(tmp_path / "docs"), "dam", "n700")
    assert {tuple(r) for r in got.collect()} == {("CABES1300752.txt", "accept", 1), ("CALYO141.txt", "reject", 0)}


def test_lemmas_come_before_the_filters(spark):
    docs = spark.createDataFrame([(1, "Les Chats-noirs a dorment"), (2, None)], "doc_id long, text string")
    table = spark.createDataFrame([("Chats-noirs", "Chat"), ("dorment", "d")], "token string, lemma string")
    got = {r["doc_id"]: r["text"] for r in lemmas.clean_with_lemmas(docs, table).collect()}
    assert got == {1: "les chat", 2: ""}


def test_predictions_without_the_names(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("truth\tguess\n1\t0\n0\t0\n")
    assert {tuple(r) for r in readers.predictions(spark, str(tmp_path / "p.tsv")).collect()} == {(1, 0), (0, 0)}


def test_what_a_broken_run_left_is_done_again(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, i % 2) for i in range(12)], "id long, label int")
    m = Matrix(rows, rows.select("id", F.lit(0).alias("feature"), F.col("label").cast("double").alias("value")))
    calls = []
    predict = jobs.predict_config
    monkeypatch.setattr(jobs, "predict_config", lambda *a: calls.append(a[2]) or predict(*a))
    run = lambda: sorted(map(tuple, jobs.evaluate_grid({"raw": [(0, m, m)]}, "c", ["GaussianNB"], cache=str(tmp_path)).collect()))
    first = run()
    assert run() == first and len(calls) == 1
    (where,) = tmp_path.glob("*/*/*/*/*")
    (part,) = where.glob("rows-*")
    for hurt in (
        lambda: [p.unlink() for p in (where / "manifest").iterdir()],  # ended before the manifest was committed
        lambda: [p.unlink() for p in max(where.glob("rows-*"), key=lambda p: p.stat().st_mtime).glob("*part-*")],  # rows lost
    ):
        hurt()
        assert run() == first
    assert len(calls) == 3 and part.exists()


def test_label_codes_follow_the_sorted_labels(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["b", None, "é", "a", "b", ""])], "id long, y string")
    got = {r["id"]: r["label_index"] for r in encode_labels(df, "y").collect()}
    assert got == {0: 2, 1: None, 2: 3, 3: 1, 4: 2, 5: 0}
    assert encode_labels(df, "y").columns == ["id", "y", "label_index"]


def test_a_posting_line_is_found_by_its_directory(spark):
    postings = spark.createDataFrame([("c", 10 * i, i + 1) for i in range(50)] + [("d", 3, 9)], "cluster string, doc_id long, n long")
    lines = clusters.posting_lines(postings, docs_per_line=8)
    directory = clusters.posting_directory(lines)
    assert {(r["cluster"], r["part"]): r["n_docs"] for r in directory.collect()}[("c", 6)] == 2
    found = {r["doc_id"]: r["n"] for r in clusters.read_postings(directory, lines, "c", 170).collect()}
    assert found[170] == 18 and len(found) == 8
    assert clusters.read_postings(directory, lines, "none", 1).collect() == []


def test_raw_folders_to_vectors_goes_on_where_it_stopped(spark, tmp_path):
    texts = [("accepte", "la cour condamne au paiement des sommes"), ("rejette", "la cour rejette les demandes")]
    for label, text in texts:
        (tmp_path / "raw" / label).mkdir(parents=True)
        for i in range(6):  # the same names under both labels
            (tmp_path / "raw" / label / f"d{i}.txt").write_text(f"{text} mot{i}", encoding="utf-8")
    table = spark.createDataFrame([("sommes", "somme"), ("demandes", "demande")], "token string, lemma string")
    run = lambda **more: jobs.raw_to_vectors(
        spark, str(tmp_path / "raw"), str(tmp_path / "out"), table, **{"k": 2, "schemes": ["tfidf"], "nmax": 1, **more})
    parts = {(r["cv"], r["split"]): r["path"] for r in run().collect()}
    assert sorted(parts) == [(c, s) for c in (0, 1) for s in ("test", "train")]
    seen = [row_ids(spark, parts[c, s]) for c in (0, 1) for s in ("train", "test")]
    for train, test in (seen[:2], seen[2:]):
        assert len(train | test) == 12 and not train & test
    cells = writers.read_vectors(spark, parts[0, "train"]).cells
    words = {r["feature"] for r in cells.select("feature").distinct().collect()}
    assert {"somme", "demande"} <= words and not {"sommes", "demandes"} & words

    def stamp(part):
        return (Path(parts[part]) / "cells" / "_SUCCESS").stat().st_mtime_ns

    kept, redone = stamp((0, "test")), stamp((1, "train"))
    (Path(parts[1, "train"]) / "cells" / "_SUCCESS").unlink()
    run()
    assert stamp((0, "test")) == kept and stamp((1, "train")) > redone
    assert row_ids(spark, parts[1, "train"]) == seen[2]
    with pytest.raises(ValueError):
        run(nmax=2)


def row_ids(spark, path):
    return {r["id"] for r in writers.read_vectors(spark, path).rows.collect()}
