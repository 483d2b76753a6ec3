import pytest
from pyspark.sql import functions as F

from jurispark.operators import clusters, compare
from jurispark.operators.folds import cv_expand, stratified_folds
from jurispark.operators.matrix import Matrix, constant_features, encode_labels, feature_stats
from jurispark.sources import readers, writers


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [(f"d{i}", "accepte" if i % 3 else "rejette", f"texte numéro {i}") for i in range(12)],
        "id string, label string, text string",
    )


def test_labelled_folder(spark, tmp_path):
    for label, name, text in (("accepte", "A1.txt", "un\ndeux"), ("rejette", "B 2+é.v1.txt", "trois")):
        (tmp_path / "raw" / label).mkdir(parents=True, exist_ok=True)
        (tmp_path / "raw" / label / name).write_text(text, encoding="utf-8")
    got = {tuple(r) for r in readers.labelled_folder(spark, str(tmp_path / "raw")).collect()}
    assert got == {("A1", "accepte", "un\ndeux"), ("B 2+é", "rejette", "trois")}


def test_cv_corpus(spark, tmp_path):
    path = tmp_path / "cv-motifs" / "acpa_lemma_4_folds_cv" / "2" / "test" / "acpa-accepte"
    path.mkdir(parents=True)
    (path / "CABES1300752.txt").write_text("le texte", encoding="utf-8")
    row = readers.cv_corpus(spark, str(tmp_path)).first()
    assert tuple(row) == ("motifs", "acpa", 4, 2, "test", "accepte", "CABES1300752", "le texte")


def test_text_table_folds_and_cv(spark, docs, tmp_path):
    writers.write_text_table(docs, str(tmp_path / "t"))
    assert sorted(readers.text_table(spark, str(tmp_path / "t")).collect()) == sorted(docs.collect())
    folded = stratified_folds(docs, 3, "label", "id")
    writers.write_folds(folded, str(tmp_path / "f"))
    assert spark.read.csv(str(tmp_path / "f"), sep="\t", header=True).where("fold = 0").count() == 5
    writers.write_cv(cv_expand(folded, 3), str(tmp_path / "cv"))
    back = spark.read.csv(str(tmp_path / "cv"), sep="\t", header=True)
    assert back.where("cv = 1 and split = 'train'").count() == 8


def test_annotations_by_position(spark, tmp_path):
    lines = ["CA\tBésançon\t13/00752\tobjet\tx\tnorme\t accepte \ta\tb\tc", "court\tville\tn\tobject\tx\tnorm\tr\ta\tb\tc"]
    (tmp_path / "c.tsv").write_text("\n".join(lines), encoding="utf-8")
    row = readers.annotations(spark, str(tmp_path / "c.tsv")).where("object = 'objet'").first()
    assert tuple(row) == ("CA", "Bésançon", "13/00752", "objet", "norme", " accepte ")


def test_vector_files(spark, tmp_path):
    rows = ["@id\t@label\ta\tb\tc", "d1\tx\t1.5\t0\t3", "d2\ty\t0\t0\t3"]
    (tmp_path / "v.tsv").write_text("\n".join(rows))
    m = readers.wide_matrix(spark, str(tmp_path / "v.tsv"))
    assert {tuple(r) for r in m.cells.collect()} == {("d1", "a", 1.5), ("d1", "c", 3.0), ("d2", "c", 3.0)}
    encoded = Matrix(encode_labels(m.rows, "label").select("id", F.col("label_index").alias("label")), m.cells)
    assert {r[0] for r in constant_features(feature_stats(encoded)).collect()} == {"c"}
    writers.write_vectors(m, str(tmp_path / "p"))
    again = writers.read_vectors(spark, str(tmp_path / "p"))
    assert sorted(again.cells.collect()) == sorted(m.cells.collect())
    writers.write_wide_vectors(m, ["c", "b", "a"], str(tmp_path / "w"))
    wide = spark.read.csv(str(tmp_path / "w"), sep="\t", header=True)
    assert wide.columns == ["@id", "@label", "a", "b", "c"]
    assert {tuple(r) for r in wide.collect()} == {("d1", "x", "1.5", "0.0", "3.0"), ("d2", "y", "0.0", "0.0", "3.0")}


def test_prediction_files(spark, tmp_path):
    preds = spark.createDataFrame([("a", 1, 0), ("b", 0, 0)], "doc_id string, y_true int, y_pred int")
    writers.write_predictions(preds, str(tmp_path / "p"))
    assert sorted(readers.predictions(spark, str(tmp_path / "p")).collect()) == sorted(preds.collect())
    writers.write_predictions(preds.drop("y_true"), str(tmp_path / "q"))
    assert sorted(r["y"] for r in readers.label_column(spark, str(tmp_path / "q")).collect()) == [0, 0]
    (tmp_path / "two.txt").write_text("1 0\n0 0\n")
    assert readers.predictions(spark, str(tmp_path / "two.txt"), " ", None).count() == 2


def test_outside_classifier_outputs(spark, tmp_path):
    (tmp_path / "truth.txt").write_text("__label__a un texte\n\n__label__b autre\n")
    (tmp_path / "out.txt").write_text("__label__a 0.9\n__label__a 0.6\n")
    got = readers.supervised_predictions(spark, str(tmp_path / "truth.txt"), str(tmp_path / "out.txt"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, "__label__a", "__label__a"), (1, "__label__b", "__label__a")]
    (tmp_path / "c1.txt").write_text("x\ny\n")
    (tmp_path / "c2.txt").write_text("z\n")
    (tmp_path / "nb.txt").write_text("labels 1 -1\n1 0.3\n-1 0.2\n-1 0.9\n")
    got = readers.class_file_predictions(spark, *[str(tmp_path / n) for n in ("c1.txt", "c2.txt", "nb.txt")])
    assert sorted(tuple(r) for r in got.collect()) == [(0, "1", "1"), (1, "1", "-1"), (2, "-1", "-1")]


def test_numbered_lines_over_several_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 17) for i in range(5000)]
    (tmp_path / "big.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = readers.numbered_lines(spark, str(tmp_path / "big.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["line"] for r in sorted(got, key=lambda r: r["line_no"])] == lines
    assert [r["line_no"] for r in sorted(got, key=lambda r: r["line_no"])] == list(range(5000))


def test_cluster_files(spark, tmp_path):
    (tmp_path / "d.tsv").write_text('word\tcluster\nChat\tc1\n"chien\tc2\nshort\nchat\tc3\n')
    table = readers.cluster_dictionary(spark, str(tmp_path / "d.tsv"))
    assert {tuple(r) for r in table.collect()} == {("chat", "c3"), ('"chien', "c2")}
    counts = spark.createDataFrame([(0, "chat", 2), (1, "chat", 1), (1, "x", 5)], "doc_id long, term string, cnt long")
    postings = clusters.cluster_postings(counts, table)
    index = clusters.cluster_index(postings)
    assert tuple(index.first()) == ("c3", 1, 3, 2)
    documents = spark.createDataFrame([(0, "p0"), (1, "p1")], "doc_id long, path string")
    summary = clusters.index_summary(index, documents)
    writers.write_cluster_index(index, clusters.posting_lines(postings), documents, summary, str(tmp_path / "i"))
    info = {r["value"] for r in spark.read.text(str(tmp_path / "i" / "info")).collect()}
    assert "NB_FILES=2" in info and "SIZE_VOC=1" in info
    chunk = spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "i" / "chunk_index")).first()
    assert tuple(chunk) == ("#", "1", "1")
    held = spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "i" / "chunks")).first()
    assert (held["cluster"], held["n_docs"], held["first_doc"]) == ("c3", "2", "0")


def test_metric_files(spark, tmp_path):
    row = ("acpa", "TFIDF", "None", "Tree", *[0.5] * 8, 3, 4)
    names = "category vectorization transformation classifier acc balanced_acc err_0 err_1 f1_0 f1_1 f1_macro mcc nb0 nb1"
    table = spark.createDataFrame([row], names.split())
    writers.write_metrics(table, str(tmp_path / "m"))
    got = readers.metric_table(spark, str(tmp_path / "m"), "f1-macro-avg").first()
    assert tuple(got) == ("acpa", "TFIDF", "None", "Tree", 0.5)


def test_line_files_and_report(spark, docs, tmp_path):
    placed = docs.withColumn("split", F.lit("train"))
    writers.write_supervised_lines(placed, str(tmp_path / "s"), ["split"])
    lines = [r[0] for r in spark.read.text(str(tmp_path / "s" / "split=train")).collect()]
    assert "__label__accepte texte numéro 1." in lines
    writers.write_class_files(placed, str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c" / "split=train" / "label=rejette")).count() == 4
    writers.write_selected(docs.withColumnRenamed("label", "outcome"), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).where("outcome = 'rejette'").count() == 4
    scores = spark.createDataFrame([("z", "Tree", "a", "f1", 0.51234)], "zone string, classifier string, category string, metric string, score double")
    ranked = compare.rank_configs(compare.config_summary(scores, ["zone", "classifier"]), ["zone", "classifier"], "classifier", [])
    writers.write_comparison(ranked, ["zone", "classifier"], str(tmp_path / "r"))
    report = [r[0] for r in spark.read.text(str(tmp_path / "r" / "metric=f1" / "scope=a")).collect()]
    assert report == ["a z Tree 0.512 0.512 a 0.512 a 0.000 0.000 1"]


def test_name_list(spark, tmp_path):
    (tmp_path / "n.txt").write_text("TFIDF\n\n  TFCHI2 \n")
    assert [r["name"] for r in readers.name_list(spark, str(tmp_path / "n.txt")).collect()] == ["TFIDF", "TFCHI2"]
