import math

import pytest
from pyspark.sql import functions as F

from jurispark.functions import text as T
from jurispark.functions.weights import Scheme, get_scheme, register_scheme
from jurispark.operators import clusters, lemmas, terms
from jurispark.operators.vectorizer import Vectorizer, VectorizerModel

SENTENCES = [
    (0, 0, "our court is seized of our appeal"),
    (1, 0, "our judge is seized of our claim"),
    (2, 1, "our clerk filed two letters on monday"),
    (3, 1, "our neighbours met at our well"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(SENTENCES, "doc_id long, label int, text string")


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("appel ;;;;; jugement première nantes rejeter la demande",
         "appel jugement première nantes rejeter la demande"),
        ("Un mot, a 12 Été bleu\n\tfin", "un été bleu fin"),
        ("", ""),
        (None, ""),
        ("   ", ""),
    ],
)
def test_clean_text(spark, raw, want):
    assert one(spark, T.clean_text(F.col("t")), raw) == want


def test_switches(spark):
    column = T.clean_text(F.col("t"), lower=False, remove_punctuation=False, remove_single=False)
    assert one(spark, column, " A  b, 1 ") == "A b, 1"


def test_ngrams(spark):
    words = F.split("t", " ")
    assert one(spark, T.ngram_range(words, 1, 2), "a b c") == ["a", "b", "c", "a b", "b c"]
    assert one(spark, T.ngrams(words, 3), "a b") == []
    with pytest.raises(ValueError):
        T.ngram_range(words, 2, 1)


def test_line_forms(spark):
    assert one(spark, T.class_file_line(F.col("t")), "A,b\nC<br />d (e)!") == "a , b c d ( e ) !"
    assert one(spark, T.supervised_line(F.lit("accepte"), F.col("t")), " a\n b ") == "__label__accepte a b."
    assert one(spark, T.strip_markers(F.col("t")), "a <x argent y>b</norme> <p>") == "a b <p>"
    assert one(spark, T.strip_accents(F.col("t")), "Éàçœ") == "Eacoe"
    key = T.decision_key(F.lit("ca"), F.col("t"), F.lit("13/00752"))
    assert one(spark, key, "bés") == "CABES1300752.txt"


def test_bags_and_frequencies(docs):
    grams = terms.with_ngrams(docs)
    counts = {(r["doc_id"], r["term"]): (r["cnt"], r["size"]) for r in terms.term_counts(grams, ["doc_id"]).collect()}
    assert counts[(0, "our")] == (2, 7) and counts[(2, "monday")] == (1, 7)
    df = {r["term"]: r["df"] for r in terms.vocabulary(grams).collect()}
    assert df == {"our": 4, "is": 2, "seized": 2, "of": 2}


def test_idf_and_chi2(docs):
    idf = Vectorizer("tf-idf").fit(docs)
    assert {r["term"]: r["gweight"] for r in idf.table.collect()} == pytest.approx(
        {"is": math.log(2), "seized": math.log(2), "of": math.log(2)}
    )
    chi2 = Vectorizer("tfchi2").fit(docs)
    assert {r["term"]: r["gweight"] for r in chi2.table.collect()} == pytest.approx(
        {"is": 1.0, "seized": 1.0, "of": 1.0}
    )


@pytest.mark.parametrize("norm", ["compat", "l2", None])
def test_vectors(docs, norm):
    got = {(r["doc_id"], r["term"]): r["weight"] for r in Vectorizer("tfidf", norm=norm).fit_transform(docs).collect()}
    w = math.log(2) / 7
    length = math.sqrt(3) * w
    want = {"compat": w * length, "l2": w / length, None: w}[norm]
    assert len(got) == 6 and all(v == pytest.approx(want) for v in got.values())


def test_three_classes(spark):
    docs = spark.createDataFrame(
        [(0, "x", "a b"), (1, "y", "a c"), (2, "z", "b c"), (3, "z", "a")], "doc_id long, label string, text string"
    )
    scores = terms.chi2_scores(terms.with_ngrams(docs)).collect()
    assert len(scores) == 9
    best = {}
    for r in scores:
        best[r["term"]] = max(best.get(r["term"], -9), r["chi2"])
    model = Vectorizer("tfchi2").fit(docs)
    assert {r["term"]: r["gweight"] for r in model.table.collect()} == pytest.approx(
        {t: v for t, v in best.items() if v}
    )


def test_model_round_trip_and_unknown_terms(spark, docs, tmp_path):
    model = Vectorizer("tfidf").fit(docs)
    model.save(str(tmp_path / "v"))
    again = VectorizerModel.load(spark, str(tmp_path / "v"))
    new = spark.createDataFrame([(9, "is zebra zebra seized"), (10, "zebra"), (11, None)], "doc_id long, text string")
    rows = {(r["doc_id"], r["term"]) for r in again.transform(new).collect()}
    assert rows == {(9, "is"), (9, "seized")}


def test_schemes():
    assert get_scheme("TF-CHI2") is get_scheme("tfchi2")
    with pytest.raises(ValueError):
        get_scheme("nope")
    register_scheme("count", Scheme(lambda cnt, size: cnt, lambda n, df, a, b: F.lit(1.0)))
    assert get_scheme("count").uses_labels is False


def test_lemmas(spark):
    docs = spark.createDataFrame([(0, ["chats", "et", "chats"]), (1, [])], "doc_id long, words array<string>")
    table = spark.createDataFrame([("chats", "chat")], "token string, lemma string")
    got = {r["doc_id"]: r["words"] for r in lemmas.lemmatize(docs, table).collect()}
    assert got == {0: ["chat", "et", "chat"], 1: []}


def test_cluster_lines_are_cut_but_whole(spark):
    postings = spark.createDataFrame([("c", i, i + 1) for i in range(50)], "cluster string, doc_id long, n long")
    lines = clusters.posting_lines(postings, docs_per_line=10).collect()
    assert len(lines) > 1
    entries = [e for r in lines for e in r["postings"].split(":")]
    assert sorted(entries) == sorted(f"{i}-{i + 1}" for i in range(50))


def test_weights_without_broadcasts(docs, monkeypatch):
    from jurispark.operators import skew

    want = sorted(Vectorizer("tfidf").fit_transform(docs).collect())
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "ROWS_PER_SLICE", 1)
    got = sorted(Vectorizer("tfidf").fit_transform(docs).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r["weight"] for r in got] == pytest.approx([r["weight"] for r in want])


def test_null_tokens_are_no_terms(spark):
    df = spark.createDataFrame([(1, [None, "a", "b", "a"])], "doc_id long, ngrams array<string>")
    got = {(r["term"], r["cnt"], r["size"]) for r in terms.term_counts(df, ["doc_id"]).collect()}
    assert got == {("a", 2, 3), ("b", 1, 3)}


def test_posting_lines_are_numbered_in_id_order(spark):
    rows = [("c", i, 1) for i in range(0, 300_000, 1000)] + [("d", 5, 2)]
    df = spark.createDataFrame(rows, "cluster string, doc_id long, n long")
    got = {(r["cluster"], r["part"]): r["postings"] for r in clusters.posting_lines(df, docs_per_line=100).collect()}
    assert got[("d", 0)] == "5-2" and sorted(k for k in got if k[0] == "c") == [("c", 0), ("c", 1), ("c", 2)]
    assert got[("c", 1)].split(":") == [f"{i}-1" for i in range(100_000, 200_000, 1000)]


def test_letter_words_in_one_pass(spark):
    """The pattern over whole texts finds what splitting and filtering tokens finds."""
    texts = [
        None, "", " ", "a", "ab", " ab\n", "ab cd", "ab\u0085cd\u00a0ef\u2028gh", "\x1cAB\x1fCD\x0b", "ab\x00cd ef\u200b",
        "\u00c9lan \u0152uvre \u03a3\u0391\u03a3 \u0130STANBUL \u1e9e\u00df", "x\U00020000y \U00020000\U00020001 \U0001d400",
        "\U0001f600ab ab\U0001f600 cd", "ab, cd. (ef) g-h ij\r\nkl", "\ufeffab e\u0301le 12 ab3 3ab",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    one_by_one = F.transform(T.clean_tokens(T.tokens(F.col("t"))), F.lower)
    got = rows.select(one_by_one.alias("a"), T.clean_words(F.col("t")).alias("b"), T.tokens(F.col("t")).alias("t")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]
    assert got[0]["t"] == [] and got[5]["t"] == ["ab"] and got[7]["t"] == ["ab", "cd", "ef", "gh"]
    plan = rows.select(T.clean_words(F.col("t")).alias("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "RLIKE" not in plan


def _texts_read(monkeypatch, module):
    """Schemas of what a module writes to scratch tables, in order."""
    seen, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df: seen.append(df.columns) or write(df))
    return seen


def test_fit_transform_counts_texts_once(spark, monkeypatch):
    from jurispark.operators import vectorizer

    rows = [(1, ["a", "b", "b", None]), (1, ["c", "b"]), (2, ["a", "d", "a"]), (3, []), (None, ["c", "d"])]
    docs = spark.createDataFrame(rows, "doc_id int, words array<string>")
    for norm in ("compat", "l2", None):
        v = Vectorizer("tfidf", norm=norm, df_min=1)
        plain = v.fit(docs, words="words").transform(docs, words="words")
        seen = _texts_read(monkeypatch, vectorizer)
        got = v.fit_transform(docs, words="words")
        assert ["doc_id", "size", "bag"] in seen
        key = lambda r: (r["doc_id"] or 0, r["term"], r["weight"])
        assert [(r[0], r[1], round(r[2], 9)) for r in sorted(got.collect(), key=key)] == [
            (r[0], r[1], round(r[2], 9)) for r in sorted(plain.collect(), key=key)
        ]
        # Only documents move: weights are broadcast and norms are taken where the bags are.
        plan = got.select("*")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == (1 if norm else 0)


def test_lemmas_move_documents_not_tokens(spark):
    docs = spark.createDataFrame([(1, "Cats eat  mice 7"), (2, None), (3, "no cats")], "doc_id int, text string")
    small = spark.createDataFrame([("cats", "cat"), ("Cats", "Cat")], "token string, lemma string")
    out = lemmas.clean_with_lemmas(docs, small)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "cat eat mice", 2: "", 3: "no cat"}
    plan = out.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan


def test_posting_lines_write_postings_once(spark, monkeypatch):
    rows = spark.createDataFrame([("a", i, 1) for i in range(5)] + [("b", 2, 3)], "cluster string, doc_id long, n long")
    seen = _texts_read(monkeypatch, clusters)
    got = {(r["cluster"], r["part"]): r["postings"] for r in clusters.posting_lines(rows, docs_per_line=3).collect()}
    assert seen == [["cluster", "doc_id", "n"]]
    assert got == {("a", 0): "0-1:1-1:2-1", ("a", 1): "3-1:4-1", ("b", 0): "2-3"}
