"""The pipeline, stage by stage, against plain statements of what each stage keeps."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from test_trained import toxic_corpus  # noqa: E402
from test_simhash import slow_components, slow_fingerprint  # noqa: E402
from test_substrings import slow  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    rows, labels = toxic_corpus(400, seed=2)
    docs = [(i, t, lang, rng.choice(["s1", "s2", "s2", None]), len(t)) for i, t, lang in rows]
    passage = " ".join(f"p{i}" for i in range(60))
    docs += [(1000 + i, f"own{i} words{i} {passage} end{i}", "aa", "s1", 0) for i in range(5)]
    docs += [(2000 + i, docs[i][1], "aa", "s2", 0) for i in range(30)]  # copies
    docs += [(3000, None, None, None, None), (3001, "", "aa", "s1", 0), (3002, "word " * 4000, "aa", "s2", 0)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, dict(labels)


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, corpus, tmp_path):
    folder, docs, labels = corpus
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "substrings", "mixing", "encoding"]
    df = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, folder).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "encoding":
            assert after.columns == list(corpus_pipeline.COLUMNS)
        if name == "toxicity":
            gone = {d[0] for d in docs} - set(rows_of(after))
            assert all(labels.get(i % 2000, 0) == 1 for i in gone)
            missed = [i for i, t in labels.items() if t and i not in gone]
            assert len(missed) <= 0.1 * sum(labels.values())
        if name == "near_duplicates":
            texts = {r["doc_id"]: r["text"] for r in df.collect()}
            roots = slow_components({i: slow_fingerprint(t) for i, t in texts.items()})
            assert set(rows_of(after)) == set(roots.values())
            assert not any(2000 <= i < 2030 for i in rows_of(after))
        if name == "substrings":
            texts = sorted((r["doc_id"], r["text"]) for r in df.collect())
            want = slow(texts)
            for i, r in rows_of(after).items():
                n, removed, left = want[i]
                assert r["text"] == (left if removed else dict(texts)[i])
                assert r["n_chars"] == len(r["text"] or "")
            assert sum("p30" in (r["text"] or "") for r in after.collect()) == 1
        if name == "mixing":
            seen = {}
            for r in after.collect():
                seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
            assert max(seen.values()) <= 3 and 3000 not in seen and 3001 not in seen
            whole = sum(len((r["text"] or "").split()) for r in df.collect())
            mixed = sum(len(r["text"].split()) for r in after.collect())
            assert abs(mixed - whole) < 0.1 * whole
        if name == "encoding":
            texts = sorted((r["doc_id"], r["text"]) for r in df.collect())
            assert sorted((r["doc_id"], r["decoded"]) for r in after.collect()) == texts
        df = after


def test_run_equals_the_stages_and_empty_tables(spark, corpus, tmp_path):
    folder, docs, _ = corpus
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[0] == "doc_id" and 0 < out.select("doc_id").distinct().count() < len(docs)
    empty = f"{tmp_path}/empty"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_rows_without_ids(spark):
    df = spark.createDataFrame(
        [(None, "a b c d", "x", "s", 7), (None, "a b c d", "y", "s", 7), (None, "q", "z", "t", 1), (4, "q", "z", "t", 1)],
        SCHEMA,
    )
    got = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got) == [(-1, "a b c d"), (4, "q")]
