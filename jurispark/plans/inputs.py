"""How the registered queries read the tables, and the same readings as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.folds import stratified_folds
from ..operators.matrix import Matrix
from ..shipping import ship_package
from ..sources.spread import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, spread over the cores if the file is small."""
    return spread(table(spark, sf, "documents"), "doc_id")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a quality label and their clean tokens (doc_id, label, words)."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return docs.join(labels, "doc_id").select(
        "doc_id", "label", T.clean_words(F.col("text")).alias("words")
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with their clean tokens (doc_id, words)."""
    return documents(spark, sf).select("doc_id", T.clean_words(F.col("text")).alias("words"))


def all_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with their clean tokens, and the quality label of those that have one."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return texts(spark, sf).join(labels, "doc_id", "left").select("doc_id", "label", "words")


def matrix(spark: SparkSession, sf: str) -> Matrix:
    """Embedding vectors with a 0/1 label, as rows and cells."""
    return Matrix.from_arrays(
        spread(table(spark, sf, "embeddings"), "vec_id"),
        "vec_id",
        (F.col("label") >= 5).cast("int"),
        F.col("embedding").cast("array<double>"),
    )


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as claims: decision, object, norm, outcome."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_orderkey").alias("decision"),
        F.col("l_linestatus").alias("object"),
        F.col("o_orderpriority").alias("norm"),
        F.concat(F.lit(" "), "l_returnflag", F.lit(" ")).alias("outcome"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Length rules as classifiers: one prediction per labelled document, rule and fold."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y_true"))
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = stratified_folds(docs.join(labels, "doc_id"), 4, "y_true", "doc_id")
    limits = F.array(*[F.lit(x) for x in (500, 1000, 1500, 2000)])
    return rows.withColumn("limit", F.explode(limits)).select(
        "doc_id",
        "lang",
        "source",
        "fold",
        F.concat(F.lit("len"), F.col("limit").cast("string")).alias("classifier"),
        "y_true",
        (F.col("n_chars") > F.col("limit")).cast("int").alias("y_pred"),
    )


# --- the same readings in SQL -------------------------------------------------

WS = r"[\s\p{Z}\x0B\x1C-\x1F\x85]+"


def sql_tokens(col: str) -> str:
    return (
        f"list_filter(string_split(trim(regexp_replace({col}, '{WS}', ' ', 'g')), ' '), "
        "lambda t: t <> '')"
    )


def sql_clean(col: str) -> str:
    return (
        f"list_transform(list_filter({sql_tokens(col)}, "
        "lambda t: regexp_full_match(t, '\\p{L}+') AND length(t) > 1), lambda t: lower(t))"
    )


LABELLED = f"""docs AS (
  SELECT doc_id, quality AS label, {sql_clean('text')} AS words
  FROM documents JOIN labels USING (doc_id))"""

# All documents, labelled or not.
TEXTS = LABELLED.replace("JOIN labels", "LEFT JOIN labels")

# Unigrams of the documents with the number of n-grams of each document.
_COUNTS = """, grams AS (SELECT doc_id, label, unnest(words) AS term FROM docs),
tc AS (SELECT doc_id, label, term, count(*) AS cnt FROM grams GROUP BY ALL),
sizes AS (SELECT doc_id, len(words) AS size FROM docs),
nd AS (SELECT count(*) AS n FROM docs),
dfs AS (SELECT term, count(*) AS df FROM tc GROUP BY term)"""

_IDF = """, idf AS (
  SELECT term, df, ln(n / df) AS gweight FROM dfs, nd WHERE df >= 2 AND df <> n)"""

COUNTS, IDF = LABELLED + _COUNTS, LABELLED + _COUNTS + _IDF
TEXT_COUNTS, TEXT_IDF = TEXTS + _COUNTS, TEXTS + _COUNTS + _IDF

FOLDS = """rn AS (
  SELECT doc_id, quality AS label,
         row_number() OVER (PARTITION BY quality ORDER BY md5('0:' || doc_id), doc_id) AS r
  FROM documents JOIN labels USING (doc_id)),
folds AS (SELECT doc_id, label, CAST((r - 1) % 4 AS INTEGER) AS fold FROM rn)"""

PREDS = FOLDS + """, preds AS (
  SELECT doc_id, lang, source, fold, 'len' || lim AS classifier, label AS y_true,
         CAST(n_chars > lim AS INTEGER) AS y_pred
  FROM folds JOIN documents USING (doc_id), (VALUES (500), (1000), (1500), (2000)) t(lim))"""

MATRIX = """cells AS (
  SELECT vec_id, CAST(label >= 5 AS INTEGER) AS y,
         CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS feature,
         CAST(unnest(embedding) AS DOUBLE) AS v
  FROM embeddings)"""

CLAIMS = """claims AS (
  SELECT o_orderkey AS decision, l_linestatus AS object, o_orderpriority AS norm,
         ' ' || l_returnflag || ' ' AS outcome
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def sql_per_class(by: str) -> str:
    """Per-class counts and scores of ``preds`` grouped by the columns ``by``."""
    return f"""sides AS (
  SELECT {by}, y_true AS class, 1 AS t, 0 AS p, CAST(y_true = y_pred AS INTEGER) AS h FROM preds
  UNION ALL SELECT {by}, y_pred, 0, 1, 0 FROM preds),
pc AS (
  SELECT {by}, class, CAST(sum(t) AS BIGINT) AS n_true, CAST(sum(p) AS BIGINT) AS n_pred,
         CAST(sum(h) AS BIGINT) AS n_hit,
         CASE WHEN sum(p) > 0 THEN sum(h) / sum(p) ELSE 0.0e0 END AS prec,
         CASE WHEN sum(t) > 0 THEN sum(h) / sum(t) ELSE 0.0e0 END AS rec,
         CASE WHEN sum(t) + sum(p) > 0 THEN 2 * sum(h) / (sum(t) + sum(p)) ELSE 0.0e0 END AS f1
  FROM sides GROUP BY {by}, class)"""


def sql_metric_vector(by: str) -> str:
    """The ``mv`` fragment: all metrics per group."""
    return sql_per_class(by) + f""",
m0 AS (
  SELECT {by}, sum(n_hit) / sum(n_true) AS acc,
         avg(CASE WHEN n_true > 0 THEN rec END) AS balanced_acc,
         max(CASE WHEN class = 0 THEN 1 - rec END) AS err_0,
         max(CASE WHEN class = 1 THEN 1 - rec END) AS err_1,
         max(CASE WHEN class = 0 AND n_true > 0 THEN f1 END) AS f1_0,
         max(CASE WHEN class = 1 AND n_true > 0 THEN f1 END) AS f1_1,
         avg(CASE WHEN n_true > 0 THEN f1 END) AS f1_macro,
         CAST(coalesce(sum(CASE WHEN class = 0 THEN n_true END), 0) AS BIGINT) AS nb0,
         CAST(coalesce(sum(CASE WHEN class = 1 THEN n_true END), 0) AS BIGINT) AS nb1
  FROM pc GROUP BY {by}),
cm AS (
  SELECT {by}, sum(CAST(y_true = 1 AND y_pred = 1 AS INTEGER)) * 1.0e0 AS tp,
         sum(CAST(y_true = 0 AND y_pred = 1 AS INTEGER)) * 1.0e0 AS fp,
         sum(CAST(y_true = 1 AND y_pred = 0 AS INTEGER)) * 1.0e0 AS fn,
         sum(CAST(y_true = 0 AND y_pred = 0 AS INTEGER)) * 1.0e0 AS tn
  FROM preds GROUP BY {by}),
mv AS (
  SELECT m0.*, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0
         THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
         ELSE 0.0e0 END AS mcc
  FROM m0 JOIN cm USING ({by}))"""


def r6(*cols: str) -> str:
    """Select list that rounds columns to 6 decimals under their own names."""
    return ", ".join(f"round({c}, 6) + 0.0e0 AS {c}" for c in cols)
