"""Registered queries: metrics, comparison of configurations, choice of parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ordering import rounded
from ..operators import compare, metrics
from . import inputs as I
from .registry import query

WITH_PREDS = "WITH " + I.PREDS
BY = ["classifier", "lang"]
SQL_BY = "classifier, lang"


def with_rounded(df, *cols):
    return df.withColumns({c: rounded(F.col(c)) for c in cols})


@query("src_predictions", WITH_PREDS + " SELECT doc_id, fold, classifier, y_true, y_pred FROM preds")
def src_predictions(spark, sf):
    return I.predictions(spark, sf).select("doc_id", "fold", "classifier", "y_true", "y_pred")


@query("metric_confusion", WITH_PREDS + """
SELECT classifier, lang, y_true, y_pred, count(*) AS n FROM preds GROUP BY ALL""")
def metric_confusion(spark, sf):
    return metrics.confusion(I.predictions(spark, sf), BY)


@query("metric_accuracy", WITH_PREDS + """
SELECT classifier, lang, round(avg(CAST(y_true = y_pred AS INTEGER)), 6) + 0.0e0 AS accuracy
FROM preds GROUP BY ALL""")
def metric_accuracy(spark, sf):
    return with_rounded(metrics.accuracy(I.predictions(spark, sf), BY), "accuracy")


WITH_PC = WITH_PREDS + ", " + I.sql_per_class(SQL_BY)


@query("metric_balanced", WITH_PC + """
SELECT classifier, lang, round(avg(rec), 6) + 0.0e0 AS balanced_acc FROM pc WHERE n_true > 0
GROUP BY ALL""")
def metric_balanced(spark, sf):
    return with_rounded(metrics.balanced_accuracy(I.predictions(spark, sf), BY), "balanced_acc")


@query("metric_f1", WITH_PC + """
SELECT classifier, lang, class, n_true, n_pred, n_hit, round(1 - rec, 6) + 0.0e0 AS error,
       round(f1, 6) + 0.0e0 AS f1 FROM pc""")
def metric_f1(spark, sf):
    table = metrics.per_class(I.predictions(spark, sf), BY)
    return table.select(
        *BY, "class", "n_true", "n_pred", "n_hit",
        rounded(1 - F.col("recall")).alias("error"), rounded(F.col("f1")).alias("f1"),
    )


@query("metric_macro_pr", WITH_PC + """
SELECT classifier, lang, round(avg(prec), 6) + 0.0e0 AS precision_macro,
       round(avg(rec), 6) + 0.0e0 AS recall_macro, round(avg(f1), 6) + 0.0e0 AS f1_macro
FROM pc GROUP BY ALL""")
def metric_macro_pr(spark, sf):
    table = metrics.macro_scores(I.predictions(spark, sf), BY)
    return with_rounded(table, "precision_macro", "recall_macro", "f1_macro")


WITH_MV = WITH_PREDS + ", " + I.sql_metric_vector(SQL_BY)
SQL_RATES = I.r6(*metrics.RATES)


@query("metric_mcc", WITH_MV + " SELECT classifier, lang, round(mcc, 6) + 0.0e0 AS mcc FROM mv")
def metric_mcc(spark, sf):
    return with_rounded(metrics.matthews(I.predictions(spark, sf), BY), "mcc")


@query("metric_vector", WITH_MV + f" SELECT classifier, lang, {SQL_RATES}, nb0, nb1 FROM mv")
def metric_vector(spark, sf):
    return with_rounded(metrics.metric_vector(I.predictions(spark, sf), BY), *metrics.RATES)


# Folds: means of fold metrics, metrics of pooled folds, errors per fold set.

WITH_FOLD_MV = WITH_PREDS + ", " + I.sql_metric_vector("classifier, fold")
SQL_MEANS = ", ".join(f"avg({m}) AS {m}" for m in metrics.RATES)


@query("cv_metrics_mean", WITH_FOLD_MV + f""", means AS (
  SELECT classifier, {SQL_MEANS}, CAST(sum(nb0) AS BIGINT) AS nb0, CAST(sum(nb1) AS BIGINT) AS nb1,
         count(*) AS n_folds FROM mv GROUP BY classifier)
SELECT classifier, {SQL_RATES}, nb0, nb1, n_folds FROM means""")
def cv_metrics_mean(spark, sf):
    return with_rounded(metrics.fold_means(I.predictions(spark, sf), ["classifier"]), *metrics.RATES)


@query("cv_metrics_pooled", WITH_PREDS + ", " + I.sql_metric_vector("classifier") + f"""
SELECT classifier, {SQL_RATES}, nb0, nb1 FROM mv""")
def cv_metrics_pooled(spark, sf):
    return with_rounded(
        metrics.metric_vector(I.predictions(spark, sf), ["classifier"]), *metrics.RATES
    )


@query("crossval_errors", WITH_PREDS + ", " + I.sql_metric_vector("classifier, source, fold") + """
SELECT classifier, source, round(sum(acc) / 4, 6) + 0.0e0 AS accuracy,
       round(sum(CASE WHEN nb0 > 0 THEN err_0 ELSE 0 END) / 4, 6) + 0.0e0 AS err_0,
       round(sum(CASE WHEN nb1 > 0 THEN err_1 ELSE 0 END) / 4, 6) + 0.0e0 AS err_1,
       CAST(round_even((sum(nb0) + 1) / 4.0e0, 0) AS BIGINT) AS n_0,
       CAST(round_even((sum(nb1) + 1) / 4.0e0, 0) AS BIGINT) AS n_1
FROM mv GROUP BY classifier, source""")
def crossval_errors(spark, sf):
    table = metrics.fold_errors(I.predictions(spark, sf), ["classifier", "source"], 4)
    return with_rounded(table, "accuracy", "err_0", "err_1")


@query("sota_compare", WITH_PREDS + ", " + I.sql_metric_vector("source, lang, classifier, fold") + f"""
, means AS (SELECT source, lang, classifier, {SQL_MEANS}, count(*) AS n_folds
            FROM mv GROUP BY source, lang, classifier)
SELECT source, lang, classifier, {I.r6(*[m for m in metrics.RATES if m != 'mcc'])}, n_folds
FROM means""")
def sota_compare(spark, sf):
    table = compare.state_of_the_art(I.predictions(spark, sf), ["source", "lang", "classifier"])
    return with_rounded(table, *[m for m in metrics.RATES if m != "mcc"])


@query("ext_predictions", f"""
WITH truth AS (
  SELECT doc_id, '__label__' || quality || ' ' || text AS line FROM documents JOIN labels USING (doc_id)),
out AS (
  SELECT doc_id, '__label__' || CAST(n_chars > 1000 AS INTEGER) || ' ' || n_chars AS line
  FROM documents JOIN labels USING (doc_id))
SELECT truth.doc_id, string_split(truth.line, ' ')[1] AS y_true, string_split(out.line, ' ')[1] AS y_pred
FROM truth JOIN out ON truth.doc_id = out.doc_id""")
def ext_predictions(spark, sf):
    """Truth and output lines of an outside classifier, aligned by document."""
    from ..sources.readers import first_token

    rows = I.table(spark, sf, "documents").join(I.table(spark, sf, "labels"), "doc_id")
    truth = rows.select("doc_id", T.supervised_line(F.col("quality"), F.col("text")).alias("line"))
    out = rows.select(
        "doc_id",
        F.concat_ws(
            " ",
            F.concat(F.lit("__label__"), (F.col("n_chars") > 1000).cast("int").cast("string")),
            F.col("n_chars").cast("string"),
        ).alias("line"),
    )
    return truth.select("doc_id", first_token("line").alias("y_true")).join(
        out.select("doc_id", first_token("line").alias("y_pred")), "doc_id"
    )


# Comparison of configurations: zone = language, category = source.

COMPARED = ("acc", "f1_macro", "balanced_acc")
SQL_SCORES = WITH_PREDS + ", " + I.sql_metric_vector("classifier, lang, source") + """,
scores AS (
  SELECT lang AS zone, source AS category, classifier, 'acc' AS metric, round(acc, 9) AS score FROM mv
  UNION ALL SELECT lang, source, classifier, 'f1_macro', round(f1_macro, 9) FROM mv
  UNION ALL SELECT lang, source, classifier, 'balanced_acc', round(balanced_acc, 9) FROM mv)"""


def scores(spark, sf):
    table = metrics.metric_vector(I.predictions(spark, sf), ["classifier", "lang", "source"])
    named = table.select(
        F.col("lang").alias("zone"),
        F.col("source").alias("category"),
        "classifier",
        *[F.round(F.col(m), 9).alias(m) for m in COMPARED],
    )
    return compare.unpivot_metrics(named, COMPARED)


@query("best_config", SQL_SCORES + """,
summary AS (
  SELECT metric, zone, classifier, CASE WHEN grouping(category) = 1 THEN 'Average' ELSE category END AS scope,
         round(avg(score), 9) AS mean_score, min(score) AS worst_score, max(score) AS best_score,
         list_sort(list({'s': score, 'c': category}))[1]['c'] AS worst_category,
         list_sort(list({'s': -score, 'c': category}))[1]['c'] AS best_category
  FROM scores GROUP BY GROUPING SETS ((metric, zone, classifier), (metric, zone, classifier, category))),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY metric, scope ORDER BY mean_score DESC, zone, classifier) AS rank,
         max(mean_score) OVER (PARTITION BY metric, scope) - mean_score AS gap_to_best,
         row_number() OVER (PARTITION BY metric, scope, classifier
                            ORDER BY mean_score DESC, zone, classifier) AS first
  FROM summary)
SELECT metric, scope, zone, classifier, CAST(rank AS INTEGER) AS rank, worst_category, best_category,
       round(mean_score, 3) + 0.0e0 AS mean_score, round(worst_score, 3) + 0.0e0 AS worst_score,
       round(best_score, 3) + 0.0e0 AS best_score, round(gap_to_best, 3) + 0.0e0 AS gap_to_best,
       round(best_score - worst_score, 3) + 0.0e0 AS stability
FROM ranked WHERE rank = 1 OR (classifier IN ('len500', 'len1000') AND first = 1)""")
def best_config(spark, sf):
    config = ["zone", "classifier"]
    summary = compare.config_summary(scores(spark, sf), config).withColumn(
        "mean_score", F.round("mean_score", 9)
    )
    table = compare.rank_configs(summary, config, "classifier", ["len500", "len1000"])
    rates = ["mean_score", "worst_score", "best_score", "gap_to_best", "stability"]
    return table.withColumns({c: rounded(F.col(c), 3) for c in rates})


@query("config_grid", """
SELECT source AS category, g AS global_weight, l AS local_weight, l || g AS vectorization
FROM (SELECT DISTINCT source FROM documents),
 (VALUES ('TP'), ('TF'), ('LOGTF'), ('ATF'), ('LOGAVE'), ('AVERAGELocals')) a(l),
 (VALUES ('CHI2'), ('DBIDF'), ('DELTADF'), ('DSIDF'), ('GSS'), ('IDF'), ('IG'), ('KLD'),
         ('MARASCUILO'), ('NGL'), ('RF'), ('AVERAGEGlobals')) b(g)""")
def config_grid(spark, sf):
    categories = I.table(spark, sf, "documents").select(F.col("source").alias("category")).distinct()
    return compare.vectorization_grid(categories)


@query("config_split", """
SELECT DISTINCT source || '_' || lang || '_None_len1000' AS config, source AS category,
       lang AS vectorization, 'None' AS transformation, 'len1000' AS classifier FROM documents""")
def config_split(spark, sf):
    packed = F.concat_ws("_", "source", "lang", F.lit("None"), F.lit("len1000"))
    names = I.table(spark, sf, "documents").select(packed.alias("config")).distinct()
    return names.select("config", T.split_config(F.col("config")).alias("c")).select("config", "c.*")


# Parameter choice: length rules n_chars > 1000 * nu * n_comp, macro F1 per fold.

SQL_PARAM_SCORES = "WITH " + I.FOLDS + """, preds AS (
  SELECT nu, n_comp, fold, label AS y_true, CAST(n_chars > 1000 * nu * n_comp AS INTEGER) AS y_pred
  FROM folds JOIN documents USING (doc_id), (VALUES (0.5e0), (1.0e0), (1.5e0), (2.0e0)) a(nu),
       (VALUES (1), (2)) b(n_comp)), """ + I.sql_per_class("nu, n_comp, fold") + """,
scores AS (SELECT nu, n_comp, fold, avg(f1) AS score FROM pc GROUP BY nu, n_comp, fold),
means AS (SELECT nu, n_comp, avg(coalesce(score, 0)) AS mean_score, stddev_pop(score) AS std_score
          FROM scores GROUP BY nu, n_comp)"""


def param_scores(spark, sf):
    rows = I.predictions(spark, sf).where("classifier = 'len500'").select("doc_id", "fold", "y_true")
    docs = I.table(spark, sf, "documents").select("doc_id", "n_chars")
    grid = rows.join(docs, "doc_id").withColumn(
        "nu", F.explode(F.array(*[F.lit(x) for x in (0.5, 1.0, 1.5, 2.0)]))
    ).withColumn("n_comp", F.explode(F.array(F.lit(1), F.lit(2))))
    preds = grid.withColumn(
        "y_pred", (F.col("n_chars") > 1000 * F.col("nu") * F.col("n_comp")).cast("int")
    )
    return metrics.macro_scores(preds, ["nu", "n_comp", "fold"]).withColumnRenamed("f1_macro", "score")


PARAMS = ["nu", "n_comp"]


@query("best_params", SQL_PARAM_SCORES + """
SELECT nu, n_comp, round(mean_score, 6) + 0.0e0 AS mean_score FROM means WHERE mean_score > 0
ORDER BY round(mean_score, 12) DESC, nu, n_comp LIMIT 1""")
def best_params(spark, sf):
    return with_rounded(compare.best_params(param_scores(spark, sf), PARAMS), "mean_score")


@query("top_params", SQL_PARAM_SCORES + """, r AS (
  SELECT *, rank() OVER (ORDER BY round(mean_score, 12) DESC) AS rank FROM means)
SELECT nu, n_comp, CAST(rank AS INTEGER) AS rank, round(mean_score, 6) + 0.0e0 AS mean_score,
       round(std_score, 6) + 0.0e0 AS std_score FROM r WHERE rank <= 3""")
def top_params(spark, sf):
    table = compare.top_params(param_scores(spark, sf), PARAMS, 3)
    return with_rounded(table, "mean_score", "std_score")


@query("best_params_min", SQL_PARAM_SCORES + """, r AS (
  SELECT *, rank() OVER (ORDER BY round(mean_score, 12) DESC) AS rank FROM means)
SELECT nu, n_comp, CAST(rank AS INTEGER) AS rank, round(mean_score, 6) + 0.0e0 AS mean_score,
       round(std_score, 6) + 0.0e0 AS std_score FROM r WHERE rank = 1 ORDER BY n_comp, nu LIMIT 1""")
def best_params_min(spark, sf):
    table = compare.best_params_min(param_scores(spark, sf), PARAMS, "n_comp")
    return with_rounded(table, "mean_score", "std_score")
