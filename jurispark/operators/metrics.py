"""Classification metrics per group of predictions.

Everything derives from one confusion aggregate, so predictions are read once and
only (group, truth, prediction) counts travel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(
    preds: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", y_pred: str = "y_pred"
) -> DataFrame:
    """(by..., y_true, y_pred, n)."""
    return preds.groupBy(
        *by, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")
    ).agg(F.count(F.lit(1)).alias("n"))


def per_class(
    preds: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", y_pred: str = "y_pred"
) -> DataFrame:
    """(by..., class, n_true, n_pred, n_hit, precision, recall, f1); 0/0 counts as 0."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("y_true").alias("class"), F.col("n").alias("_t"), zero.alias("_p"), hit.alias("_h")),
        F.struct(F.col("y_pred").alias("class"), zero.alias("_t"), F.col("n").alias("_p"), zero.alias("_h")),
    )
    counts = (
        confusion(preds, by, y_true, y_pred)
        .select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(F.sum("_t").alias("n_true"), F.sum("_p").alias("n_pred"), F.sum("_h").alias("n_hit"))
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b != 0, a / b).otherwise(F.lit(0.0))

    t, p, h = F.col("n_true"), F.col("n_pred"), F.col("n_hit")
    return counts.select(
        "*",
        ratio(h, p).alias("precision"),
        ratio(h, t).alias("recall"),
        ratio(2 * h, t + p).alias("f1"),
    )


def _grouped(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by) if by else df.groupBy()


def accuracy(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., accuracy)."""
    return _grouped(preds, by).agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy")
    )


def balanced_accuracy(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., balanced_acc): mean recall of the classes that occur in the truth."""
    return _grouped(per_class(preds, by).where("n_true > 0"), by).agg(
        F.avg("recall").alias("balanced_acc")
    )


def macro_scores(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., precision_macro, recall_macro, f1_macro) over classes seen in truth or prediction."""
    return _grouped(per_class(preds, by), by).agg(
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
    )


def _mcc() -> Column:
    """Matthews correlation from per-class counts; 0 when a side has one class only."""
    s, c = F.sum("n_true").cast("double"), F.sum("n_hit").cast("double")
    tp = F.sum(F.col("n_true").cast("double") * F.col("n_pred"))
    tt = F.sum(F.col("n_true").cast("double") * F.col("n_true"))
    pp = F.sum(F.col("n_pred").cast("double") * F.col("n_pred"))
    spread = (s * s - tt) * (s * s - pp)
    return F.when(spread > 0, (c * s - tp) / F.sqrt(spread)).otherwise(F.lit(0.0))


def matthews(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., mcc)."""
    return _grouped(per_class(preds, by), by).agg(_mcc().alias("mcc"))


def metric_vector(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All metrics of a 0/1 problem per group, with class sizes.

    Errors cover the classes in truth or prediction, F1 those in the truth; a class
    that does not occur gives NULL.
    """
    def of_class(c: int, value: Column, seen: Column) -> Column:
        return F.max(F.when((F.col("class") == c) & seen, value))

    seen_true = F.col("n_true") > 0
    anywhere = F.lit(True)
    return _grouped(per_class(preds, by), by).agg(
        (F.sum("n_hit") / F.sum("n_true")).alias("acc"),
        F.avg(F.when(seen_true, F.col("recall"))).alias("balanced_acc"),
        of_class(0, 1 - F.col("recall"), anywhere).alias("err_0"),
        of_class(1, 1 - F.col("recall"), anywhere).alias("err_1"),
        of_class(0, F.col("f1"), seen_true).alias("f1_0"),
        of_class(1, F.col("f1"), seen_true).alias("f1_1"),
        F.avg(F.when(seen_true, F.col("f1"))).alias("f1_macro"),
        _mcc().alias("mcc"),
        F.coalesce(F.sum(F.when(F.col("class") == 0, F.col("n_true"))), F.lit(0)).alias("nb0"),
        F.coalesce(F.sum(F.when(F.col("class") == 1, F.col("n_true"))), F.lit(0)).alias("nb1"),
    )


RATES = ("acc", "balanced_acc", "err_0", "err_1", "f1_0", "f1_1", "f1_macro", "mcc")


def fold_means(preds: DataFrame, by: Sequence[str], fold: str = "fold") -> DataFrame:
    """Mean over folds of each metric, with total class sizes and the number of folds."""
    return (
        metric_vector(preds, [*by, fold])
        .groupBy(*by)
        .agg(
            *[F.avg(m).alias(m) for m in RATES],
            F.sum("nb0").alias("nb0"),
            F.sum("nb1").alias("nb1"),
            F.count(F.lit(1)).alias("n_folds"),
        )
    )


def fold_errors(preds: DataFrame, by: Sequence[str], n_folds: int, fold: str = "fold") -> DataFrame:
    """Accuracy, error per class and mean class size over ``n_folds`` test folds.

    A fold without a class adds nothing to the error of that class.
    """
    def mean(c: str) -> Column:
        return F.sum(F.coalesce(F.col(c), F.lit(0.0))) / n_folds

    def size(c: str) -> Column:
        return F.bround((F.sum(c) + 1) / F.lit(float(n_folds)), 0).cast("long")

    present = metric_vector(preds, [*by, fold]).withColumns(
        {f"err_{c}": F.when(F.col(f"nb{c}") > 0, F.col(f"err_{c}")) for c in (0, 1)}
    )
    return present.groupBy(*by).agg(
        mean("acc").alias("accuracy"),
        mean("err_0").alias("err_0"),
        mean("err_1").alias("err_1"),
        size("nb0").alias("n_0"),
        size("nb1").alias("n_1"),
    )
