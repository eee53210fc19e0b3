"""Model evaluation and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import Series, range_slices, running_sum


def class_weights(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Negatives per positive for each label; labels without positives are left out."""
    row = df.agg(*[F.count_if(F.col(c) == 1).alias(f"p_{c}") for c in labels], *[F.count_if(F.col(c) == 0).alias(f"n_{c}") for c in labels])
    structs = [F.struct(F.lit(c).alias("label"), F.col(f"n_{c}").alias("negatives"), F.col(f"p_{c}").alias("positives")) for c in labels]
    return row.select(F.inline(F.array(*structs))).filter("positives > 0").withColumn("weight", F.col("negatives") / F.col("positives"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve, ties counted half.

    Rows shrink to one per distinct score before anything is ordered; running counts are
    then taken over score ranges of equal size.
    """
    per_score = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n")
    )
    per_score, cut = range_slices(per_score, Series((), ("_s",)))
    below = running_sum(per_score, cut, {"_n_upto": "_n"})
    wins = F.col("_p") * (F.col("_n_upto") - F.col("_n") / 2)
    return below.agg(
        F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"), (F.sum(wins) / (F.sum("_p") * F.sum("_n"))).alias("auc")
    )


def classification_report(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages."""
    said = F.col(score) >= threshold
    true = F.col(label) == 1
    c = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).agg(
        F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"),
        F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"),
    )

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    def row(name, hit, wrong, missed):
        precision, recall = ratio(hit, hit + wrong), ratio(hit, hit + missed)
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
            ratio(2 * precision * recall, precision + recall).alias("f1"), (hit + missed).alias("support"),
        )

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    two = c.select("*", row("0", tn, fn, fp).alias("neg"), row("1", tp, fp, fn).alias("pos"))
    n = tp + fp + fn + tn

    def average(name, weigh):
        return F.struct(F.lit(name).alias("class"), *[weigh(m).alias(m) for m in ("precision", "recall", "f1")], n.alias("support"))

    neg, pos = F.col("neg"), F.col("pos")
    accuracy = ratio(tp + tn, n)
    macro = average("macro avg", lambda m: (neg[m] + pos[m]) / 2)
    weighted = average("weighted avg", lambda m: ratio(neg[m] * neg["support"] + pos[m] * pos["support"], n))
    total = F.struct(
        F.lit("accuracy").alias("class"), accuracy.alias("precision"), accuracy.alias("recall"), accuracy.alias("f1"), n.alias("support")
    )
    return two.select(F.inline(F.array(neg, pos, total, macro, weighted)))


def error_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean absolute, mean squared and root mean squared error."""
    diff = F.col(predicted) - F.col(actual)
    mse = F.avg(diff * diff)
    return df.agg(F.avg(F.abs(diff)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"))


def actual_vs_predicted(df: DataFrame, ts: str, actual: str, predicted: str, period: str = "month") -> DataFrame:
    """Counts of actual and predicted incidents per calendar period."""
    when = F.date_trunc(period, F.col(ts)).cast("timestamp_ntz").alias("period")
    return df.groupBy(when).agg(F.count_if(F.col(actual)).alias("actual"), F.count_if(F.col(predicted)).alias("predicted"))
