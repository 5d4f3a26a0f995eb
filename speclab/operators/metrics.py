"""Classification metrics on a scored frame.

Every metric is a DataFrame aggregate over (label, prediction[, score]); the
scored rows never leave the executors. ROC running counts use pre-aggregation
per distinct score and bucketed running sums, so even a frame with many
distinct scores is not ranked inside one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from speclab.operators.quantiles import ranged
from speclab.session import cut_lineage

CLASSES = (0, 1)


def _grouped(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by) if by else df.groupBy()


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction",
             by: Sequence[str] = ()) -> DataFrame:
    """H6: share of rows with prediction == label."""
    return _grouped(df, by).agg(
        F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     classes: Sequence[int] = CLASSES, by: Sequence[str] = ()) -> DataFrame:
    """H7: long (actual, predicted, n), zero-filled over the class grid."""
    aggs = [F.count_if((F.col(label) == a) & (F.col(prediction) == p)).alias(f"c_{a}_{p}")
            for a in classes for p in classes]
    wide = _grouped(df, by).agg(*aggs)
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"),
                                         F.col(f"c_{a}_{p}").alias("n"))
                                for a in classes for p in classes]))
    return wide.select(*by, cells.alias("c")).select(*by, "c.*")


def _per_class(df: DataFrame, label: str, prediction: str, classes, by) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("_n"),
            F.count_if(F.col(label) == F.col(prediction)).alias("_correct")]
    for c in classes:
        aggs += [F.count_if((F.col(label) == c) & (F.col(prediction) == c)).alias(f"tp_{c}"),
                 F.count_if(F.col(prediction) == c).alias(f"pp_{c}"),
                 F.count_if(F.col(label) == c).alias(f"sup_{c}")]
    return _grouped(df, by).agg(*aggs)


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          classes: Sequence[int] = CLASSES, by: Sequence[str] = ()) -> DataFrame:
    """H8: precision / recall / f1 / support per class, accuracy, macro and
    weighted averages; a zero division gives 0 (sklearn's default warning value)."""
    base = _per_class(df, label, prediction, classes, by)

    def z(x):
        return F.coalesce(x, F.lit(0.0))

    rows = []
    for c in classes:
        prec = z(F.try_divide(F.col(f"tp_{c}").cast("double"), F.col(f"pp_{c}")))
        rec = z(F.try_divide(F.col(f"tp_{c}").cast("double"), F.col(f"sup_{c}")))
        f1 = z(F.try_divide(2 * prec * rec, prec + rec))
        rows.append(F.struct(F.lit(str(c)).alias("row_label"), prec.alias("precision"),
                             rec.alias("recall"), f1.alias("f1"),
                             F.col(f"sup_{c}").cast("long").alias("support")))
    per = base.select(*by, "_n", "_correct", F.array(*rows).alias("rows"))
    cls = per.select(*by, "_n", "_correct", F.explode("rows").alias("r")).select(*by, "_n", "_correct", "r.*")
    acc = per.select(*by, F.lit("accuracy").alias("row_label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"),
                     z(F.try_divide(F.col("_correct").cast("double"), F.col("_n"))).alias("f1"),
                     F.col("_n").cast("long").alias("support"))
    g = _grouped(cls, by)
    macro = g.agg(F.lit("macro avg").alias("row_label"), F.avg("precision").alias("precision"),
                  F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                  F.sum("support").cast("long").alias("support"))
    wsum = F.sum("support")
    weighted = g.agg(F.lit("weighted avg").alias("row_label"),
                     z(F.try_divide(F.sum(F.col("precision") * F.col("support")), wsum)).alias("precision"),
                     z(F.try_divide(F.sum(F.col("recall") * F.col("support")), wsum)).alias("recall"),
                     z(F.try_divide(F.sum(F.col("f1") * F.col("support")), wsum)).alias("f1"),
                     wsum.cast("long").alias("support"))
    return (cls.drop("_n", "_correct").unionByName(acc).unionByName(macro).unionByName(weighted))


def _win(by: list[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy()


def roc_running_counts(df: DataFrame, label: str = "label", score: str = "score",
                       by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, positives / negatives at or above it (descending order).

    Pre-aggregate per score (partial aggregation), then running sums: range
    totals give each range's start, and a window partitioned by (by, range)
    finishes inside the range.
    """
    by = list(by)
    per = df.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("pos"),
                                     F.count_if(F.col(label) != 1).alias("neg"))
    # descending score order = ascending order of the negated score; ranges follow the scores
    per = ranged(per.withColumn("_neg", -F.col(score).cast("double")), by, ["_neg"])
    bt = per.groupBy(*by, "_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    wb = _win(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select(*by, "_b", F.coalesce(F.sum("_bp").over(wb), F.lit(0)).alias("_op"),
                   F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_on"))
    wi = Window.partitionBy(*by, "_b").orderBy("_neg").rowsBetween(Window.unboundedPreceding, 0)
    return (per.join(bt, by + ["_b"])
               .select(*by, score, "pos", "neg",
                       (F.col("_op") + F.sum("pos").over(wi)).alias("tp"),
                       (F.col("_on") + F.sum("neg").over(wi)).alias("fp")))


def roc_curve_from_scores(df: DataFrame, label: str = "label", score: str = "score",
                          by: Sequence[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr) from the origin (threshold infinity) over every distinct score, plus roc_auc.

    Trapezoid AUC without a lag: each threshold adds neg_i * (TP_i - pos_i / 2) / (P * N).
    The per-score running counts are written once; the totals and the curve read that
    table, so the scored rows are read once.
    """
    by = list(by)
    rc = cut_lineage(roc_running_counts(df, label, score, by))
    area_term = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    tot = cut_lineage(_grouped(rc, by).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"), F.sum(area_term).alias("_area")))
    points = rc.select(*by, F.col(score).cast("double").alias("threshold"), "tp", "fp")
    if by:
        origin = tot.select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
        j = points.unionByName(origin).join(tot, by)
        P, N, area = F.col("_P"), F.col("_N"), F.col("_area")
    else:
        origin = tot.where(F.col("_P").isNotNull()).select(F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tp"),
                                                         F.lit(0).cast("long").alias("fp"))
        j = points.unionByName(origin)
        P, N, area = (tot.select(c).scalar() for c in ("_P", "_N", "_area"))
    return j.select(
        *by, "threshold",
        F.try_divide(F.col("fp").cast("double"), N.cast("double")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), P.cast("double")).alias("tpr"),
        F.try_divide(area, (P * N).cast("double")).alias("roc_auc"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    rc = roc_running_counts(df, label, score, by)
    return _grouped(rc, list(by)).agg(
        F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)),
                     F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def roc_auc_from_labels(df: DataFrame, label: str = "label", prediction: str = "prediction",
                        by: Sequence[str] = ()) -> DataFrame:
    """H9: the ROC the reference draws from hard 0/1 predictions."""
    return roc_curve_from_scores(df.withColumn("_s", F.col(prediction).cast("double")), label, "_s", by) \
        .withColumnRenamed("_s", "threshold")


def evaluate_model(scored: DataFrame, label: str = "label", prediction: str = "prediction",
                   split: str = "split") -> DataFrame:
    """H6-H9 for every split in one grouped pass: accuracy, confusion cells,
    class-1 precision / recall / f1, macro f1 and the hard-label AUC."""
    c = scored.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col(label) == 1) & (F.col(prediction) == 1)).alias("tp"),
        F.count_if((F.col(label) == 0) & (F.col(prediction) == 1)).alias("fp"),
        F.count_if((F.col(label) == 0) & (F.col(prediction) == 0)).alias("tn"),
        F.count_if((F.col(label) == 1) & (F.col(prediction) == 0)).alias("fn"))

    def z(x):
        return F.coalesce(x, F.lit(0.0))
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    p1, r1 = z(F.try_divide(tp, tp + fp)), z(F.try_divide(tp, tp + fn))
    p0, r0 = z(F.try_divide(tn, tn + fn)), z(F.try_divide(tn, tn + fp))
    f1_1 = z(F.try_divide(2 * p1 * r1, p1 + r1))
    f1_0 = z(F.try_divide(2 * p0 * r0, p0 + r0))
    return c.select(split, "n", "tp", "fp", "tn", "fn",
                    F.try_divide(tp + tn, F.col("n").cast("double")).alias("accuracy"),
                    p1.alias("precision"), r1.alias("recall"), f1_1.alias("f1"),
                    ((f1_1 + f1_0) / 2).alias("macro_f1"),
                    # AUC of a 3-point ROC from hard labels = (TPR + TNR) / 2
                    ((r1 + r0) / 2).alias("auc_hard"))
