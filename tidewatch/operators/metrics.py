"""Evaluation of predictions against labels (1 = attack)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _hits(truth: Column, guess: Column) -> Column:
    return F.coalesce(F.count_if(truth & guess), F.lit(0))


def confusion_matrix(df: DataFrame, actual: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    attack, flagged = F.col(actual) == 1, F.col(predicted) == 1
    return df.agg(_hits(~attack, ~flagged).alias("tn"), _hits(~attack, flagged).alias("fp"),
                  _hits(attack, ~flagged).alias("fn"), _hits(attack, flagged).alias("tp"))


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient with 0 for an empty denominator."""
    return F.when(bottom == 0, 0.0).otherwise(top.cast("double") / F.nullif(bottom, F.lit(0)))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def binary_metrics(matrix: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and false-positive rate to four decimals."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    out = matrix.withColumns({
        "_p": ratio(tp, tp + fp), "_r": ratio(tp, tp + fn)})
    return out.select(
        F.round(ratio(tp + tn, tn + fp + fn + tp), 4).alias("accuracy"),
        F.round("_p", 4).alias("precision"), F.round("_r", 4).alias("recall"),
        F.round(f1(F.col("_p"), F.col("_r")), 4).alias("f1_score"),
        "tp", "fp", "tn", "fn",
        F.round(fp / F.greatest(fp + tn, F.lit(1)), 4).alias("false_positive_rate"))


def report_metrics(matrix: DataFrame) -> DataFrame:
    """Variant used by the figure tables: bounded denominators instead of zero rules."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    p, r = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    return matrix.select(
        "tn", "fp", "fn", "tp",
        F.round((tp + tn) / F.greatest(tn + fp + fn + tp, F.lit(1)), 4).alias("accuracy"),
        F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"),
        F.round(2 * p * r / F.greatest(p + r, F.lit(0.001)), 4).alias("f1_score"))


def classification_report(matrix: DataFrame) -> DataFrame:
    """Rows Normal, Attack, accuracy, macro avg, weighted avg; from the confusion matrix."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    m = matrix.withColumns({
        "pn": ratio(tn, tn + fn), "rn": ratio(tn, tn + fp), "sn": tn + fp,
        "pa": ratio(tp, tp + fp), "ra": ratio(tp, tp + fn), "sa": tp + fn})
    m = m.withColumns({"f1n": f1(F.col("pn"), F.col("rn")), "f1a": f1(F.col("pa"), F.col("ra")),
                       "all": F.col("sn") + F.col("sa")})

    def weighted(n: str, a: str) -> Column:
        return ratio(F.col(n) * F.col("sn") + F.col(a) * F.col("sa"), F.col("all"))

    def macro(n: str, a: str) -> Column:
        return (F.col(n) + F.col(a)) / 2

    accuracy = ratio(tn + tp, F.col("all"))
    lines = [
        ("Normal", F.col("pn"), F.col("rn"), F.col("f1n"), F.col("sn")),
        ("Attack", F.col("pa"), F.col("ra"), F.col("f1a"), F.col("sa")),
        ("accuracy", accuracy, accuracy, accuracy, F.col("all")),
        ("macro avg", macro("pn", "pa"), macro("rn", "ra"), macro("f1n", "f1a"), F.col("all")),
        ("weighted avg", weighted("pn", "pa"), weighted("rn", "ra"), weighted("f1n", "f1a"), F.col("all")),
    ]
    return m.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("class"), F.round(p, 4).alias("precision"),
                 F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1_score"),
                 s.alias("support")) for name, p, r, f, s in lines])))


def score_distribution(df: DataFrame, actual: str = "y_true", score: str = "score") -> DataFrame:
    """Mean and population deviation per true class, and their separation."""
    s, attack = F.col(score), F.col(actual) == 1
    normal, hit = F.when(~attack, s), F.when(attack, s)
    return df.agg(
        F.round(F.avg(normal), 4).alias("normal_mean"), F.round(F.stddev_pop(normal), 4).alias("normal_std"),
        F.round(F.avg(hit), 4).alias("attack_mean"), F.round(F.stddev_pop(hit), 4).alias("attack_std"),
        F.round(F.avg(normal) - F.avg(hit), 4).alias("separation"))


def training_summary(df: DataFrame, score: str = "score") -> DataFrame:
    s = F.col(score)
    flagged = F.count_if(s < 0)
    return df.agg(
        F.count("*").alias("n_samples"), flagged.alias("n_anomalies"),
        F.round(flagged / F.count("*") * 100, 2).alias("anomaly_percentage"),
        F.round(F.avg(s), 4).alias("mean_score"), F.round(F.stddev_pop(s), 4).alias("std_score"),
        F.round(F.min(s), 4).alias("min_score"), F.round(F.max(s), 4).alias("max_score"))
