"""Classification, regression, multi-label and calibration metrics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerloom.schemas import CALIBRATION_BINS


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def per_class(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support of each class; an empty denominator counts as 0."""
    cells = confusion(df, truth, pred)
    hit = F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)
    by_truth = cells.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    by_pred = cells.groupBy(F.col(pred).alias("label")).agg(F.sum("n").alias("predicted"))
    both = by_truth.join(by_pred, "label", "full").na.fill(0, ["support", "tp", "predicted"])
    share = lambda d: F.when(F.col(d) > 0, F.col("tp") / F.col(d)).otherwise(0.0)
    return both.select("label", share("predicted").alias("precision"), share("support").alias("recall"), _f1(share("predicted"), share("support")).alias("f1"), "support", "tp")


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Accuracy, macro and weighted F1."""
    total = F.sum("support")
    return per_class(df, truth, pred).agg(
        F.try_divide(F.sum("tp"), total).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.try_divide(F.sum(F.col("f1") * F.col("support")), total).alias("weighted_f1"), total.alias("n")
    )


def majority_floor(df: DataFrame, truth: str) -> DataFrame:
    """Accuracy of always naming the most frequent class."""
    return df.groupBy(truth).count().agg((F.max("count") / F.sum("count")).alias("majority_accuracy"))


def regression_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """MAE, RMSE, R2 = 1 - SSE / SST and MAPE without zero truths."""
    y, e = F.col(truth).cast("double"), F.col(truth).cast("double") - F.col(pred)
    n = F.count(F.lit(1))
    sst = F.sum(y * y) - F.sum(y) * F.sum(y) / n
    return df.agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when((n > 1) & (sst > 0), 1 - F.sum(e * e) / sst).alias("r2"),
        F.avg(F.when(y != 0, F.abs(e / y))).alias("mape"), n.alias("n"),
    )


def calibration_bin(confidence: Column, bins: int = CALIBRATION_BINS) -> Column:
    """Bins (lo, hi], numbered 1..bins; a confidence of 0 falls in none."""
    return F.when((confidence > 0) & (confidence <= 1), F.ceil(confidence * bins).cast("int"))


def reliability(df: DataFrame, confidence: str, correct: str, bins: int = CALIBRATION_BINS) -> DataFrame:
    """Mean confidence and accuracy of every bin; empty bins stay with count 0."""
    got = df.withColumn("bin", calibration_bin(F.col(confidence), bins)).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(got), "bin", "left").na.fill(0, ["n"])


def ece(df: DataFrame, confidence: str, correct: str, bins: int = CALIBRATION_BINS) -> DataFrame:
    """Expected calibration error, bins weighted by their share of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    parts = reliability(df, confidence, correct, bins).crossJoin(F.broadcast(total))
    return parts.agg(F.coalesce(F.sum(F.col("n") / F.col("_total") * F.abs(F.col("accuracy") - F.col("confidence"))), F.lit(0.0)).alias("ece"))


def brier(df: DataFrame, probabilities: str, index: str) -> DataFrame:
    """Mean squared distance of probability vectors from the one-hot truth."""
    cell = F.aggregate(F.transform(F.col(probabilities), lambda p, i: (p - (i == F.col(index)).cast("double")) * (p - (i == F.col(index)).cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return df.agg(F.avg(cell).alias("brier"))


def multilabel_cells(truth: DataFrame, pred: DataFrame, doc: str, label: str) -> DataFrame:
    """(doc, label) pairs with tp, fp, fn flags."""
    t, p = truth.select(doc, label).distinct().withColumn("_t", F.lit(1)), pred.select(doc, label).distinct().withColumn("_p", F.lit(1))
    both = t.join(p, [doc, label], "full").na.fill(0, ["_t", "_p"])
    return both.select(doc, label, (F.col("_t") * F.col("_p")).alias("tp"), ((1 - F.col("_t")) * F.col("_p")).alias("fp"), (F.col("_t") * (1 - F.col("_p"))).alias("fn"))


def _prf(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def multilabel_report(truth: DataFrame, pred: DataFrame, labels: DataFrame, docs: DataFrame, doc: str, label: str) -> DataFrame:
    """Micro precision, recall and F1, macro F1 over all labels, mean F1 over all documents."""
    cells = multilabel_cells(truth, pred, doc, label)
    s = F.sum
    micro = cells.agg(
        F.coalesce(F.try_divide(s("tp"), s("tp") + s("fp")), F.lit(0.0)).alias("micro_p"), F.coalesce(F.try_divide(s("tp"), s("tp") + s("fn")), F.lit(0.0)).alias("micro_r"), F.coalesce(_prf(s("tp"), s("fp"), s("fn")), F.lit(0.0)).alias("micro_f1")
    )
    mean = lambda dim, key, out: dim.select(key).distinct().join(cells.groupBy(key).agg(_prf(s("tp"), s("fp"), s("fn")).alias("_f")), key, "left").agg(F.avg(F.coalesce("_f", F.lit(0.0))).alias(out))
    return micro.crossJoin(mean(labels, label, "macro_f1")).crossJoin(mean(docs, doc, "samples_f1"))


def band_f1(cells: DataFrame, frequency: DataFrame, label: str, edges: Sequence[int] = (500, 100)) -> DataFrame:
    """Micro F1 by label frequency band."""
    n = F.col("doc_freq")
    name = F.when(n >= edges[0], "head").when(n >= edges[1], "middle").otherwise("tail")
    s = F.sum
    return cells.join(frequency, label).groupBy(name.alias("band")).agg(_prf(s("tp"), s("fp"), s("fn")).alias("f1"), F.count_distinct(label).alias("n_labels"))


def learn_thresholds(df: DataFrame, pred: str, confidence: str, correct: str, *, least_n: int = 15, least_precision: float = 0.5) -> DataFrame:
    """For each class the smallest threshold of 0.30..0.95 with support and precision; null if none.

    A confidence counts for every grid step at or below it, so rows are first counted
    by their highest step (66 a class at most) and summed over the steps after that.
    """
    step = F.least(F.floor(F.col(confidence) * 100 + 1e-9), F.lit(95)).cast("int")
    by = df.groupBy(F.col(pred).alias("label"), step.alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(correct).cast("int")).alias("_k"))
    steps = df.sparkSession.range(30, 96).select(F.col("id").cast("int").alias("_t"))
    sums = by.join(F.broadcast(steps), F.col("_s") >= F.col("_t")).groupBy("label", "_t").agg(F.sum("_n").alias("n"), F.sum("_k").alias("k"))
    good = sums.where((F.col("n") >= least_n) & (F.col("k") >= least_precision * F.col("n")))
    first = good.groupBy("label").agg(F.min("_t").alias("_t")).join(good, ["label", "_t"]).select("label", (F.col("_t") / 100.0).alias("threshold"), (F.col("k") / F.col("n")).alias("precision"), F.col("n").alias("support"))
    return by.select("label").distinct().join(first, "label", "left")


def tune_thresholds(df: DataFrame, label: str, score: str, truth: str, grid: Sequence[float]) -> DataFrame:
    """For each label the threshold of best F1 (score > t); ties to the smaller, f1 = 0 to the middle of the grid."""
    exploded = df.withColumn("t", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    hit = (F.col(score) > F.col("t")).cast("int")
    y = F.col(truth).cast("int")
    f1 = _prf(F.sum(hit * y), F.sum(hit * (1 - y)), F.sum((1 - hit) * y))
    best = exploded.groupBy(label, "t").agg(f1.alias("f1")).groupBy(label).agg(F.min(F.struct((-F.col("f1")).alias("a"), F.col("t").alias("t"))).alias("m"))
    middle = float(grid[len(grid) // 2])
    return best.select(label, F.when(F.col("m.a") == 0, F.lit(middle)).otherwise(F.col("m.t")).alias("threshold"), (-F.col("m.a") + 0.0).alias("f1"))


def binned_mutual_information(df: DataFrame, feature: str, label: str, bins: int = 10) -> DataFrame:
    """Mutual information of a feature's equal-width bins and a class (a binned estimate, not nearest neighbours)."""
    span = df.agg(F.min(feature).alias("_lo"), F.max(feature).alias("_hi"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col(feature) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    cell = df.where(F.col(feature).isNotNull() & F.col(label).isNotNull()).crossJoin(F.broadcast(span)).withColumn("_b", F.least(F.floor(width * bins), F.lit(bins - 1)))
    joint = cell.groupBy("_b", label).agg(F.count(F.lit(1)).alias("n"))  # bins x classes rows
    nb, nl = joint.groupBy("_b").agg(F.sum("n").alias("nb")), joint.groupBy(label).agg(F.sum("n").alias("nl"))
    total = joint.agg(F.sum("n").alias("t"))
    return joint.join(nb, "_b").join(nl, label).crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nb") * F.col("nl")))).alias("mutual_information"))


def nearest_mutual_information(df: DataFrame, features: Sequence[str], label: str, *, k: int = 3) -> DataFrame:
    """Mutual information of each feature and a class by nearest neighbours (Ross' estimator).

    For a row with k neighbours of its class within distance d, and m rows of any class
    closer than d, the estimate is psi(n) + psi(k) - mean psi(class size) - mean psi(m).
    Equal rows are counted first; a feature's distinct values and classes are one group, sorted once.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("c"), F.col(label).cast("string").alias("y")).select("c.feature", "c.x", "y").where("x IS NOT NULL AND y IS NOT NULL")
    counted = long.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n"))

    def estimate(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, n = pdf["x"].to_numpy(float), pd.factorize(pdf["y"])[0], pdf["n"].to_numpy(np.int64)
        radius, near, size = np.zeros(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for c in np.unique(y):
            mine = np.flatnonzero(y == c)
            rows = int(n[mine].sum())
            if rows < 2:
                continue
            take = min(k, rows - 1)
            order = mine[np.argsort(x[mine], kind="stable")]
            v, w = x[order], n[order]
            # a row's nearest of its class are its equals and values within k places of it in sorted order
            gaps, weight = np.full((len(v), 2 * take + 1), np.inf), np.zeros((len(v), 2 * take + 1), np.int64)
            gaps[:, 0], weight[:, 0] = 0.0, w - 1
            for j in range(1, take + 1):
                gaps[j:, 2 * j - 1], weight[j:, 2 * j - 1] = v[j:] - v[:-j], w[:-j]
                gaps[:-j, 2 * j], weight[:-j, 2 * j] = v[j:] - v[:-j], w[j:]
            by = np.argsort(gaps, axis=1, kind="stable")
            reached = np.cumsum(np.take_along_axis(weight, by, 1), axis=1) >= take
            radius[order] = np.take_along_axis(np.take_along_axis(gaps, by, 1), reached.argmax(1)[:, None], 1)[:, 0]
            near[order], size[order] = take, rows
        used = size > 0
        if not used.any():
            return pd.DataFrame({"feature": [key[0]], "mutual_information": [0.0]})
        every, at = np.unique(x[used], return_inverse=True)
        before = np.append(0, np.cumsum(np.bincount(at, weights=n[used]).astype(np.int64)))
        low, high = _closer(every, x[used], radius[used])
        mean = lambda values: float((_psi(values) * n[used]).sum() / n[used].sum())
        value = _psi(np.array([n[used].sum()]))[0] + mean(near[used]) - mean(size[used]) - mean(before[high] - before[low])
        return pd.DataFrame({"feature": [key[0]], "mutual_information": [max(0.0, float(value))]})

    return counted.groupBy("feature").applyInPandas(estimate, "feature string, mutual_information double")


def _closer(every: np.ndarray, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end position of the sorted values that lie within less than its radius of each x, itself included (radius 0: its equals)."""
    inside = lambda at: (np.abs(every[np.clip(at, 0, len(every) - 1)] - x) < radius) | (every[np.clip(at, 0, len(every) - 1)] == x)
    low, high = np.searchsorted(every, x - radius, "left"), np.searchsorted(every, x + radius, "right")
    while True:  # sums round, differences decide
        step = (low < high) & ~inside(low)
        back = (low > 0) & inside(low - 1)
        cut = (high > low) & ~inside(high - 1)
        grow = (high < len(every)) & inside(high)
        if not (step | back | cut | grow).any():
            return low, high
        low, high = low + step - (back & ~step), high - cut + (grow & ~cut)


def _psi(n: np.ndarray) -> np.ndarray:
    """Digamma of whole numbers: the harmonic sum below n, less Euler's constant."""
    n = np.asarray(n, np.int64)
    return np.append(0.0, np.cumsum(1.0 / np.arange(1, max(2, n.max()))))[n - 1] - np.euler_gamma
