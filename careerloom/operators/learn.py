"""Learners on pyspark.ml and their audits.

Where an estimator differs from the one the metrics were published for, its
docstring says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from careerloom.functions.draws import draw
from careerloom.operators.metrics import per_class


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def class_weights(df: DataFrame, label: str, custom: dict[float, float] | None = None) -> DataFrame:
    """L3: weight n / (k n_c), or the given weight a class."""
    if custom:
        w = F.lit(1.0)
        for k, v in custom.items():
            w = F.when(F.col(label) == k, F.lit(float(v))).otherwise(w)
        return df.withColumn("weight", w)
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = n.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return df.join(F.broadcast(n), label).crossJoin(F.broadcast(total)).withColumn("weight", F.col("_n") / (F.col("_k") * F.col("_nc"))).drop("_nc", "_n", "_k")


def classifier(name: str, label: str, *, n_features: int = 0, n_classes: int = 2, **options):
    """L1-L5 by name; the scaler is part of a model that needs it (sample deviation, ddof = 1)."""
    scaled = lambda est: Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), est])
    if name == "logreg":
        return scaled(LogisticRegression(featuresCol="scaled", labelCol=label, family="multinomial", regParam=options.get("reg", 0.01), maxIter=50))
    if name == "rf":
        forest = RandomForestClassifier(labelCol=label, numTrees=options.get("trees", 50), maxDepth=options.get("depth", 6), minInstancesPerNode=options.get("leaf", 1), seed=42)
        return forest.setWeightCol(options["weight"]) if options.get("weight") else forest
    if name == "gbt":  # binary in pyspark.ml, so one against the rest for more classes
        est = GBTClassifier(labelCol=label, maxIter=options.get("iters", 10), maxDepth=3, seed=42)
        return est if n_classes == 2 else OneVsRest(classifier=est, labelCol=label)
    if name == "mlp":  # logistic hidden units, no weights
        return scaled(MultilayerPerceptronClassifier(featuresCol="scaled", labelCol=label, layers=[n_features, 16, n_classes], maxIter=options.get("iters", 50), seed=42))
    raise ValueError(name)


def regressor(name: str, label: str, **options):
    """L7-L9 by name."""
    if name == "linear":
        return LinearRegression(labelCol=label, regParam=options.get("reg", 0.0))
    if name == "rf":
        return RandomForestRegressor(labelCol=label, numTrees=options.get("trees", 20), maxDepth=options.get("depth", 10), minInstancesPerNode=options.get("leaf", 20), seed=42)
    if name == "gbt":
        return GBTRegressor(labelCol=label, maxIter=options.get("iters", 10), maxDepth=4, stepSize=0.1, seed=42)
    raise ValueError(name)


def encoded(categories: Sequence[str], numbers: Sequence[str], *, one_hot: bool) -> Pipeline:
    """Ordinal codes by name order, or one-hot; an unseen value gets a code of its own."""
    index = StringIndexer(inputCols=list(categories), outputCols=[f"{c}_i" for c in categories], stringOrderType="alphabetAsc", handleInvalid="keep")
    stages, names = [index], [f"{c}_i" for c in categories]
    if one_hot:
        stages.append(OneHotEncoder(inputCols=names, outputCols=[f"{c}_h" for c in categories], handleInvalid="keep"))
        names = [f"{c}_h" for c in categories]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[*names, *numbers], outputCol="features", handleInvalid="keep")])


def weighted_cells(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """One row for each combination of ``keys``: the mean of the label and, as ``weight``, its rows."""
    return df.where(F.col(label).isNotNull()).groupBy(*keys).agg(F.avg(label).alias(label), F.count(F.lit(1)).cast("double").alias("weight"))


#: Cells of categories whose trees are grown from sums; more of them are left to pyspark.ml, on rows.
FEW_CELLS = 4096


class Grid:
    """The cells of a few categories, seen or wanted: their codes, rows and sums; ``of`` gives None beyond FEW_CELLS.

    A row's features are its cell, so sums by cell grow the trees of the rows.
    """

    def __init__(self, keys: Sequence[str], kinds: str, cells: dict[tuple, tuple[float, float]], wanted: Sequence[tuple]):
        self.keys, self.kinds = list(keys), kinds
        self.cells = list(dict.fromkeys([*cells, *wanted]))
        self.n = np.array([cells.get(c, (0, 0))[0] for c in self.cells], float)
        self.s = self.n * np.array([cells.get(c, (0, 0))[1] for c in self.cells], float)
        names = [sorted({c[f] for c in cells if c[f] is not None}, key=str) for f in range(len(keys))]
        self.arity = [len(v) + 1 for v in names]  # the last code is of null and of values not seen
        codes = [{v: i for i, v in enumerate(values)} for values in names]
        self.x = np.array([[codes[f].get(v, len(codes[f])) for f, v in enumerate(c)] for c in self.cells], np.int64).reshape(-1, len(keys))

    @classmethod
    def of(cls, cells: DataFrame, wanted: DataFrame, keys: Sequence[str], label: str):
        """From ``weighted_cells`` and the distinct cells to predict."""
        own, others = cells.select(*keys, "weight", label).limit(FEW_CELLS + 1).collect(), wanted.select(*keys).limit(FEW_CELLS + 1).collect()
        if not own or len(own) > FEW_CELLS or len(others) > FEW_CELLS:
            return None
        kinds = ", ".join(f"{k} {kind}" for k, kind in cells.select(*keys).dtypes)
        return cls(keys, kinds, {tuple(r)[:-2]: tuple(r)[-2:] for r in sorted(own, key=str)}, sorted(map(tuple, others), key=str))

    def frame(self, spark: SparkSession) -> DataFrame:
        """The cells with their number, ``_cell``."""
        return spark.createDataFrame([(*c, i) for i, c in enumerate(self.cells)], f"{self.kinds}, _cell int")


def _tree(x: np.ndarray, arity: Sequence[int], n: np.ndarray, s: np.ndarray, *, depth: int, leaf: float, some: int = 0, rng=None) -> np.ndarray:
    """Predictions of every cell by one regression tree of cells with n rows and label sums s.

    As in pyspark.ml a node's categories are ordered by their means and cut once; categories without rows go right.
    Each node tries ``some`` features drawn anew, or all.
    """
    out, nodes = np.empty(len(x)), [(np.arange(len(x)), 0)]
    while nodes:
        at, level = nodes.pop()
        own, rows, sums = x[at], n[at], s[at]
        w, t = rows.sum(), sums.sum()
        out[at] = t / w
        if level == depth:
            continue
        top, left = t * t / w, None
        for f in np.sort(rng.permutation(x.shape[1])[:some]) if some else range(x.shape[1]):
            wf, sf = np.bincount(own[:, f], rows, arity[f]), np.bincount(own[:, f], sums, arity[f])
            have = np.flatnonzero(wf)
            have = have[np.argsort(sf[have] / wf[have], kind="stable")]
            wl, sl = np.cumsum(wf[have])[:-1], np.cumsum(sf[have])[:-1]
            can = np.flatnonzero((wl >= leaf) & (w - wl >= leaf))
            if len(can):
                gain = sl[can] ** 2 / wl[can] + (t - sl[can]) ** 2 / (w - wl[can])
                first = int(np.argmax(gain >= gain.max() * (1 - 1e-12)))
                if gain[first] > top * (1 + 1e-12):
                    top, left = gain[first], np.isin(own[:, f], have[: can[first] + 1])
        if left is not None:
            nodes += [(at[~left], level + 1), (at[left], level + 1)]
    return out


def boosted_cells(spark: SparkSession, grid: Grid, *, iters: int, depth: int = 4, step: float = 0.1) -> DataFrame:
    """(keys, prediction) of the cells by the trees of ``regressor("gbt")``: squared loss, no draws."""
    own = dict(depth=depth, leaf=1)
    value = _tree(grid.x, grid.arity, grid.n, grid.s, **own)
    for _ in range(1, iters):
        value = value + step * _tree(grid.x, grid.arity, grid.n, 2 * (grid.s - grid.n * value), **own)
    return spark.createDataFrame([(*c, float(v)) for c, v in zip(grid.cells, value)], f"{grid.kinds}, prediction double")


def _poisson_table() -> np.ndarray:
    """The Poisson(1) count of each 16-bit draw."""
    steps = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 9)]))
    return np.searchsorted(steps, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def bootstrap_counts(h: np.ndarray, trees: int) -> np.ndarray:
    """(rows, trees): how often each tree draws each row, from 64 bits of the row's key; four trees share a mixed word."""
    table, out = _poisson_table(), np.empty((len(h), -(-trees // 4) * 4), np.uint8)
    with np.errstate(over="ignore"):
        for g in range(out.shape[1] // 4):
            z = h.view(np.uint64) + np.uint64((g + 1) * 0x9E3779B97F4A7C15 % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[:, 4 * g : 4 * g + 4] = table[(z ^ (z >> np.uint64(31))).astype("<u8").view("<u2").reshape(-1, 4)]
    return out[:, :trees]


def forest_cells(rows: DataFrame, grid: Grid, key: Sequence[str], label: str, *, trees: int, depth: int = 10, leaf: int = 20) -> DataFrame:
    """(keys, prediction) of the cells by a forest like ``regressor("rf")``'s: Poisson draws of every row for every tree, a third of the features a node.

    One pass over the rows sums what each tree draws of each cell; each tree is grown from its sums in its own small group.
    """
    spark, cells, whole = rows.sparkSession, grid.frame(rows.sparkSession), len(grid.cells)
    same = F.lit(True)
    for k in grid.keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    numbered = F.broadcast(cells.select(*[F.col(k).alias(f"_{k}") for k in grid.keys], "_cell"))
    drawn = rows.where(F.col(label).isNotNull()).join(numbered, same).select(F.xxhash64(*key, F.lit("forest")).alias("h"), "_cell", F.col(label).cast("double").alias("y"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros((whole, trees)), np.zeros((whole, trees))
        for b in batches:
            for start in range(0, b.num_rows, 10_000):
                h, c, y = (b.column(j)[start : start + 10_000].to_numpy() for j in range(3))
                order = np.argsort(c, kind="stable")
                found, first = np.unique(c[order], return_index=True)
                count = bootstrap_counts(h[order], trees).astype(float)
                n[found] += np.add.reduceat(count, first)
                count *= y[order, None]
                s[found] += np.add.reduceat(count, first)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(trees), pa.int32()), *[pa.array([v.tobytes() for v in m.T], pa.binary()) for m in (n, s)]], names=["tree", "n", "s"])

    x, arity, few = grid.x, grid.arity, -(-len(grid.keys) // 3)

    def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
        n, s = (sum(np.frombuffer(v) for v in pdf[c]) for c in ("n", "s"))
        value = _tree(x, arity, n, s, depth=depth, leaf=leaf, some=few, rng=np.random.Generator(np.random.PCG64([42, key[0]]))) if n.any() else np.full(whole, np.nan)
        return pd.DataFrame({"_cell": np.arange(whole, dtype=np.int32), "prediction": value})

    grown = drawn.mapInArrow(sums, "tree int, n binary, s binary").groupBy("tree").applyInPandas(grow, "_cell int, prediction double")
    mean = grown.where(~F.isnan("prediction")).groupBy("_cell").agg(F.avg("prediction").alias("prediction"))
    return mean.join(F.broadcast(cells), "_cell").select(*grid.keys, "prediction")


def out_of_fold(df: DataFrame, make: Callable, key: str, label: str, folds: int = 5) -> DataFrame:
    """Each row's prediction and probabilities by the model that did not see its fold."""
    out = None
    for f in range(folds):
        model = make().fit(df.where(F.col("fold") != f))
        part = model.transform(df.where(F.col("fold") == f)).select(key, label, "fold", "prediction", vector_to_array("probability").alias("proba"))
        out = part if out is None else out.unionByName(part)
    return out


def grid_search(df: DataFrame, make: Callable, grid: Sequence[dict], key: str, label: str, folds: int = 5) -> list[tuple[dict, float]]:
    """Mean macro F1 over the folds of each point, best first (macro F1 averages classes, so it is computed here)."""
    scored = []
    for point in grid:
        preds = out_of_fold(df, lambda p=point: make(**p), key, label, folds)
        value = per_class(preds, label, "prediction").agg(F.avg("f1")).first()[0]
        scored.append((point, float(value)))
    return sorted(scored, key=lambda s: -s[1])


def best_by(results: DataFrame, metric: str) -> DataFrame:
    """The row of the smallest metric, ties to the smallest name."""
    return results.orderBy(metric, "model").limit(1)


def importances(model, features: Sequence[str]) -> list[tuple[str, float]]:
    """Impurity importances, largest first."""
    return sorted(zip(features, model.featureImportances.toArray().tolist()), key=lambda p: (-p[1], p[0]))


def permutation_importance(df: DataFrame, model, features: Sequence[str], key: str, label: str, salt: str = "42") -> DataFrame:
    """Mean absolute change of the prediction when one feature is permuted by hash.

    Stands in for tree SHAP values, whose tree structure pyspark.ml does not expose; it
    is a different statistic and is labelled so.
    """
    base = model.transform(assemble(df, features)).select(key, F.col("prediction").alias("_base"))
    out = None
    order = W.partitionBy("_g").orderBy("_d", key)
    for f in features:
        # permuted inside hash groups, so no task sorts the whole table
        grouped = df.withColumn("_g", draw(key, salt="g") % 64)
        shuffled = grouped.withColumn("_d", draw(key, salt=salt + f)).select("_g", F.row_number().over(order).alias("_n"), F.col(f).alias("_x"))
        own = grouped.withColumn("_d", draw(key, salt="own" + f)).withColumn("_n", F.row_number().over(order))
        mixed = own.join(shuffled, ["_g", "_n"]).withColumn(f, F.col("_x")).drop("_x", "_g", "_n", "_d")
        moved = model.transform(assemble(mixed, features)).select(key, F.col("prediction").alias("_moved"))
        row = base.join(moved, key).agg(F.lit(f).alias("feature"), F.avg(F.abs(F.col("_base").cast("double") - F.col("_moved").cast("double"))).alias("importance"))
        out = row if out is None else out.unionByName(row)
    return out


def isotonic(df: DataFrame, score: str, label: str):
    """A monotone map of scores; outside the fitted range it keeps the edge value."""
    return IsotonicRegression(featuresCol=score, labelCol=label).fit(df.select(score, F.col(label).cast("double").alias(label)))


def platt(df: DataFrame, score: str, label: str):
    """Logistic calibration of one score."""
    return LogisticRegression(featuresCol="features", labelCol=label, probabilityCol="p").fit(assemble(df.select(score, F.col(label).cast("double").alias(label)), [score]))


def calibrate_ovr(train: DataFrame, rows: DataFrame, n_classes: int, label: str) -> DataFrame:
    """Isotonic calibration class by class over ``proba``, then scaled to sum to 1."""
    out = rows.drop("prediction")
    for c in range(n_classes):
        fit = isotonic(train.select(F.get("proba", F.lit(c)).alias("s"), (F.col(label) == c).cast("double").alias("y")), "s", "y")
        out = fit.transform(out.withColumn("s", F.get("proba", F.lit(c)))).withColumnRenamed("prediction", f"_c{c}").drop("s")
    total = sum(F.col(f"_c{c}") for c in range(n_classes))
    cells = F.array(*[F.when(total > 0, F.col(f"_c{c}") / total).otherwise(1.0 / n_classes) for c in range(n_classes)])
    return out.withColumn("calibrated", cells).drop(*[f"_c{c}" for c in range(n_classes)])


def calibrate_platt(train: DataFrame, rows: DataFrame, n_classes: int, label: str) -> DataFrame:
    """Logistic calibration class by class over ``proba``, then scaled to sum to 1."""
    out = rows.drop("prediction")
    for c in range(n_classes):
        fit = platt(train.select(F.get("proba", F.lit(c)).alias("s"), (F.col(label) == c).cast("double").alias("y")), "s", "y")
        scored = fit.transform(assemble(out.withColumn("s", F.get("proba", F.lit(c))), ["s"]))
        out = scored.withColumn(f"_c{c}", F.get(vector_to_array("p"), F.lit(1))).drop("s", "features", "rawPrediction", "p", "prediction")
    total = sum(F.col(f"_c{c}") for c in range(n_classes))
    return out.withColumn("calibrated", F.array(*[F.col(f"_c{c}") / total for c in range(n_classes)])).drop(*[f"_c{c}" for c in range(n_classes)])


def calibrated_out_of_fold(df: DataFrame, make: Callable, key: str, label: str, n_classes: int, *, folds: int = 5, inner: int = 3) -> DataFrame:
    """(key, label, method, proba) with method raw, sigmoid or isotonic, each row by models that never saw it.

    Inside the training part of each fold, ``inner`` folds give out-of-fold
    probabilities; the maps are fitted on those, and applied to the held-out rows.
    """
    out = None
    for f in range(folds):
        own = df.where(F.col("fold") != f).withColumn("fold", (draw(key, salt=f"inner{f}") % inner).cast("int"))
        seen = out_of_fold(own, make, key, label, inner)
        raw = make().fit(own).transform(df.where(F.col("fold") == f)).select(key, label, vector_to_array("probability").alias("proba"))
        parts = [raw.select(key, label, F.lit("raw").alias("method"), "proba")]
        for method, calibrate in (("sigmoid", calibrate_platt), ("isotonic", calibrate_ovr)):
            parts.append(calibrate(seen, raw, n_classes, label).select(key, label, F.lit(method).alias("method"), F.col("calibrated").alias("proba")))
        for part in parts:
            out = part if out is None else out.unionByName(part)
    return out


#: Rows of a class whose neighbours one task of ``smote`` looks for.
SMOTE_BLOCK = 4096


def smote(df: DataFrame, features: Sequence[str], label: str, key: str, *, k: int = 3) -> DataFrame:
    """The smaller classes filled up to the largest with points between a row and one of its k nearest.

    A task takes the points of SMOTE_BLOCK rows of a class, beside all rows of that class; the
    draws are those of the whole class, so the points do not depend on the blocks.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().where(F.col(label).isNotNull()).collect()}  # one row a class
    top = max(sizes.values(), default=0)
    need = {c: top - n for c, n in sizes.items() if 1 < n < top}
    blocks = {c: -(-sizes[c] // SMOTE_BLOCK) for c in need}
    schema = ", ".join([f"{f} double" for f in features] + [f"{label} double"])

    def make(group, pdf: pd.DataFrame) -> pd.DataFrame:
        c, block = group
        pdf = pdf.sort_values(key)
        x = pdf[list(features)].to_numpy(float)
        rng = np.random.Generator(np.random.PCG64(42))
        base = rng.integers(0, len(x), need[c])
        pick, part = rng.integers(0, min(k, len(x) - 1), len(base)), rng.random((len(base), 1))
        mine = (base >= block * SMOTE_BLOCK) & (base < (block + 1) * SMOTE_BLOCK)
        base, pick, part = base[mine], pick[mine], part[mine]
        drawn, at = np.unique(base, return_inverse=True)
        near = _nearest(x, drawn, min(k, len(x) - 1))
        new = x[base] + part * (x[near[at, pick]] - x[base])
        return pd.DataFrame(new, columns=list(features)).assign(**{label: float(c)})

    whole = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias(label))
    if not need:
        return whole
    number = F.element_at(F.create_map(*[F.lit(v) for c, n in blocks.items() for v in (c, n)]), F.col(label))
    some = df.where(F.col(label).isin(*need)).select(key, label, *features).withColumn("_block", F.explode(F.sequence(F.lit(0), number - 1)))
    return whole.unionByName(some.groupBy(label, "_block").applyInPandas(make, schema))


def _nearest(x: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """For each of ``rows`` of x its k nearest other rows, ties to the smaller position."""
    out = np.empty((len(rows), k), np.int64)
    step = max(1, 2_000_000 // max(1, len(x)))
    for at in range(0, len(rows), step):
        some = rows[at : at + step]
        d = np.zeros((len(some), len(x)))
        for f in range(x.shape[1]):
            d += (x[some, f][:, None] - x[None, :, f]) ** 2
        d[np.arange(len(some)), some] = np.inf
        edge = np.partition(d, k - 1, axis=1)[:, k - 1]
        for n in range(len(some)):
            c = np.flatnonzero(~(d[n] > edge[n]))
            out[at + n] = c[np.argsort(d[n, c], kind="stable")[:k]]
    return out


def opportunities(model, cells: DataFrame, k: int = 3) -> DataFrame:
    """The grid cells of highest prediction."""
    return model.transform(cells).orderBy(F.desc("prediction"), *cells.columns[:2]).limit(k)

