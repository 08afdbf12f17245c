"""Split and sampling protocols (T1-T17, M1, M8): each adds a ``split`` or ``fold`` column by hash rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from careerloom.functions.draws import draw
from careerloom.operators.ordered import materialised
from careerloom.schemas import FOLDS, HOLDOUT


def _rank(by: Sequence[str], keys: Sequence[str], salt: str) -> tuple[Column, Column]:
    order = W.partitionBy(*by).orderBy(draw(*keys, salt=salt), *keys)
    return F.row_number().over(order), F.count(F.lit(1)).over(W.partitionBy(*by))


#: Ranges of the draw that a stratum is cut into: a task ranks one of them, not a stratum.
RANGES = 1024


def _ranked(df: DataFrame, stratum: str, keys: Sequence[str], salt: str) -> DataFrame:
    """``df`` with _r, the rank of each row of its stratum by draw, and _n, the stratum's size.

    The draw is cut into RANGES; a row's rank is its rank within its range plus the number
    of rows in the ranges before, which a table of strata x RANGES counts gives.
    """
    marked = materialised(df.withColumn("_d", draw(*keys, salt=salt)).withColumn("_b", F.floor(F.col("_d") / (2**32 // RANGES)).cast("int")), "drawn")
    sizes = marked.groupBy(F.col(stratum).alias("_s"), F.col("_b").alias("_of")).agg(F.count(F.lit(1)).alias("_m"))
    every = W.partitionBy("_s")
    starts = sizes.select("_s", "_of", (F.sum("_m").over(every.orderBy("_of")) - F.col("_m")).alias("_before"), F.sum("_m").over(every).alias("_n"))
    inside = F.row_number().over(W.partitionBy(stratum, "_b").orderBy("_d", *keys))
    joined = marked.withColumn("_i", inside).join(starts, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_of")))
    return joined.select(*df.columns, (F.col("_i") + F.col("_before")).alias("_r"), "_n")


def stratified(df: DataFrame, keys: Sequence[str], stratum: str, fraction: float = HOLDOUT, salt: str = "42") -> DataFrame:
    """The first round(fraction * n) of each stratum by hash are test; a singleton trains."""
    test = (F.col("_n") > 1) & (F.col("_r") <= F.floor(F.col("_n") * fraction + 0.5))
    return _ranked(df, stratum, keys, salt).withColumn("split", F.when(test, "test").otherwise("train")).drop("_r", "_n")


def random_split(df: DataFrame, keys: Sequence[str], fraction: float = HOLDOUT, salt: str = "42") -> DataFrame:
    """Every row tests with the given probability, by its own hash; nothing is shuffled."""
    return df.withColumn("split", F.when(draw(*keys, salt=salt) < int(fraction * 2**32), "test").otherwise("train"))


def with_validation(df: DataFrame, keys: Sequence[str], stratum: str, fraction: float = HOLDOUT) -> DataFrame:
    """A stratified test part, and the same fraction of what trains as validation."""
    outer = stratified(df, keys, stratum, fraction)
    inner = stratified(outer.where("split = 'train'").drop("split"), keys, stratum, fraction, salt="inner")
    return outer.where("split = 'test'").unionByName(inner.withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train")))


def folds(df: DataFrame, keys: Sequence[str], stratum: str, k: int = FOLDS, salt: str = "42") -> DataFrame:
    """Stratified folds 0..k-1."""
    return _ranked(df, stratum, keys, salt).withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r", "_n")


def leave_one_out(core: DataFrame, entity: str, item: str, salt: str = "42") -> DataFrame:
    """One core item of each entity that has two or more."""
    r, n = _rank([entity], [entity, item], salt)
    return core.withColumns({"_r": r, "_n": n}).where("_r = 1 and _n >= 2").drop("_r", "_n")


def temporal(df: DataFrame, column: str, cutoff: str) -> DataFrame:
    """T5: train before the cutoff, test from it on; null dates are dropped."""
    return df.where(F.col(column).isNotNull()).withColumn("split", F.when(F.col(column) < F.lit(cutoff).cast("timestamp"), "train").otherwise("test"))


def by_region(df: DataFrame, column: str, held: Sequence[str]) -> DataFrame:
    """T6"""
    return df.where(F.col(column).isNotNull()).withColumn("split", F.when(F.col(column).isin(*held), "test").otherwise("train"))


def three_way(df: DataFrame, key: str, strata: Sequence[str], gold: Column, fraction: float = 0.15, salt: str = "42") -> DataFrame:
    """Test, validation and train by stratum; gold rows are always test."""
    w = W.partitionBy(*strata, "_gold").orderBy(draw(key, salt=salt), key)
    marked = df.withColumn("_gold", F.coalesce(gold, F.lit(False)))
    r, n = F.row_number().over(w), F.count(F.lit(1)).over(W.partitionBy(*strata, "_gold"))
    size = F.floor(n * fraction + 0.5)
    return marked.withColumn("split", F.when(F.col("_gold") | (r <= size), "test").when(r <= 2 * size, "val").otherwise("train")).drop("_gold")


def cold_entities(df: DataFrame, entity: str, n: int, salt: str = "42") -> DataFrame:
    """The ids of ``n`` entities that are removed entirely."""
    ids = df.select(entity).distinct()
    return ids.withColumn("_d", draw(entity, salt=salt)).orderBy("_d", entity).limit(n).drop("_d")


def edge_leakage(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on both sides; must be 0 for a sound edge split."""
    return train.select(*keys).distinct().join(test.select(*keys).distinct(), list(keys), "left_semi").agg(F.count(F.lit(1)).alias("shared"))


def temporal_leakage(df: DataFrame, column: str) -> DataFrame:
    """Whether the latest training row comes before the earliest test row."""
    latest, earliest = F.max(F.when(F.col("split") == "train", F.col(column))), F.min(F.when(F.col("split") == "test", F.col(column)))
    return df.agg((latest < earliest).alias("sound"))


def query_sets(test: DataFrame, candidates: DataFrame, keys: Sequence[str], rating: str = "rating") -> DataFrame:
    """Candidates with binary and graded relevance; ambiguous ratings are masked, unseen ones are irrelevant."""
    out = candidates.join(test.select(*keys, rating), list(keys), "left")
    r = F.col(rating)
    return out.withColumns({"graded": F.coalesce(r, F.lit(0.0)), "relevant": F.coalesce((r >= 4).cast("int"), F.lit(0)), "masked": F.coalesce((r < 4) & (r > 1), F.lit(False))})


def negatives(df: DataFrame, label: str, keys: Sequence[str], *, least: int = 1500, ratio: int = 10, salt: str = "42") -> DataFrame:
    """Every positive and max(least, ratio * positives) negatives by hash."""
    n = df.agg(F.greatest(F.lit(least), ratio * F.coalesce(F.sum(label), F.lit(0))).alias("_most"))
    some = df.where(F.col(label) == 0)
    budget = n.first()[0]
    drawn = some.withColumn("_d", draw(*keys, salt=salt)).orderBy("_d", *keys).limit(int(budget)).drop("_d")
    return df.where(F.col(label) == 1).unionByName(drawn)
