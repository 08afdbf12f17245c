"""Global order without one task: ranks and running sums over range partitions.

A window without a partition key sorts the whole table in one task.  Here rows are
range-partitioned by the order, numbered inside their partition, and shifted by the
totals of the partitions before; only one row a partition is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from careerloom.sources.io import scratch


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder: every later read sees the same rows, whatever executor is lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch: the bound holds in the JVM and again in the worker, for every task at once.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on an Arrow batch to BATCH_BYTES: it bounds executor memory and no result."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


#: Rows of a side that is broadcast.
FEW = 100_000


def beside(df: DataFrame, most: int = FEW) -> DataFrame:
    """A dimension for a join or grid: broadcast where its number of rows, counted here, is at most ``most``; else as it is."""
    kept = materialised(df, "dimension")
    return F.broadcast(kept) if kept.count() <= most else kept


def running_sums(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """``df`` with inclusive running sums along ``order``, which must be total."""
    values = df.withColumns({f"_v{i}": v for i, v in enumerate(sums.values())} | {f"_o{i}": o for i, o in enumerate(_plain(order))})
    keys = [F.col(f"_o{i}") if not _descends(o) else F.col(f"_o{i}").desc() for i, o in enumerate(order)]
    # partition numbers must not change between the two reads below
    parted = materialised(values.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()), "ordered")
    inside = W.partitionBy("_p").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    totals = parted.groupBy("_p").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(sums))])
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition at most
    shifts = totals.select("_p", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_s{i}") for i in range(len(sums))])
    out = parted.join(F.broadcast(shifts), "_p")
    out = out.withColumns({name: F.sum(f"_v{i}").over(inside) + F.col(f"_s{i}") for i, name in enumerate(sums)})
    return out.select(*df.columns, *sums)


def _descends(order: Column) -> bool:
    return " DESC" in str(order)


def _plain(order: Sequence[Column]) -> list[Column]:
    """Sort expressions without their direction."""
    out = []
    for o in order:
        name = str(o).removeprefix("Column<'").removesuffix("'>")
        for tail in (" DESC NULLS LAST", " DESC NULLS FIRST", " ASC NULLS FIRST", " ASC NULLS LAST"):
            name = name.removesuffix(tail)
        out.append(F.col(name))
    return out


def row_numbers(df: DataFrame, order: Sequence[Column], name: str = "rn") -> DataFrame:
    """1-based positions along a total order of named columns."""
    return running_sums(df, order, {name: F.lit(1).cast("long")})


def dense_ids(df: DataFrame, value: str, name: str) -> DataFrame:
    """Distinct values with 0-based ids in their order."""
    ids = row_numbers(df.select(value).where(F.col(value).isNotNull()).distinct(), [F.col(value)], name)
    return ids.withColumn(name, (F.col(name) - 1).cast("int"))


def terciles(df: DataFrame, order: Sequence[Column], name: str = "pop_tier", labels: Sequence[str] = ("low", "medium", "high")) -> DataFrame:
    """Near-equal thirds by rank; a tier's edges 1 + (n - 1) / 3 and 1 + 2 (n - 1) / 3 are right-closed."""
    ranked = row_numbers(df, order, "_rn")
    n = ranked.count()
    r = F.col("_rn")
    cut = F.when(3 * (r - 1) <= n - 1, labels[0]).when(3 * (r - 1) <= 2 * (n - 1), labels[1]).otherwise(labels[2])
    return ranked.withColumn(name, cut).drop("_rn")
