"""Helpers shared by the operators: table access and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    On one machine (tests) a temporary folder stands in where the setting is absent; on
    a cluster its absence is an error, for no machine's own folder is shared there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="careerloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the folder is scratch space by contract
        return


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again.

    The rows then survive the loss of any executor.  The folder is deleted when
    the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/careerloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on an Arrow batch to BATCH_BYTES: it bounds executor memory and no result.

    The bound holds in the JVM's buffers and in the worker, twice or more in each, for every
    task at once, so the default of 64 MB takes a good part of a small executor.
    """
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda variable over a one-element array is the only binding construct of
    the expression language; without it every use would evaluate ``value`` again.
    """
    return F.transform(F.array(value), body)[0]


def hidden(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def extended(df: DataFrame, value: Column, names: list[str]) -> DataFrame:
    """``df`` with the fields ``names`` of the struct ``value``; a column that has such a name is replaced."""
    own = hidden(df, "_careerloom")
    new = {n.lower() for n in names}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in new]
    return df.withColumn(own, value).select(*kept, *[F.col(f"{own}.{n}") for n in names])
