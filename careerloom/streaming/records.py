"""Incremental record scan and repost removal (S7, W1) by Structured Streaming.

Files that arrive in a folder are read once each: the checkpoint knows which.  The
same call, made again later, takes in only what is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careerloom.operators.relational import keep_first


def take_in(spark: SparkSession, folder: str, schema: T.StructType, keys: DataFrame, key: str, target: str, checkpoint: str) -> DataFrame:
    """Appends the new files' records with a wanted key to ``target`` (Parquet) and reads all of it, one row a key.

    The stream itself keeps no state, so it needs no watermark; a key that comes twice,
    in one file or in several, is settled when the table is read.
    """
    new = spark.readStream.schema(schema).options(header=True, multiLine=True, escape='"').csv(folder)
    wanted = new.join(keys.select(key).distinct(), key, "left_semi")
    wanted.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(wanted.schema).parquet(target).dropDuplicates([key])


def earliest(spark: SparkSession, folder: str, schema: T.StructType, identity: list[str], time: str, delay: str, target: str, checkpoint: str) -> DataFrame:
    """Appends rows whose identity was not seen within ``delay`` of event time, then keeps the earliest of each.

    State is bounded by the watermark; what comes later than that is settled by the final
    read, so a late repost costs a row of storage and no wrong result.
    """
    new = spark.readStream.schema(schema).parquet(folder).withWatermark(time, delay)
    fresh = new.dropDuplicatesWithinWatermark([*identity, time])
    fresh.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return keep_first(spark.read.schema(fresh.schema).parquet(target), identity, [F.col(time).asc_nulls_last()])
