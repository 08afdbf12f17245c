"""Sharding by weighted rendezvous hashing of stable record keys.

Each (key, shard) pair gets an independent uniform draw u; a record goes to the
shard with the smallest ``-ln(u) / weight``.  The decision depends only on the
key and on the shards' weights, so adding shard number n moves records only into
shard n, about ``w_n / sum(w)`` of them, and no record between old shards.

Everything is a Spark expression: no shuffle is needed to assign shards.

Defined results: a null key counts as the string ``\\N``; null text has zero
bytes and crc32 0; repeated rows share a shard and take consecutive slots; an
empty table gives an empty result.  ``shard_records`` passes other columns through,
a column named like a result is replaced; ``number_slots`` returns the group, the
identity and the slot alone, and no column name clashes with its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from careerloom.llm.shared import extended, shared_table

#: Rows that one task numbers at a time.
SLOT_BUCKET_ROWS = 50_000
#: Equal rows that one task unfolds at a time; more are dealt over tasks.
UNFOLD = 20_000
_SPAN = float(2**52)


def _draw(text: Column) -> Column:
    """A whole number below 2**52 from the first 13 hex digits of an MD5 digest."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def _key(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("\\N"))


def rendezvous_shards(key: Column, weights: Sequence[float], *, grown: float | None = None) -> tuple[Column, Column | None]:
    """Shard of ``key`` among ``weights``; with ``grown`` also the shard once a shard of that weight joins."""
    every = [float(w) for w in weights] + ([float(grown)] if grown is not None else [])
    if not weights or min(every) <= 0:
        raise ValueError("weights must be positive")
    text = _key(key)
    cost = F.array(*[-F.log((_draw(F.concat(text, F.lit(f":{s}"))) + 0.5) / _SPAN) / w for s, w in enumerate(every)])
    first = lambda costs, n: (F.array_position(c := F.slice(costs, 1, n), F.array_min(c)) - 1).cast("int")
    picked = F.transform(
        F.array(cost),
        lambda c: F.struct(first(c, len(weights)).alias("now"), first(c, len(every)).alias("grown")),
    )[0]
    return picked["now"], picked["grown"] if grown is not None else None


def shard_records(df: DataFrame, key: str, weights: Sequence[float], *, grown: float | None = None) -> DataFrame:
    """``df`` with columns shard (and grown_shard)."""
    now, then = rendezvous_shards(F.col(key), weights, grown=grown)
    fields = [now.alias("shard")] if then is None else [now.alias("shard"), then.alias("grown_shard")]
    return extended(df, F.struct(*fields), ["shard"] if then is None else ["shard", "grown_shard"])


def number_slots(df: DataFrame, group: str, identity: Sequence[str]) -> DataFrame:
    """Gapless slots from 0 within each ``group``, in the order of a hash of ``identity``.

    Equal rows are counted before the shuffle and unfolded after numbering, so a
    key that holds a third of all rows is one row here.  Groups are cut into
    buckets of the hash range; a bucket's first slot is the prefix sum of the
    bucket counts, so no task sorts a whole group.
    """
    names = [f"c{i}" for i in range(1 + len(identity))]
    group_, identity_ = names[0], names[1:]
    plain = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip([group, *identity], names)])
    order = _draw(F.concat_ws(":", *[_key(F.col(c)) for c in identity_]))
    counted = shared_table(plain.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).withColumn("_x", order), "slots")
    total = counted.agg(F.count(F.lit(1)), F.count_distinct(group_)).first()
    buckets = max(1, math.ceil(total[0] / max(1, total[1]) / SLOT_BUCKET_ROWS))
    bucketed = counted.withColumn("_b", F.floor(F.col("_x") / F.lit(_SPAN) * buckets).cast("int"))
    sizes = bucketed.groupBy(group_, "_b").agg(F.sum("_n").alias("_m"))
    before = W.partitionBy(group_).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col(group_).alias("_g"), F.col("_b").alias("_of"), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(group_, "_b").orderBy("_x", *[F.col(c).asc_nulls_first() for c in identity_]).rowsBetween(W.unboundedPreceding, -1)
    numbered = (
        bucketed.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(starts, F.col(group_).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_of")))
        .select(*names, "_n", (F.col("_start") + F.col("_in")).alias("_at"))
    )
    few = numbered.where(F.col("_n") <= UNFOLD).select(*names, "_at", (F.col("_at") + F.col("_n")).alias("_end"))
    parts = numbered.where(F.col("_n") > UNFOLD).select(*names, F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("_n") - 1, F.lit(UNFOLD).cast("long"))).alias("_from"), (F.col("_at") + F.col("_n")).alias("_end"))
    many = parts.select(*names, F.col("_from").alias("_at"), F.least("_end", F.col("_from") + UNFOLD).alias("_end")).repartition(group_, "_at")
    slots = few.unionByName(many).select(*names, F.explode(F.sequence(F.col("_at"), F.col("_end") - 1)).alias("slot"))
    return slots.select(*[F.col(n).alias(c) for n, c in zip(names, [group, *identity])], "slot")
