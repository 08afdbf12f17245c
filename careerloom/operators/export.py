"""Nested exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(df: DataFrame, key: str, fields: Sequence[str], order: Sequence[str], *, most: int | None = None, name: str = "rows") -> DataFrame:
    """A key's rows as a sorted array of structs, the first ``most`` of them; ``-c`` sorts down."""
    sort = [(-F.col(c[1:])).alias(f"_s{i}") if c.startswith("-") else F.col(c).alias(f"_s{i}") for i, c in enumerate(order)]
    rows = F.sort_array(F.collect_list(F.struct(*sort, *fields)))
    cut = rows if most is None else F.slice(rows, 1, most)
    return df.groupBy(key).agg(F.transform(cut, lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias(name))


def keyed_map(df: DataFrame, key: str, inner: str, value: Column) -> DataFrame:
    """Key -> {inner: value} as JSON with sorted inner keys."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(inner).cast("string").alias("k"), value.alias("v"))))
    return df.groupBy(key).agg(F.to_json(F.map_from_entries(entries)).alias("doc"))


def document(parts: dict[str, DataFrame]) -> DataFrame:
    """K5: one JSON document of small parts, each a single-row frame with a column ``doc``."""
    out = None
    for name, df in parts.items():
        one = df.select(F.col("doc").alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out.select(F.to_json(F.struct(*parts)).alias("doc"))
