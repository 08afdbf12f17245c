"""Hash draws (M3): every random choice is a hash of a key, so it repeats on any cluster and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts, salt: str = "") -> Column:
    """A whole number below 2**32 from the MD5 digest of the salt and the parts."""
    key = F.concat_ws(":", F.lit(str(salt)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(*parts, salt: str = "") -> Column:
    """A number in [0, 1)."""
    return draw(*parts, salt=salt) / F.lit(float(2**32))
