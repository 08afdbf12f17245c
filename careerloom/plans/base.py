"""Domain frames over the driver's tables, and the matching SQL.

Occupation is a supplier, descriptor a part brand, rating the banded quantity of
their cell; a posting is an order, posting text a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerloom.sources.io import table

#: Band edges of the quantity in standard deviations, about a sixth of the cells a band.
EDGES = (-0.97, -0.43, 0.0, 0.43, 0.97)


class Registry:
    """Collects queries and oracles of one module."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracles[f.__name__] = sql
            return f

        return add


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(occ, item, q): quantity of each supplier and brand."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return line.join(part, "l_partkey").groupBy(F.col("l_suppkey").alias("occ"), F.col("p_brand").alias("item")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("q"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(occ, item, rating): the rating fact, 0..5 by global mean and deviation; no global sort."""
    c = cells(spark, sf_dir)
    stats = c.agg(F.round(F.avg("q"), 6).alias("_m"), F.round(F.stddev_pop("q"), 6).alias("_s"))
    rating = sum((F.col("q") > F.col("_m") + e * F.col("_s")).cast("int") for e in EDGES).cast("double")
    return c.crossJoin(F.broadcast(stats)).select("occ", "item", rating.alias("rating"))


_BAND = " + ".join(f"(q > m + ({e}) * s)::INT" for e in EDGES)
RATINGS = f"""cells AS (
  SELECT l_suppkey AS occ, p_brand AS item, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
stats AS (SELECT round(avg(q), 6) AS m, round(stddev_pop(q), 6) AS s FROM cells),
ratings AS (SELECT occ, item, ({_BAND})::DOUBLE AS rating FROM cells, stats)"""


def draw_sql(salt: str, *parts: str) -> str:
    key = "concat_ws(':', '" + salt + "', " + ", ".join(f"({p})::VARCHAR" for p in parts) + ")"
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"




def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with region, nation code and month: the posting table."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    joined = o.join(c, "o_custkey").join(n, "n_nationkey").join(r, "r_regionkey")
    return joined.select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus", "c_mktsegment", F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("code"), F.col("n_name").alias("nation"), F.col("r_name").alias("region")
    )


POSTINGS = """postings AS (
  SELECT o.*, c_mktsegment, lpad(n_nationkey::VARCHAR, 5, '0') AS code, n_name AS nation, r_name AS region
  FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
CUTOFF = "2000-01-01"
