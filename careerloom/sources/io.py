"""Sources and sinks.

Paths go through Spark's readers or the Hadoop file system, never ``open``, so any
store that Spark reads works.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (M5: one configured root).

    A session on one machine without that setting gets a temporary folder; a cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="careerloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/careerloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p, fs = _fs(spark, path)
        fs.delete(p, True)
    except Exception:  # the session is gone; the folder is scratch space by contract
        return


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def check_present(spark: SparkSession, paths: Sequence[str]) -> None:
    """M4: fail early with every missing input named."""
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"missing inputs: {', '.join(missing)}")


def find_one(spark: SparkSession, pattern: str, *, exclude: str = "context") -> str:
    """The first file by name that matches a glob, files named ``exclude`` left out."""
    p, fs = _fs(spark, pattern)
    names = sorted(str(s.getPath()) for s in (fs.globStatus(p) or []) if exclude not in s.getPath().getName().lower())
    if not names:
        raise FileNotFoundError(pattern)
    return names[0]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, *, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """CSV; without a schema every column is a string, so codes keep their zeros."""
    options = {"header": True, "escape": '"'} | options
    df = spark.read.schema(schema).options(**options).csv(path) if schema else spark.read.options(**options).csv(path)
    return df.select(*columns) if columns else df


#: Separators and encodings in the order they are tried.
DIALECTS = ((",", "UTF-8"), (";", "UTF-8"), ("\t", "UTF-8"), (",", "ISO-8859-1"))


def read_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """The first dialect whose header has more than one column; only headers are read to choose."""
    for sep, encoding in DIALECTS:
        df = spark.read.options(header=True, sep=sep, encoding=encoding).csv(path)
        if len(df.columns) > 1 and not any("�" in c for c in df.columns):
            return df
    raise ValueError(f"no dialect fits {path}")


def split_roles(columns: Sequence[str]) -> tuple[str, str, list[str]]:
    """(code column, name column, rating columns) by the header's words."""
    code = next((c for c in columns if "code" in c.lower()), columns[0])
    name = next((c for c in columns if c != code and any(w in c.lower() for w in ("label", "title", "name"))), None)
    name = name or next(c for c in columns if c != code)
    return code, name, [c for c in columns if c not in (code, name)]


def read_records(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """A multi-line CSV reduced to the keys wanted, one row a key."""
    df = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    return df.join(keys.select(key).distinct(), key, "left_semi").dropDuplicates([key])


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Every metric record of a folder."""
    return spark.read.option("multiLine", True).json(folder)


def build_or_load(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Build and write on a miss, read on a hit."""
    if not exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)


def load_ratings(df: DataFrame, required: Sequence[str] = ("occupation_id", "descriptor_id", "rating")) -> DataFrame:
    """M2: the rating fact, checked: required columns are there and no cell comes twice."""
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"columns missing: {lacking}")
    twice = df.groupBy("occupation_id", "descriptor_id").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("duplicate (occupation, descriptor) cells")
    return df


class Writer:
    """Sinks with a manifest (K8) of what was written."""

    def __init__(self):
        self.saved: list[str] = []

    def _note(self, path: str) -> str:
        self.saved.append(path)
        return path

    def csv(self, df: DataFrame, path: str, *, gzip: bool = False) -> str:
        """K1, K2"""
        df.write.options(header=True, escape='"', **({"compression": "gzip"} if gzip else {})).csv(path)
        return self._note(path)

    def parquet(self, df: DataFrame, path: str) -> str:
        """K3"""
        df.write.option("compression", "zstd").parquet(path)
        return self._note(path)

    def metric(self, spark: SparkSession, component: str, model: str, metrics: dict[str, float], folder: str, extra: dict[str, str] | None = None) -> str:
        """K4: one JSON record in a folder named component__model, other characters made safe."""
        safe = "".join(c if c.isalnum() or c in "_-" else "_" for c in f"{component}__{model}".lower().replace(" ", "_"))
        schema = "component string, model string, metrics map<string,double>, extra map<string,string>"
        row = [(component, model, {k: float(v) for k, v in metrics.items()}, extra or {})]
        path = os.path.join(folder, safe)
        spark.createDataFrame(row, schema).coalesce(1).write.json(path)
        return self._note(path)

    def model(self, scalars: dict[str, float], factors: dict[str, DataFrame], spark: SparkSession, path: str) -> str:
        """K6: factor tables and scalars as Parquet."""
        for name, df in factors.items():
            df.write.parquet(f"{path}/{name}")
        spark.createDataFrame([(k, float(v)) for k, v in scalars.items()], "name string, value double").coalesce(1).write.parquet(f"{path}/scalars")
        return self._note(path)


def load_model(spark: SparkSession, path: str, factors: Sequence[str]) -> tuple[dict[str, float], dict[str, DataFrame]]:
    """What ``Writer.model`` wrote."""
    scalars = {r.name: r.value for r in spark.read.parquet(f"{path}/scalars").collect()}  # a handful of named numbers
    return scalars, {n: spark.read.parquet(f"{path}/{n}") for n in factors}


def demo_postings(spark: SparkSession, rows: int) -> DataFrame:
    """Generated postings for tests, reproducible by hash."""
    h = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary")), 1, 6), 16, 10).cast("long")
    return spark.range(rows).select(
        F.concat(F.lit("title "), h("t") % 50).alias("job_title"),
        F.lpad((h("n") % 90000).cast("string"), 5, "0").alias("noc21_code"),
        F.element_at(F.array(*map(F.lit, ("ON", "QC", "BC", "AB"))), (h("p") % 4 + 1).cast("int")).alias("province"),
        (F.lit(20000.0) + h("s") % 120000).alias("salary_annual"),
        F.element_at(F.array(*map(F.lit, ("nov", "dec", "jan", "feb"))), (h("m") % 4 + 1).cast("int")).alias("source_month"),
    )
