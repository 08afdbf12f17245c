"""Exact top-k inner products by a pivot-distance index.

Largest inner product becomes nearest neighbour by one more component: a vector v
gets sqrt(M - |v|^2), M the largest squared norm, a query gets 0, and
|q - v|^2 = |q|^2 + M - 2 q.v.  Every vector is keyed by its nearest pivot and by
the ring (annulus) of its distance to it.  A query expands rings in the order of
their lower bounds: |d(q, p) - d(p, v)| <= d(q, v) bounds every score of a ring from
above.  A first round evaluates each query's nearest rings and fixes a k-th score;
a second one evaluates just the rings whose bound still reaches it.

Pivots come from a bounded sample (PIVOT_SAMPLE vectors); every row is indexed.
Rings are cut into chunks of at most CHUNK_ROWS rows and queries into groups of
QUERY_ROWS, and a task scores one group against one chunk in one matrix product; a
chunk is shipped only to the groups of which a query visits it.
The ring table (pivots x rings rows at most) is all that reaches the driver.

Defined results: vectors that are null or hold a null, NaN or infinity take no
part; shorter vectors count as padded with zeros; a query's own rows (equal id)
are no candidates; repeated rows are candidates each; equal query rows count once;
fewer than k candidates give fewer rows; scores are exact while they fit 63 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from careerloom.llm.shared import bound_batches, shared_table

PIVOTS, RINGS = 32, 8
PIVOT_SAMPLE = 4096
CHUNK_ROWS, QUERY_ROWS = 8192, 2048
#: A query's first round reads nearest rings until they hold this many rows.
SEED_ROWS = 256
_INDEX = "vec_id bigint, v array<bigint>, pivot int, dist double, slot bigint"
_FOUND = "query_id bigint, vec_id bigint, score bigint, qk bigint"


def whole_components(vector: Column, scale: int = 1024) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Cluster centres of the sample (Lloyd's steps from spread rows)."""
    rng = np.random.Generator(np.random.PCG64(11))
    if len(sample) <= count:
        return sample
    centres = sample[rng.choice(len(sample), count, replace=False)]
    for _ in range(8):
        near = _distances(sample, centres).argmin(axis=1)
        centres = np.stack([sample[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
    return centres


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * x @ p.T, 0))


def _whole(vectors, dim: int) -> np.ndarray:
    """Vectors as rows of 64-bit integers, padded with zeros."""
    out = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _dense(vectors, dim: int) -> np.ndarray:
    return _whole(vectors, dim).astype(np.float64)


def _raise_dim(x: np.ndarray, largest: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(largest - (x**2).sum(1), 0))])


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating point where every sum fits its 53 bits."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * x.shape[1] < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def _evaluate(k: int, dim: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": [], "qk": []}
        if len(queries) and len(rows):
            ids = rows["vec_id"].to_numpy(np.int64, na_value=np.iinfo(np.int64).max)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], _whole(rows["v"].to_numpy()[order], dim)
            for at in range(0, len(queries), 128):
                part = queries.iloc[at : at + 128]
                s = _scores(_whole(part["q"].to_numpy(), dim), x)
                for qid, qk, line in zip(part["query_id"], part["qk"], s):
                    mine = np.flatnonzero(ids != qid)
                    line = line[mine]
                    if len(line) > k:
                        kth = np.partition(line, len(line) - k)[len(line) - k]
                        keep = np.flatnonzero(line >= kth)
                    else:
                        keep = np.arange(len(line))
                    keep = keep[np.lexsort((ids[mine[keep]], -line[keep]))][:k]
                    out["query_id"] += [qid] * len(keep)
                    out["vec_id"] += ids[mine[keep]].tolist()
                    out["score"] += line[keep].tolist()
                    out["qk"] += [qk] * len(keep)
        return pd.DataFrame(out)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id", "qk").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score.  ``vectors`` and ``queries``: (vec_id, v array<bigint>)."""
    spark = vectors.sparkSession
    bound_batches(spark)
    facts = vectors.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    if facts[0] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, largest = max(1, facts[0]), float(facts[1])
    sample = vectors.select("vec_id", "v").orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PIVOT_SAMPLE).toPandas()
    pivots = _pivots(_raise_dim(_dense(sample["v"].to_numpy(), dim), largest), PIVOTS)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        rng = np.random.Generator(np.random.PCG64(TaskContext.get().partitionId()))
        for b in batches:
            if len(b):
                d = _distances(_raise_dim(_dense(b["v"].to_numpy(), dim), largest), pivots)
                near = d.argmin(axis=1)
                yield pd.DataFrame({"vec_id": b["vec_id"], "v": b["v"], "pivot": near.astype(np.int32), "dist": d[np.arange(len(b)), near], "slot": rng.integers(0, 2**40, len(b))})

    index = shared_table(vectors.select("vec_id", "v").mapInPandas(assign, _INDEX), "index")
    width = index.agg(F.max("dist")).first()[0] / RINGS or 1.0
    ringed = index.withColumn("ring", F.least(F.floor(F.col("dist") / F.lit(width)), F.lit(RINGS - 1)).cast("int"))
    rings = ringed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).toPandas()  # PIVOTS x RINGS rows at most
    chunks = {(int(r.pivot), int(r.ring)): max(1, math.ceil(r.n / CHUNK_ROWS)) for r in rings.itertuples()}
    n_queries = queries.count()
    groups = max(1, math.ceil(n_queries / QUERY_ROWS))
    n_chunks = spark.createDataFrame([(p, r, c) for (p, r), c in chunks.items()], "pivot int, ring int, n_chunks int")
    blocks = ringed.join(F.broadcast(n_chunks), ["pivot", "ring"]).select("vec_id", "v", "pivot", "ring", (F.col("slot") % F.col("n_chunks")).cast("int").alias("chunk"))
    own = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).withColumn("qk", F.xxhash64("q")).dropDuplicates(["query_id", "qk"])
    asked = own.withColumn("grp", F.pmod(F.xxhash64("query_id", "qk"), F.lit(groups)).cast("int"))
    table = rings.sort_values(["pivot", "ring"]).reset_index(drop=True)
    near_pivot, lo, hi, size = table["pivot"].to_numpy(), table["lo"].to_numpy(), table["hi"].to_numpy(), table["n"].to_numpy()
    ring_no = table["ring"].to_numpy()
    slack = 1e-7 * max(1.0, largest)

    def expand(batches: Iterator[pd.DataFrame], second: bool) -> Iterator[pd.DataFrame]:
        """The rings that each query visits in this round."""
        for b in batches:
            out = {"query_id": [], "q": [], "qk": [], "grp": [], "pivot": [], "ring": [], "chunk": []}
            if len(b):
                x = _dense(b["q"].to_numpy(), dim)
                d = _distances(np.column_stack([x, np.zeros(len(x))]), pivots)[:, near_pivot]
                bound = np.maximum(0, np.maximum(d - hi, lo - d))
                norm = (x**2).sum(1)
                for i in range(len(b)):
                    order = np.argsort(bound[i], kind="stable")
                    before = np.cumsum(size[order]) - size[order]
                    seed = order[before < SEED_ROWS]
                    if second:
                        reach = (norm[i] + largest - bound[i] ** 2) / 2 + slack + 1e-9 * norm[i]
                        kth = b["kth"].iloc[i]
                        visit = np.setdiff1d(np.arange(len(order)) if kth is None or np.isnan(kth) else np.flatnonzero(reach >= kth), seed)
                    else:
                        visit = seed
                    for r in visit:
                        for c in range(chunks[int(near_pivot[r]), int(ring_no[r])]):
                            for name, value in zip(out, (b["query_id"].iloc[i], b["q"].iloc[i], b["qk"].iloc[i], b["grp"].iloc[i], near_pivot[r], ring_no[r], c)):
                                out[name].append(value)
            yield pd.DataFrame({**out, "q": pd.Series(out["q"], dtype=object)})

    plan = "query_id bigint, q array<bigint>, qk bigint, grp int, pivot int, ring int, chunk int"
    key = ["pivot", "ring", "chunk", "grp"]

    def score(round_no: int, asking: DataFrame) -> DataFrame:
        visits = shared_table(asking.mapInPandas(lambda it: expand(it, round_no == 2), plan), f"visits{round_no}")
        # a chunk goes to the groups that visit it, and to no other
        wanted = blocks.join(visits.select("pivot", "ring", "chunk", F.col("grp").alias("to")).distinct(), ["pivot", "ring", "chunk"])
        return visits.groupBy(*key).cogroup(wanted.groupBy("pivot", "ring", "chunk", "to")).applyInPandas(_evaluate(k, dim), _FOUND)

    first = shared_table(_best(score(1, asked), k), "round1")
    kth = first.where(F.col("rank") == k).select("query_id", "qk", F.col("score").cast("double").alias("kth"))
    rest = score(2, asked.join(kth, ["query_id", "qk"], "left").select("query_id", "q", "qk", "grp", "kth"))
    return _best(first.drop("rank").unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
