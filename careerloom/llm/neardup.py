"""Near-duplicate classes by DartMinHash signatures and a banded join.

Words are lower-cased runs of letters and digits; a document is the multiset of its
five-word shingles, a shingle's weight the number of times it occurs; documents of
weighted Jaccard similarity (sum of the lesser weights over the sum of the greater
ones) 0.8 or more are linked, and a class is a connected component of links.

1. Texts with equal word sequences collapse into one node (map-side combined).
2. Weighted DartMinHash signatures, cut into 24 bands of 5 coordinates: two documents
   at 0.8 share a band with probability 0.9999.
3. Within a band's bucket every member is paired with the bucket's hub, the member
   that shares most buckets with others, and not with every other member.  Pairs whose
   signatures agree in too few coordinates to be at 0.8 (more than five standard
   deviations away, less than one such pair in ten million) are dropped; all others are
   verified with exact similarities of their shingle multisets.  A hub of many pairs is
   salted over BUSY pairs at a time, so no task builds all of them.
4. Buckets whose members the verified links leave in different classes go through an
   exact prefix-filter join: two sets at 0.8 share one of the rarest fifth of their
   shingles (the n-th occurrence of a shingle counts as an element), so only nodes of
   different classes that do are compared.  Members of a bucket that are linked end in
   one class, although a bucket of n copies costs n pairs.

Defined results: null, empty or blank text is a class of its own; a text of symbols
only is in a class with its exact copies; a text of fewer than five words is one shingle; the class id is the
smallest doc_id of the class (null only if all are null); repeated rows share a
class; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from careerloom.llm import dartminhash
from careerloom.llm.components import connected_components
from careerloom.llm.shared import bound_batches, hidden, let, shared_table

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Buckets up to this size are compared in full at once.
SMALL_BUCKET = 4
#: Pairs of one node that a task joins at most, about.
BUSY = 512
#: Coordinates of 120 that two signatures must share: 0.6, where 0.8 has a deviation of 0.037.
LEAST_AGREEING = int(0.6 * BANDS * ROWS)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _node(text: Column, words: Column) -> Column:
    """16 bytes that stand for the text's words, or for the text itself where it has symbols only; null for blank text."""
    marked = F.when(F.size(words) > 0, F.array_join(words, " ")).when(F.translate(text, " \t\n\x0b\f\r", "") != "", F.concat(F.lit("\0"), text))
    return F.unhex(F.md5(marked.cast("binary")))


def _node_of(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    return let(words_of(body), lambda w: _node(body, w))


_SKETCH = T.StructType([T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])


@pandas_udf(_SKETCH)
def _sketch(words: pd.Series) -> pd.DataFrame:
    """Band hashes, and 16 bits of each coordinate."""
    bands, sigs = np.empty(len(words), object), np.empty(len(words), object)
    some = [i for i, w in enumerate(words) if w is not None and len(w)]
    for at in range(0, len(some), 256):
        part = some[at : at + 256]
        elements, weights = zip(*[np.unique(dartminhash.shingles(words.iloc[i], SHINGLE), return_counts=True) for i in part])
        sig = dartminhash.signatures(elements, BANDS * ROWS, weights)
        short = (sig & np.uint64(0xFFFF)).astype("<u2")
        for i, b, x in zip(part, dartminhash.bands(sig, BANDS), short):
            bands[i], sigs[i] = b, x.tobytes()
    return pd.DataFrame({"bands": bands, "sig": sigs})


@pandas_udf(T.IntegerType())
def _agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(v), "<u2").reshape(len(v), -1) for v in (a, b))
    return pd.Series((x == y).sum(1).astype("int32"))


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    x, y = dartminhash.shingles(a, SHINGLE), dartminhash.shingles(b, SHINGLE)
    (u, cu), (v, cv) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    both = int(np.minimum(cu[i], cv[j]).sum())
    return both / (len(x) + len(y) - both)


@pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_jaccard(x, y) for x, y in zip(a, b)], dtype="float64")


def _beside(pairs: DataFrame, table: DataFrame, key: str, other: str, value: str) -> DataFrame:
    """``pairs`` with column ``value`` of ``table`` (node, value) for node ``key``, named value + key.

    A node of more than BUSY pairs is dealt over several keys and its row repeated for each.
    """
    busy = pairs.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BUSY).cast("int").alias("_parts")).where("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    left = pairs.join(busy, key, "left").withColumn("_salt", F.pmod(F.xxhash64(other), parts).cast("int")).drop("_parts")
    named = table.select(F.col("node").alias(key), F.col(value).alias(value + key))
    right = named.join(busy, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) those at or above the similarity."""
    signed = _beside(_beside(pairs, nodes, "a", "b", "sig"), nodes, "b", "a", "sig")
    near = shared_table(signed.where(_agreeing("siga", "sigb") >= LEAST_AGREEING).select("a", "b"), "near")
    joined = _beside(_beside(near, texts, "a", "b", "text"), texts, "b", "a", "text")
    scored = joined.select("a", "b", _similarity(_hashes(words_of(F.col("texta"))), _hashes(words_of(F.col("textb")))).alias("s"))
    return scored.where(F.col("s") >= SIMILARITY).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()


def _hub_pairs(members: DataFrame) -> DataFrame:
    """Each bucket's members with the bucket's hub, the most central of them."""
    weight = members.groupBy("node").agg(F.sum("n").alias("w"))
    ranked = members.join(weight, "node")
    hubs = ranked.groupBy("band", "h").agg(F.max_by("node", F.struct("w", "node")).alias("x"))
    return ranked.select("band", "h", F.col("node").alias("y")).join(hubs, ["band", "h"]).select("x", "y")


@pandas_udf(T.ArrayType(T.LongType()))
def _elements(words: pd.Series) -> pd.Series:
    """The n-th occurrence of each shingle as a hash: sets of these have the multisets' similarity."""
    out = []
    for w in words:
        x = np.sort(dartminhash.shingles(w, SHINGLE))
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        nth = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
        out.append((x ^ dartminhash.mix(nth.astype(np.uint64))).view(np.int64))
    return pd.Series(out, dtype=object)


def _prefix_pairs(placed: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of a bucket's nodes in different classes that share a shingle of both nodes' prefixes.

    A prefix is the rarest floor(0.2 n) + 1 of a node's n shingles, in one order for
    all nodes; two sets at 0.8 must share one.  At their first shared shingle, places
    i and j, no more than min(n - i, m - j) can be shared, and 0.8 needs
    0.8 / 1.8 (n + m); near copies with too many own shingles fail here.
    """
    roots = placed.select("node", "root").distinct()
    cut = shared_table(texts.join(roots, "node").select("node", "root", F.explode(_elements(_hashes(words_of(F.col("text"))))).alias("g")), "shingles")
    df = cut.groupBy("g").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    # a shingle of one class stays in the order but cannot join two classes
    ranked = cut.join(df, "g").groupBy("node", "root").agg(F.sort_array(F.collect_list(F.struct("df", "g", (F.col("lo") != F.col("hi")).alias("apart")))).alias("x"))
    keep = (F.floor(F.size("x") * (1 - SIMILARITY) + 1e-9) + 1).cast("int")
    prefix = ranked.select("node", "root", F.size("x").alias("n"), F.posexplode(F.slice("x", F.lit(1), keep)).alias("i", "p")).where("p.apart").select("node", "root", "n", "i", "p.g")
    prefix = shared_table(prefix.join(nodes.select("node", "bands"), "node"), "prefix")
    pair = (F.col("l.g") == F.col("r.g")) & (F.col("l.root") < F.col("r.root")) & (F.least(F.col("l.n") - F.col("l.i"), F.col("r.n") - F.col("r.i")) >= SIMILARITY / (1 + SIMILARITY) * (F.col("l.n") + F.col("r.n")) - 1e-6) & F.arrays_overlap("l.bands", "r.bands")
    return prefix.alias("l").join(prefix.alias("r"), pair).select(F.col("l.node").alias("x"), F.col("r.node").alias("y"))


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one class, with their class so far."""
    found = members.select("band", "h", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = found.groupBy("band", "h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band", "h")
    return shared_table(found.join(mixed, ["band", "h"]), "mixed")


def _links(members: DataFrame, nodes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links between nodes, enough to connect every class, and each linked node's root."""
    small, large = members.where(F.col("n") <= SMALL_BUCKET), members.where(F.col("n") > SMALL_BUCKET)
    close = small.select("band", "h", F.col("node").alias("x")).join(small.select("band", "h", F.col("node").alias("y")), ["band", "h"]).where("x < y").select("x", "y")
    tried = shared_table(_ordered(close.union(_hub_pairs(large))), "pairs")
    links = shared_table(_verified(tried, nodes, texts), "links")
    roots = connected_components(links)
    mixed = _mixed(large, roots)
    if not mixed.isEmpty():
        fresh = _ordered(_prefix_pairs(mixed, nodes, texts)).join(tried, ["a", "b"], "left_anti")
        more = shared_table(_verified(shared_table(fresh, "pairs"), nodes, texts), "links")
        if not more.isEmpty():
            links = links.union(more)
            roots = connected_components(links)
    return links, roots


def classes(df: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``df``: doc_id, node (of equal word sequences), class_id, class_size, n_links.

    n_links counts the verified links of the row's node that were needed.
    """
    bound_batches(df.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    cut = df.select(F.col(doc).alias("doc_id"), F.xxhash64(body).alias("raw"), let(words_of(body), lambda w: F.struct(_node(body, w).alias("node"), _hashes(w).alias("hashes"))).alias("x"))
    rows = shared_table(cut.select("doc_id", "raw", "x.node", _sketch("x.hashes").alias("k")).select("doc_id", "raw", "node", "k.bands", "k.sig"), "signatures")
    found = rows.where(F.col("node").isNotNull()).groupBy("node")
    # the text comes from a row of the smallest doc_id, known by its hash: equal or null ids meet only their own text
    nodes = shared_table(found.agg(F.min("doc_id").alias("first"), F.min_by("raw", F.struct(F.col("doc_id").isNull(), "doc_id", "raw")).alias("raw"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig")), "nodes")
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    shared = buckets.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = shared_table(buckets.join(shared, ["band", "h"]), "members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("first").alias("doc_id"), "raw")
    texts = (
        df.select(F.col(doc).alias("_doc"), F.xxhash64(body).alias("_raw"), body.alias("text"))
        .join(wanted, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_raw") == F.col("raw")))
        # written so that it stays a filter: an equality of the two would become a join key, computed for every text
        .where(F.array_contains(F.array(_node_of(F.col("text"))), F.col("node")))
        .dropDuplicates(["node"])
        .select("node", "text")
    )
    links, roots = _links(members, nodes.select("node", "sig", "bands"), shared_table(texts, "texts"))
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n_links"))
    placed = nodes.select("node", "first", "copies").join(roots, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = shared_table(placed.select("node", "root", "first", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "placed")
    whole = placed.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"), F.min_by("node", F.struct(F.col("first").isNull(), "first", "node")).alias("head"))
    named = placed.join(whole, "root").select("node", "class_id", "class_size", "n_links", (F.col("node") == F.col("head")).alias("is_head"))
    return (
        rows.select("doc_id", "node")
        .join(named, "node", "left")
        .select(
            "doc_id", "node", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("is_head", F.lit(True)).alias("is_head"),
        )
    )


def keep_one(df: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each class: the first row of the class's smallest doc_id."""
    node, own, first, times = (hidden(df, n) for n in ("_node", "_own", "_first", "_times"))
    heads = classes(df, doc=doc, text=text).where(F.col("node").isNotNull() & F.col("is_head") & F.col("doc_id").eqNullSafe(F.col("class_id")))
    wanted = heads.groupBy(F.col("node").alias(own)).agg(F.min("doc_id").alias(first), F.count(F.lit(1)).alias(times))
    marked = df.withColumn(node, _node_of(F.col(text)))
    blank = marked.where(F.col(node).isNull())
    chosen = marked.join(wanted, (F.col(node) == F.col(own)) & F.col(doc).eqNullSafe(F.col(first)))
    once = chosen.where(F.col(times) == 1).select(*df.columns)
    repeated = chosen.where(F.col(times) > 1).dropDuplicates([node]).select(*df.columns)
    return once.unionByName(repeated).unionByName(blank.select(*df.columns))
