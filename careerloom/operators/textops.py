"""Text extraction (X1-X6, X8-X11) and lookups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerloom.functions.columns import canonical_key, cosine, overlap, singular, token_set, tokens
from careerloom.operators.ordered import beside, bound_batches, dense_ids, materialised


def label_space(tags: DataFrame, doc: str, label: str, *, docs: DataFrame | None = None, least_df: int = 50, low: int = 2, high: int = 60) -> DataFrame:
    """Cleaned labels of known documents with their document frequency and id in sorted order."""
    clean = tags.select(doc, F.lower(F.trim(label)).alias("label")).where(F.length("label").between(low, high))
    if docs is not None:
        clean = clean.join(docs.select(doc).distinct(), doc, "left_semi")
    df = clean.groupBy("label").agg(F.count_distinct(doc).alias("doc_freq")).where(F.col("doc_freq") >= least_df)
    return df.join(dense_ids(df, "label", "label_id"), "label")


def ngrams(words: Column, sizes: Sequence[int]) -> Column:
    """Distinct word n-grams of the given sizes."""
    def of(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


#: Phrases that are put beside every text, and terms that are broadcast; more go through a shuffle.
FEW_PHRASES, FEW_TERMS = 10_000, 1_000_000

#: Fitted labels whose weights go to every worker.
FEW_LABELS = 1000


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def _gram_hashes(words: Column, n: int) -> Column:
    """64 bits of every run of n words."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(n)]))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<bigint>"))


def gazetteer(docs: DataFrame, vocab: DataFrame, doc: str, text: str, phrase: str, *, sizes: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """(doc, phrase) where the phrase occurs as whole words, by 64-bit hashes of word n-grams.

    A vocabulary of at most FEW_PHRASES is intersected with each text's n-grams in
    place, so only hits leave the scan; a larger one is an equi-join on the hash.
    """
    spelled = vocab.select(phrase, tokens(F.col(phrase)).alias("_v")).where(F.size("_v").isin(list(sizes)))
    key = F.coalesce(*[F.when(F.size("_v") == n, F.xxhash64(*[F.get("_v", F.lit(j)) for j in range(n)])) for n in sizes])
    keys = spelled.select(phrase, key.alias("_g"))
    grams = docs.select(doc, _bind(tokens(F.col(text)), lambda w: F.array_distinct(F.concat(*[_gram_hashes(w, n) for n in sizes]))).alias("_h"))
    if keys.count() > FEW_PHRASES:
        return grams.select(doc, F.explode("_h").alias("_g")).join(keys, "_g").select(doc, phrase).distinct()
    every = keys.agg(F.collect_set("_g").alias("_all"))
    hits = grams.crossJoin(F.broadcast(every)).select(doc, F.explode(F.array_intersect("_h", "_all")).alias("_g"))
    return hits.join(F.broadcast(keys), "_g").select(doc, phrase).distinct()


def _counted(sorted_hashes: Column) -> Column:
    """struct(term, tf) of each distinct value of a sorted array."""
    def runs(x: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i - 1) != F.get(x, i)))
        cells = lambda at: F.transform(at, lambda p, i: F.struct(F.get(x, p).alias("term"), (F.coalesce(F.get(at, i + 1), F.size(x)) - p).alias("tf")))
        return F.when(F.size(x) > 0, _bind(first, cells)).otherwise(F.array().cast("array<struct<term:bigint,tf:int>>"))

    return _bind(sorted_hashes, runs)


def tfidf(docs: DataFrame, doc: str, text: str, *, least_df: int = 5, sizes: Sequence[int] = (1, 2)) -> DataFrame:
    """(doc, term, weight): sublinear tf, idf = ln((1 + n) / (1 + df)) + 1, unit length rows.

    A term is the 64-bit hash of its words.  Terms are counted inside each text, so what
    is shuffled is a hash for each term of a text, for the document frequencies, and the
    weights once, for the lengths.
    """
    return _weights(_term_counts(docs, doc, text, sizes), doc, least_df)


def _term_counts(docs: DataFrame, doc: str, text: str, sizes: Sequence[int]) -> DataFrame:
    counts = docs.select(doc, _bind(tokens(F.col(text), r"[a-z0-9]{2,}"), lambda w: _counted(F.sort_array(F.concat(*[_gram_hashes(w, n) for n in sizes])))).alias("_t"))
    return materialised(counts, "terms")


def _frequencies(rows: DataFrame, doc: str, least_df: int) -> DataFrame:
    return rows.select(doc, F.inline("_t")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least_df)


def _weights(rows: DataFrame, doc: str, least_df: int) -> DataFrame:
    tf = rows.select(doc, F.inline("_t"))
    total = rows.agg(F.count(F.lit(1)).alias("n_docs"))
    df = _frequencies(rows, doc, least_df)
    known = F.broadcast(df) if df.count() <= FEW_TERMS else df
    weight = ((1 + F.ln("tf")) * (F.ln((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1)).alias("w")
    raw = tf.join(known, "term").crossJoin(F.broadcast(total)).select(doc, F.struct("term", weight).alias("_x"))
    whole = raw.groupBy(doc).agg(F.collect_list("_x").alias("_x")).withColumn("_l", F.sqrt(F.aggregate("_x", F.lit(0.0), lambda n, x: n + x["w"] * x["w"])))
    return whole.select(doc, "_l", F.inline("_x")).select(doc, "term", (F.col("w") / F.col("_l")).alias("weight"))


def hashed_rows(features: DataFrame, doc: str, dims: int) -> DataFrame:
    """(doc, i, w): each document's hashed columns and weights as two arrays, which a worker reads without an object for each cell."""
    bound_batches(features.sparkSession)
    cells = F.struct(F.pmod(F.xxhash64("term"), F.lit(dims)).cast("int").alias("i"), F.col("weight").alias("w"))
    rows = features.groupBy(doc).agg(F.collect_list(cells).alias("x"))
    return rows.select(doc, F.col("x.i").alias("i"), F.col("x.w").alias("w"))


def tfidf_rows(docs: DataFrame, doc: str, text: str, *, dims: int = 1024, least_df: int = 5, sizes: Sequence[int] = (1, 2)) -> DataFrame:
    """``hashed_rows`` of ``tfidf``, weighted where the texts lie.

    Up to FEW_TERMS known terms go to the workers as sorted arrays, so no cell is
    shuffled; more of them, or a document in several rows, take the joins of ``tfidf``.
    """
    rows = _term_counts(docs, doc, text, sizes)
    df = materialised(_frequencies(rows, doc, least_df).select("term", "df", F.pmod(F.xxhash64("term"), F.lit(dims)).cast("int").alias("i")), "frequencies")
    if df.count() > FEW_TERMS or not rows.groupBy(doc).count().where("count > 1").isEmpty():
        return hashed_rows(_weights(rows, doc, least_df), doc, dims)
    bound_batches(rows.sparkSession)
    n_docs, known = rows.count(), df.orderBy("term").toArrow()  # FEW_TERMS rows at most
    term, column = known.column("term").to_numpy(), known.column("i").to_numpy()
    idf = np.log((1.0 + n_docs) / (1.0 + known.column("df").to_numpy())) + 1

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, tf = b.column("term"), b.column("tf").flatten().to_numpy()
            row, cells = np.repeat(np.arange(b.num_rows), pc.list_value_length(found).fill_null(0).to_numpy(zero_copy_only=False)), found.flatten().to_numpy()
            at = np.minimum(np.searchsorted(term, cells), max(0, len(term) - 1))
            hit = term[at] == cells if len(term) else np.zeros(len(cells), bool)
            row, at = row[hit], at[hit]
            w = (1 + np.log(tf[hit])) * idf[at]
            w /= np.sqrt(np.bincount(row, weights=w * w, minlength=b.num_rows))[row]
            size = np.bincount(row, minlength=b.num_rows)
            some = size > 0
            ends = pa.array(np.append(0, np.cumsum(size[some])), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(doc).filter(pa.array(some)), pa.ListArray.from_arrays(ends, pa.array(column[at], pa.int32())), pa.ListArray.from_arrays(ends, pa.array(w, pa.float64()))], names=[doc, "i", "w"])

    kind = dict(rows.dtypes)[doc]
    return rows.select(doc, F.col("_t.term").alias("term"), F.col("_t.tf").alias("tf")).mapInArrow(weigh, f"{doc} {kind}, i array<int>, w array<double>")


def _rows(features: DataFrame, doc: str, dims: int) -> DataFrame:
    """Hashed rows of features (doc, term, weight), or the rows themselves where they are hashed."""
    return features if {"i", "w"} <= set(features.columns) else hashed_rows(features, doc, dims)


def _dense(i: pa.ListArray, w: pa.ListArray, dims: int) -> np.ndarray:
    """A row of ``dims`` numbers for each document; weights of one column add up."""
    row = np.repeat(np.arange(len(i)), np.diff(i.offsets.to_numpy()))
    at = row * dims + i.flatten().to_numpy()
    return np.bincount(at, weights=w.flatten().to_numpy(), minlength=len(i) * dims).reshape(len(i), dims)


#: Documents of one shard of a fit; a shard's weighted rows are one row for a worker.
SHARD_DOCS = 4096


def ovr_linear(features: DataFrame, labels: DataFrame, doc: str, *, dims: int = 1024, epochs: int = 5, alpha: float = 1e-5, n_docs: int | None = None) -> DataFrame:
    """One-versus-rest linear hinge with balanced weights: (label, bias, w) over hashed terms.

    Every document of ``features`` (``n_docs``, counted if not given) is taken for or against every label.  Documents are
    dealt by hash into shards; in each epoch a shard steps through all its documents from the common weights, and
    the shards' weights are averaged by their documents, so no task reads all documents.  One shard is plain
    stochastic descent.
    """
    rows = _rows(features, doc, dims)
    spark = rows.sparkSession
    known = labels.select(doc, F.col("label").cast("string").alias("label")).where(F.col("label").isNotNull()).distinct()
    names = [r["label"] for r in known.select("label").distinct().orderBy("label").collect()]
    packed = _shards(rows, known.join(spark.createDataFrame(list(enumerate(names)), "y int, label string"), "label"), doc, dims, rows.count() if n_docs is None else n_docs)
    total = packed.agg(F.sum("n")).first()[0] or 0
    have = dict(packed.select(F.explode("label").alias("y")).groupBy("y").count().collect())
    positives = np.array([have.get(y, 0) for y in range(len(names))], float)
    share = total / (2 * np.maximum(1, positives)), total / (2 * np.maximum(1, total - positives))
    bias, w = np.zeros(len(names)), np.zeros((dims, len(names)))
    for first in range(0, len(names), FEW_LABELS):
        block = slice(first, min(first + FEW_LABELS, len(names)))
        for epoch in range(epochs if total else 0):
            steps = _steps(epoch, alpha, first, share[0][block], share[1][block], bias[block].copy(), w[:, block].copy())
            parts = packed.mapInArrow(steps, "y int, shard int, n bigint, bias double, w binary")
            for y, b, own in parts.groupBy("y").applyInPandas(_averaged, "y int, bias double, w binary").collect():  # FEW_LABELS rows at most
                bias[y], w[:, y] = b, np.frombuffer(bytes(own))
    fitted = {"label": pa.array(names, pa.string()), "bias": pa.array(bias), "w": pa.array(w.T.tolist(), pa.list_(pa.float64()))}
    return spark.createDataFrame(pa.table(fitted))


def _shards(rows: DataFrame, tags: DataFrame, doc: str, dims: int, n_docs: int) -> DataFrame:
    """A row for each shard: its documents in hash order, their columns and weights end to end, and the places and ids of their labels."""
    shard = F.pmod(F.xxhash64(doc, F.lit("shard")), F.lit(max(1, -(-n_docs // SHARD_DOCS)))).cast("int").alias("shard")

    def pack(key, own: pa.Table, named: pa.Table) -> pa.Table:
        own = own.sort_by([("_h", "ascending"), ("_of", "ascending")]).combine_chunks()
        i, w = own.column("i").combine_chunks(), own.column("w").combine_chunks()
        n = own.num_rows
        cell = np.repeat(np.arange(n), pc.list_value_length(i).to_numpy()) * dims + i.flatten().to_numpy()
        cell, at = np.unique(cell, return_inverse=True)  # weights of one column add up
        place = pc.index_in(named.column("_doc"), value_set=own.column("_of")).to_numpy()
        hit = ~np.isnan(place.astype(float))
        out = {
            "shard": [key[0].as_py()], "n": [n], "size": [np.bincount(cell // dims, minlength=n)], "i": [cell % dims], "w": [np.bincount(at, weights=w.flatten().to_numpy(), minlength=len(cell))],
            "place": [place[hit].astype(np.int64)], "label": [named.column("y").to_numpy()[hit]],
        }
        return pa.table(out, schema=kind).slice(0, min(1, n))

    kind = pa.schema([("shard", pa.int32()), ("n", pa.int64()), *[(c, pa.list_(pa.int32())) for c in ("size", "i")], ("w", pa.list_(pa.float64())), *[(c, pa.list_(pa.int32())) for c in ("place", "label")]])
    left, right = rows.select(shard, F.xxhash64(doc).alias("_h"), F.col(doc).alias("_of"), "i", "w"), tags.select(shard, F.col(doc).alias("_doc"), "y")
    schema = "shard int, n bigint, size array<int>, i array<int>, w array<double>, place array<int>, label array<int>"
    return materialised(left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(pack, schema), "shards")


def _steps(epoch: int, alpha: float, first: int, up: np.ndarray, down: np.ndarray, bias: np.ndarray, w: np.ndarray):
    """One epoch of hinge steps of every shard from common weights, for all labels at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                size, i, v, place, label = (b.column(c)[r].values.to_numpy() for c in ("size", "i", "w", "place", "label"))
                n, ends = len(size), np.append(0, np.cumsum(size)).tolist()
                mine = (label >= first) & (label < first + len(bias))
                y = np.full((n, len(bias)), -1.0)
                y[place[mine], label[mine] - first] = 1
                pull = y * np.where(y > 0, up, down)
                own, own_bias, scale, t = w.copy(), bias.copy(), 1.0, epoch * n
                rng = np.random.Generator(np.random.PCG64(42))
                for _ in range(epoch):
                    rng.permutation(n)
                for d in rng.permutation(n).tolist():
                    t += 1
                    eta = 1 / (1 + alpha * 1e3 * t) * 0.1
                    scale *= 1 - eta * alpha
                    at, x = i[ends[d] : ends[d + 1]], v[ends[d] : ends[d + 1]]
                    some = own[at]
                    miss = y[d] * (x @ some * scale + own_bias) < 1
                    if miss.any():
                        g = eta * pull[d] * miss
                        own[at] = some + x[:, None] * (g / scale)
                        own_bias += g
                labels = np.arange(first, first + len(bias))
                columns = [pa.array(labels, pa.int32()), pa.array(np.full(len(bias), b.column("shard")[r].as_py()), pa.int32()), pa.array(np.full(len(bias), n), pa.int64()), pa.array(own_bias), pa.array([x.tobytes() for x in (own * scale).T], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["y", "shard", "n", "bias", "w"])

    return run


def _averaged(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """A label's weights: the mean of its shards', in their order, by their documents."""
    total, bias, n = 0.0, 0.0, pdf["n"].sum()
    for m, b, w in pdf.sort_values("shard")[["n", "bias", "w"]].itertuples(index=False):
        total, bias = total + np.frombuffer(w) * (m / n), bias + b * (m / n)
    return pd.DataFrame({"y": [key[0]], "bias": [bias], "w": [total.tobytes()]})


def linear_scores(features: DataFrame, model: DataFrame, doc: str, dims: int = 1024) -> DataFrame:
    """(doc, label, score) of the fitted labels; hashed rows meet up to FEW_LABELS labels where they lie."""
    if {"i", "w"} <= set(features.columns):
        fitted = model.limit(FEW_LABELS + 1).collect()
        if len(fitted) <= FEW_LABELS:
            return _scores_in_place(features, fitted, doc, dims)
        hashed = features.select(doc, F.inline(F.arrays_zip("i", "w"))).withColumnRenamed("w", "weight")
    else:
        hashed = features.select(doc, F.pmod(F.xxhash64("term"), F.lit(dims)).cast("int").alias("i"), "weight")
    cells = model.select("label", "bias", F.posexplode("w").alias("i", "w")).where("w <> 0")
    biases = model.select("label", "bias")
    sums = hashed.join(cells.select("label", "i", "w"), "i").groupBy(doc, "label").agg(F.sum(F.col("weight") * F.col("w")).alias("s"))
    return sums.join(F.broadcast(biases), "label").select(doc, "label", (F.col("s") + F.col("bias")).alias("score"))


def _scores_in_place(rows: DataFrame, fitted: Sequence, doc: str, dims: int) -> DataFrame:
    names = np.array([m["label"] for m in fitted], object)
    bias, w = np.array([m["bias"] for m in fitted], float), np.array([m["w"] for m in fitted], float).reshape(len(fitted), dims).T

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = _dense(part.column("i"), part.column("w"), dims)
                d, k = np.nonzero((x != 0).astype(float) @ (w != 0))  # a document and a label that share a column
                yield pa.RecordBatch.from_arrays([part.column(doc).take(pa.array(d)), pa.array(names[k], pa.string()), pa.array((x @ w + bias)[d, k])], names=[doc, "label", "score"])

    return rows.mapInArrow(score, f"{doc} {dict(rows.dtypes)[doc]}, label string, score double")


def hybrid(candidates: DataFrame, scores: DataFrame, thresholds: DataFrame, doc: str) -> DataFrame:
    """Gazetteer candidates whose linear score passes the label's threshold."""
    return candidates.join(scores, [doc, "label"]).join(thresholds, "label").where(F.col("score") > F.col("threshold")).select(doc, "label")


def random_projection(features: DataFrame, doc: str, dims: int = 64) -> DataFrame:
    """Dense rows by a hashed sign projection of TF-IDF (in place of a truncated SVD), unit length."""
    sign = lambda d: F.when(F.pmod(F.xxhash64("term", F.lit(d)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    sums = features.groupBy(doc).agg(F.array(*[F.sum(F.col("weight") * sign(d)) for d in range(dims)]).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return sums.withColumn("_l", length).select(doc, F.when(F.col("_l") > 0, F.transform("v", lambda x: x / F.col("_l"))).otherwise(F.col("v")).alias("v"))


def svd_embedding(features: DataFrame, doc: str, *, dims: int = 1024, k: int = 192) -> DataFrame:
    """Unit rows in the space of the k largest singular vectors of the hashed TF-IDF matrix.

    The Gram matrix of ``dims`` columns is summed over partitions, so its size is fixed; its
    eigenvectors are the right singular vectors, and rows are projected where they lie.
    """
    rows = _rows(features, doc, dims)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = _dense(part.column("i"), part.column("w"), dims)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"row": pa.array(np.arange(dims), pa.int32()), "g": pa.array([r.tobytes() for r in total], pa.binary())})

    def summed(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(dims)
        for g in pdf["g"]:
            total += np.frombuffer(g)
        return pd.DataFrame({"row": [key[0]], "g": [total.tobytes()]})

    parts = rows.select("i", "w").mapInArrow(gram, "row int, g binary")
    whole = np.zeros((dims, dims))
    for row, g in parts.groupBy("row").applyInPandas(summed, "row int, g binary").collect():  # dims rows of dims numbers
        whole[row] = np.frombuffer(bytes(g))
    value, vector = np.linalg.eigh((whole + whole.T) / 2)
    keep = np.argsort(-value, kind="stable")[:k]
    basis = vector[:, keep] * np.sign(vector[np.abs(vector[:, keep]).argmax(0), keep])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                v = _dense(part.column("i"), part.column("w"), dims) @ basis
                length = np.linalg.norm(v, axis=1, keepdims=True)
                unit = (v / np.where(length > 0, length, 1)).ravel()
                ends = pa.array(np.arange(part.num_rows + 1) * basis.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(doc), pa.ListArray.from_arrays(ends, pa.array(unit))], names=[doc, "v"])

    kind = dict(features.dtypes)[doc]
    return rows.mapInArrow(project, f"{doc} {kind}, v array<double>")


def best_sentence(sentences: DataFrame, skills: DataFrame, doc: str) -> DataFrame:
    """The largest cosine of any of a document's sentences with each skill's vector."""
    s = skills.select("skill", F.col("v").alias("sv"))
    return sentences.crossJoin(beside(s)).groupBy(doc, "skill").agg(F.max(cosine(F.col("v"), F.col("sv"))).alias("score"))


def bridge(skills: DataFrame, names: DataFrame, *, lexical: float = 0.8, semantic: float = 0.55) -> DataFrame:
    """Each skill's descriptor by token overlap with the names, else by cosine of the vectors.

    ``skills``: (skill, doc_freq, v); ``names``: (descriptor_id, name, v), a dimension.
    """
    s = skills.select("skill", "doc_freq", F.col("v").alias("sv"), token_set(F.col("skill")).alias("st"))
    n = names.select("descriptor_id", "name", F.col("v").alias("nv"), token_set(F.col("name")).alias("nt"))
    pairs = s.crossJoin(beside(n)).select("skill", "doc_freq", "descriptor_id", "name", overlap(F.col("st"), F.col("nt")).alias("lex"), cosine(F.col("sv"), F.col("nv")).alias("cos"))
    pick = lambda m: F.min(F.struct((-F.col(m)).alias("a"), F.col("descriptor_id").alias("id"), F.col("name").alias("name")))
    best = pairs.groupBy("skill", "doc_freq").agg(pick("lex").alias("l"), pick("cos").alias("c"))
    by_name, by_text = -F.col("l.a") >= lexical, -F.col("c.a") >= semantic
    return best.select(
        "skill", "doc_freq", F.when(by_name, F.col("l.id")).otherwise(F.col("c.id")).alias("descriptor_id"), F.when(by_name, F.col("l.name")).otherwise(F.col("c.name")).alias("descriptor_name"),
        (-F.col("c.a")).alias("cosine"), F.when(by_name, "lexical").when(by_text, "semantic").otherwise("none").alias("match_type"), (by_name | by_text).alias("mapped"),
    )


def emerging(bridged: DataFrame) -> DataFrame:
    """Unmapped skills by demand."""
    return bridged.where(~F.col("mapped")).orderBy(F.desc("doc_freq"), "skill")


def handoff(predictions: DataFrame, bridged: DataFrame, doc: str) -> DataFrame:
    """X11, M7: posting, skill and descriptor of the mapped skills."""
    return predictions.join(bridged.where("mapped").select(F.lower("skill").alias("label"), "descriptor_id"), "label").select(doc, "label", "descriptor_id")


def normalise_to_vocab(raw: DataFrame, vocab: DataFrame, text: str, label: str) -> DataFrame:
    """F16: exact, canonical key, without a trailing ' skills', with one; the first route that hits."""
    v = vocab.select(F.col(label).alias("_v"), canonical_key(F.col(label)).alias("_vk"))
    by_key = v.groupBy("_vk").agg(F.min("_v").alias("_k"))
    exact = lambda name: v.select(F.col("_v").alias(name), F.col("_v").alias(f"_hit{name}")).distinct()
    low = F.lower(F.trim(text))
    out = raw.withColumns({"_a": low, "_key": canonical_key(low), "_less": F.regexp_replace(low, " skills$", ""), "_more": F.concat(low, F.lit(" skills"))})
    out = out.join(exact("_a"), "_a", "left").join(by_key.withColumnRenamed("_vk", "_key"), "_key", "left").join(exact("_less"), "_less", "left").join(exact("_more"), "_more", "left")
    return out.withColumn("mapped", F.coalesce("_hit_a", "_k", "_hit_less", "_hit_more")).select(*raw.columns, "mapped")


def lookup(names: DataFrame, code: str, name: str, text: str, *, cutoff: float = 0.5, k: int = 5) -> DataFrame:
    """digits are a code; else an exact name, else a substring, else fuzzy hits: (code, name, route, score).

    The first route with a hit wins.  Fuzzy scores are difflib ratios, in an Arrow batch over names.
    """
    import difflib

    q = text.strip().lower()
    if q.isdigit():
        return names.where(F.col(code) == q.zfill(5)).select(code, name, F.lit("code").alias("route"), F.lit(1.0).alias("score"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"c": b[code], "n": b[name], "score": [difflib.SequenceMatcher(None, q, x.lower()).ratio() for x in b[name]]})

    low = F.lower(F.col(name))
    direct = names.select(code, name, F.when(low == q, 1).when(low.contains(q), 2).alias("prio"), F.lit(1.0).alias("score")).where("prio is not null")
    fuzzy = names.select(code, name).where(F.col(name).isNotNull()).mapInPandas(score, f"c {dict(names.dtypes)[code]}, n string, score double").where(F.col("score") >= cutoff).select(F.col("c").alias(code), F.col("n").alias(name), F.lit(3).alias("prio"), "score")
    # names are compared letter by letter only where no cheaper route hits
    every = fuzzy if direct.isEmpty() else direct
    first = every.agg(F.min("prio").alias("_p"))
    hits = every.crossJoin(F.broadcast(first)).where("prio = _p").orderBy(F.desc("score"), code).limit(k)
    return hits.select(code, name, F.element_at(F.array(*map(F.lit, ("exact", "substring", "fuzzy"))), F.col("prio")).alias("route"), "score")


def lookup_regex(names: DataFrame, code: str, name: str, text: str) -> DataFrame:
    """an exact code, else names that match the expression; ambiguous where more than one does."""
    hits = names.where((F.col(code) == text) | F.lower(F.col(name)).rlike(text.lower())).withColumn("_exact", F.col(code) == text)
    any_exact = hits.agg(F.coalesce(F.bool_or("_exact"), F.lit(False)).alias("_any"), F.count(F.lit(1)).alias("_n"))
    return hits.crossJoin(F.broadcast(any_exact)).where("_exact or not _any").select(code, name, (~F.col("_any") & (F.col("_n") > 1)).alias("ambiguous"))


def match_unique(items: DataFrame, name: str, queries: DataFrame, query: str) -> DataFrame:
    """exact, else the only prefix hit, else the only substring hit."""
    q, n = F.lower(F.trim(F.col(query))), F.lower(F.col(name))
    pairs = queries.select(query).crossJoin(beside(items.select(name))).where(n.contains(q))
    flags = pairs.groupBy(query).agg(
        F.min(F.when(n == q, F.col(name))).alias("e"), F.min(F.when(n.startswith(q), F.col(name))).alias("p"), F.sum(n.startswith(q).cast("int")).alias("np"), F.min(name).alias("s"), F.count(F.lit(1)).alias("ns")
    )
    return queries.select(query).join(flags, query, "left").select(query, F.coalesce("e", F.when(F.col("np") == 1, F.col("p")), F.when(F.col("ns") == 1, F.col("s"))).alias("match"))


def suggest(names: DataFrame, name: str, text: str, k: int = 5) -> DataFrame:
    """names that hold one of the query's four-letter stems."""
    stems = [w[:4] for w in text.lower().split() if len(w) >= 4]
    hit = F.exists(F.array(*map(F.lit, stems)), lambda s: F.lower(F.col(name)).contains(s)) if stems else F.lit(False)
    return names.where(hit).select(name).orderBy(name).limit(k)


def map_user_skills(raw: DataFrame, text: str, names: DataFrame, bridged: DataFrame) -> DataFrame:
    """a user's words to descriptors: exact name, singular name, else the bridge."""
    low = F.lower(F.trim(text))
    exact = names.select(F.lower("name").alias("_a"), F.col("descriptor_id").alias("_ida"))
    loose = names.select(singular(F.lower("name")).alias("_b"), "descriptor_id").groupBy("_b").agg(F.min("descriptor_id").alias("_idb"))
    known = bridged.where("mapped").select(F.lower("skill").alias("_c"), F.col("descriptor_id").alias("_idc"))
    out = raw.withColumns({"_a": low, "_b": singular(low), "_c": low}).join(exact, "_a", "left").join(loose, "_b", "left").join(known, "_c", "left")
    return out.select(*raw.columns, F.coalesce("_ida", "_idb", "_idc").alias("descriptor_id"))
