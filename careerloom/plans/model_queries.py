"""Learned models over the driver's tables.  SQL cannot express them; tests hold them to bands and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerloom.functions.columns import LANGUAGE_WORDS
from careerloom.operators import factor, learn, metrics, ranking, recommend, relational, splits, textops
from careerloom.operators.ordered import materialised
from careerloom.plans.base import CUTOFF, Registry, postings, ratings
from careerloom.sources.io import scratch, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training and held-out cells, written once: models read them several times."""
    s = materialised(splits.stratified(ratings(spark, sf_dir), ["occ", "item"], "item"), "cells")
    return s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")


def _report(spark, sf_dir, models) -> DataFrame:
    train, test = _cells(spark, sf_dir)
    scores = factor.score_models(train, models)
    out = None
    rows = scores.join(test, ["occ", "item"]).withColumn("rel", (F.col("rating") >= 4).cast("int"))
    for m in models:
        g = ranking.per_group(rows.where(F.col("model") == m), "item", "occ", "score", "rel", "rating")
        one = ranking.report(g).withColumn("model", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def q_mf(spark, sf_dir):
    """Biased factorisation with and without item bias, by descriptor."""
    return _report(spark, sf_dir, ["mf", "mf_no_bi"])


@query()
def q_bpr(spark, sf_dir):
    """R9, R10"""
    return _report(spark, sf_dir, ["bpr_d", "bpr_o"])


@query()
def q_node2vec(spark, sf_dir):
    """R11"""
    train, test = _cells(spark, sf_dir)
    s = factor.score_models(train, ["node2vec"])
    rows = s.join(test, ["occ", "item"]).withColumn("rel", (F.col("rating") >= 4).cast("int"))
    return ranking.report(ranking.per_group(rows, "item", "occ", "score", "rel", "rating"))


@query()
def q_mf_wrappers(spark, sf_dir):
    """The dense wrapper (64 factors) and the positives-only market wrapper (32), both with penalty 0.02."""
    train, test = _cells(spark, sf_dir)
    positive = train.where("rating >= 1")
    parts = []
    for name, cells, k, epochs in (("dense", train, 64, 300), ("market", positive, 32, 200)):
        scores = factor.score_models(cells, ["mf"], k=k, epochs=epochs, reg=0.02)
        rows = test.join(scores, ["occ", "item"]).withColumn("rel", (F.col("rating") >= 4).cast("int"))
        parts.append(ranking.report(ranking.per_group(rows, "occ", "item", "score", "rel", "rating")).withColumn("model", F.lit(name)))
    return parts[0].unionByName(parts[1])


@query()
def q_foldin(spark, sf_dir):
    """Every occupation's profile folded into the factors; ratings of every descriptor."""
    train, _ = _cells(spark, sf_dir)
    model = factor.factors(train)
    profiles = ratings(spark, sf_dir).where("rating >= 3").select(F.col("occ").cast("string").alias("user"), "item", "rating")
    return factor.reconstruct(model, factor.fold_in(model, profiles)).select("user", "item", F.round("rating", 4).alias("rating"))


@query()
def q_lambda_sweep(spark, sf_dir):
    """Test error and P@10 over latent size and penalty."""
    train, test = _cells(spark, sf_dir)
    return factor.sweep(train, test, {"k": [8, 16, 32, 64], "reg": [0.02, 0.1]}).select("params", F.round("rmse", 4).alias("rmse"), F.round("p_10", 4).alias("p_10"))


@query()
def q_ladder(spark, sf_dir):
    """Recall and NDCG of the DataFrame models on the same held-out cells."""
    train, test = _cells(spark, sf_dir)
    out = None
    for name, model in recommend.LADDER.items():
        rows = test.join(model(train, test), ["occ", "item"]).withColumn("rel", (F.col("rating") >= 4).cast("int"))
        one = ranking.report(ranking.per_group(rows, "item", "occ", "score", "rel", "rating")).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


_FEATURES = ["n_chars", "n_words", "n_distinct", "n_lines", "n_symbols", "n_digits", "n_capitals", "word_length", "longest_line", "source_count", "source_chars", "lang_chars"]


def outlook_features(spark, sf_dir) -> DataFrame:
    """The frame of twelve features for the outlook task (quality of documents stands in).

    Written once to the shared folder: every fit reads it again.
    """
    lab = table(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    count = lambda pattern: F.log1p(F.length(F.regexp_replace("text", pattern, "")))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.log1p(F.length("text")).alias("n_chars"), F.split("text", " ").alias("_w"), F.split("text", "\n").alias("_l"))
    own = d.select(
        "doc_id", "source", "lang", "n_chars", F.log1p(F.size("_w")).alias("n_words"), F.log1p(F.size(F.array_distinct("_w"))).alias("n_distinct"), F.log1p(F.size("_l")).alias("n_lines"),
        count(r"[\w\s]").alias("n_symbols"), count(r"[^0-9]").alias("n_digits"), count(r"[^A-Z]").alias("n_capitals"), (F.length("text") / F.size("_w")).alias("word_length"),
        F.log1p(F.array_max(F.transform("_l", lambda x: F.length(x)))).alias("longest_line"),
    )
    by_source = own.groupBy("source").agg(F.log1p(F.count(F.lit(1))).alias("source_count"), F.avg("n_chars").alias("source_chars"))
    by_lang = own.groupBy("lang").agg(F.avg("n_chars").alias("lang_chars"))
    joined = lab.join(own, "doc_id").join(by_source, "source", "left").join(by_lang, "lang", "left").select("doc_id", "y", *_FEATURES)
    rows = splits.folds(relational.fill_median(joined, _FEATURES), ["doc_id"], "y")
    path = scratch(spark, "features")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _rows(spark, sf_dir) -> DataFrame:
    return learn.assemble(outlook_features(spark, sf_dir), _FEATURES)


#: Trees and depth of the tuned forest.
_TREES, _DEPTH = 400, 6


@query()
def q_rf(spark, sf_dir):
    """Balanced forest, out of five folds."""
    rows = learn.class_weights(_rows(spark, sf_dir), "y")
    preds = learn.out_of_fold(rows, lambda: learn.classifier("rf", "y", weight="weight", trees=_TREES, depth=_DEPTH), "doc_id", "y")
    return metrics.classification_report(preds, "y", "prediction")


@query()
def q_logreg(spark, sf_dir):
    """L1, L2"""
    return metrics.classification_report(learn.out_of_fold(_rows(spark, sf_dir), lambda: learn.classifier("logreg", "y"), "doc_id", "y"), "y", "prediction")


@query()
def q_gbt(spark, sf_dir):
    """L4"""
    return metrics.classification_report(learn.out_of_fold(_rows(spark, sf_dir), lambda: learn.classifier("gbt", "y", iters=20), "doc_id", "y"), "y", "prediction")


@query()
def q_mlp(spark, sf_dir):
    """L5"""
    return metrics.classification_report(learn.out_of_fold(_rows(spark, sf_dir), lambda: learn.classifier("mlp", "y", n_features=len(_FEATURES), iters=200), "doc_id", "y"), "y", "prediction")


@query()
def q_grid_search(spark, sf_dir):
    """Macro F1 of depth and leaf size over five folds."""
    found = learn.grid_search(_rows(spark, sf_dir), lambda depth, leaf: learn.classifier("rf", "y", trees=50, depth=depth, leaf=leaf), [{"depth": d, "leaf": n} for d in (3, 6) for n in (1, 5)], "doc_id", "y")
    return spark.createDataFrame([(str(p), v) for p, v in found], "params string, macro_f1 double")


@query()
def q_calibrated(spark, sf_dir):
    """Raw, sigmoid and isotonic probabilities of rows that neither model nor map has seen; the lowest ECE is chosen."""
    rows = learn.calibrated_out_of_fold(_rows(spark, sf_dir), lambda: learn.classifier("rf", "y", trees=50), "doc_id", "y", 2)
    path = scratch(spark, "calibrated")
    rows.write.parquet(path)
    back = spark.read.schema(rows.schema).parquet(path)
    top = F.array_max("proba")
    out = None
    for method in ("raw", "sigmoid", "isotonic"):
        some = back.where(F.col("method") == method)
        ece = metrics.ece(some.select(top.alias("c"), ((F.array_position("proba", top) - 1) == F.col("y")).alias("k")), "c", "k")
        one = ece.crossJoin(metrics.brier(some.withColumn("y", F.col("y").cast("int")), "proba", "y")).withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    best = out.agg(F.min_by("method", F.struct("ece", "method")).alias("chosen"))
    return out.crossJoin(F.broadcast(best)).select("method", "ece", "brier", (F.col("method") == F.col("chosen")).alias("chosen"))


@query()
def q_isotonic(spark, sf_dir):
    """Popularity scores mapped to ratings by isotonic regression."""
    train, test = _cells(spark, sf_dir)
    scored = train.join(recommend.popularity(train, train, "item"), ["occ", "item"])
    model = learn.isotonic(scored.select("score", F.col("rating").alias("y")), "score", "y")
    out = model.transform(test.join(recommend.popularity(train, test, "item"), ["occ", "item"]))
    return metrics.regression_report(out, "rating", "prediction")


@query()
def q_importance(spark, sf_dir):
    """Impurity and permutation importances of a forest."""
    feats = outlook_features(spark, sf_dir)
    model = learn.classifier("rf", "y").fit(learn.assemble(feats, _FEATURES))
    impurity = spark.createDataFrame(learn.importances(model, _FEATURES), "feature string, impurity double")
    return learn.permutation_importance(feats.select("doc_id", "y", *_FEATURES), model, _FEATURES, "doc_id", "y").join(impurity, "feature")


@query("WITH l AS (SELECT doc_id, min(quality)::DOUBLE AS y FROM labels WHERE quality IS NOT NULL GROUP BY doc_id), c AS (SELECT y, count(*) AS n FROM l JOIN documents USING (doc_id) GROUP BY y) SELECT y, CASE WHEN n > 1 THEN max(n) OVER () ELSE n END AS n FROM c")
def q_smote(spark, sf_dir):
    """Class sizes after filling up."""
    return learn.smote(outlook_features(spark, sf_dir), _FEATURES, "y", "doc_id").groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query()
def q_salary_models(spark, sf_dir):
    """Linear, forest and boosted regressors on postings, best by MAE."""
    keys = ["code", "o_orderpriority", "c_mktsegment"]
    s = materialised(splits.temporal(postings(spark, sf_dir), "o_orderdate", CUTOFF).select("o_orderkey", *keys, F.col("o_totalprice").cast("double").alias("o_totalprice"), "split"), "postings")
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    wanted = materialised(test.select(*keys).distinct(), "wanted")
    # every row of a cell has the same features, so trees grow from sums by cell
    grid = learn.Grid.of(materialised(learn.weighted_cells(train, keys, "o_totalprice"), "cells"), wanted, keys, "o_totalprice")
    out = None
    for name, hot in (("linear", True), ("rf", False), ("gbt", False)):
        options = {"trees": 200} if name == "rf" else {"iters": 200} if name == "gbt" else {}
        if name == "linear" or grid is None:
            prep = learn.encoded(keys, [], one_hot=hot).fit(train)
            model = learn.regressor(name, "o_totalprice", **options)
            if name != "linear":
                model = model.setMaxBins(max(64, *[train.select(k).distinct().count() + 1 for k in keys]))
            found = model.fit(prep.transform(train)).transform(prep.transform(wanted))
        elif name == "rf":
            found = learn.forest_cells(train, grid, ["o_orderkey"], "o_totalprice", **options)
        else:
            found = learn.boosted_cells(spark, grid, **options)
        named = materialised(found.select(*[F.col(k).alias(f"_{k}") for k in keys], "prediction"), "predictions")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        one = metrics.regression_report(test.join(named, same), "o_totalprice", "prediction").withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return learn.best_by(out, "mae")


@query()
def q_opportunities(spark, sf_dir):
    """The three grid cells of highest predicted value."""
    p = postings(spark, sf_dir)
    prep = learn.encoded(["code", "o_orderpriority"], [], one_hot=False).fit(p)
    model = learn.regressor("rf", "o_totalprice").setMaxBins(64).fit(prep.transform(p))
    cells = p.select("code").distinct().crossJoin(F.broadcast(p.select("o_orderpriority").distinct()))
    return learn.opportunities(model, prep.transform(cells), 3).select("code", "o_orderpriority", "prediction")


@query()
def q_linear_extractor(spark, sf_dir):
    """Labels of held-out documents, candidates by a word list and scores by one-versus-rest linear models.

    A document's label is its language; a language is a candidate where one of its
    function words occurs; its threshold is tuned on the training part.
    """
    d = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "text", "lang")
    s = splits.stratified(d.select("doc_id", "lang"), ["doc_id"], "lang", 0.3)
    f = textops.tfidf_rows(d, "doc_id", "text", sizes=(1,)).withColumnRenamed("doc_id", "id")
    named = s.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "split")
    own, held = named.where("split = 'train'").drop("split"), named.where("split = 'test'").drop("split")
    model = textops.ovr_linear(relational.member(f, own, ["id"]), own, "id", n_docs=own.count())
    scores = materialised(textops.linear_scores(f, model, "id"), "scores")
    tuning = relational.member(scores, own, ["id"]).join(own.withColumn("y", F.lit(1)), ["id", "label"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    tuned = metrics.tune_thresholds(tuning, "label", "score", "y", [-1.0, -0.5, -0.25, 0.0, 0.25, 0.5, 1.0]).select("label", "threshold")
    words = spark.createDataFrame([(k, w) for k, v in LANGUAGE_WORDS.items() for w in v], "label string, phrase string")
    found = textops.gazetteer(d, words.select("phrase").distinct(), "doc_id", "text", "phrase", sizes=(1,)).join(words, "phrase").select(F.col("doc_id").alias("id"), "label").distinct()
    hit = relational.member(textops.hybrid(found, scores, tuned, "id"), held, ["id"])
    cells = metrics.multilabel_cells(held, hit, "id", "label")
    return cells.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


@query()
def q_projection(spark, sf_dir):
    """Unit rows by a hashed sign projection."""
    f = textops.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text", sizes=(1,))
    return textops.random_projection(f, "doc_id", 16).select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm2"))

