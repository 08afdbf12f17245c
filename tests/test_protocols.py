"""Models, streams and estimators that SQL does not express, against brute force or planted structure."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careerloom.operators import factor, learn, metrics, ranking, recommend, splits, textops, trust
from careerloom.streaming import records


def planted(n_u=60, n_i=20, k=3, seed=1):
    rng = np.random.default_rng(seed)
    p, q, bu, bi = rng.normal(size=(n_u, k)), rng.normal(size=(n_i, k)), rng.normal(0, 0.3, n_u), rng.normal(0, 0.3, n_i)
    return [(u, f"i{i:02}", float(2.5 + bu[u] + bi[i] + 0.5 * p[u] @ q[i])) for u in range(n_u) for i in range(n_i)]


def test_alternating_fit_recovers_planted_factors():
    rows = planted()
    u, i, r = np.array([x[0] for x in rows]), np.array([int(x[1][1:]) for x in rows]), np.array([x[2] for x in rows])
    held = np.random.default_rng(2).random(len(r)) < 0.15
    mu, bu, bi, P, Q = factor.fit_mf(u[~held], i[~held], r[~held], 60, 20, k=3, reg=0.01)
    e = mu + bu[u] + bi[i] + np.einsum("nk,nk->n", P[u], Q[i]) - r
    assert np.sqrt((e[held] ** 2).mean()) < 0.25 * r.std()
    mu, bu, bi, P, Q = factor.fit_mf(u, i, r, 60, 20, k=3, use_item_bias=False)
    assert not bi.any()


def test_ridge_rows_solve_the_normal_equations():
    rng = np.random.default_rng(3)
    owner, x, y = rng.integers(0, 4, 50), rng.normal(size=(50, 3)), rng.normal(size=50)
    got = factor._solve_rows(owner, 6, x, y, 0.1)
    for row in range(4):
        m = owner == row
        assert np.allclose((x[m].T @ x[m] + 0.1 * m.sum() * np.eye(3)) @ got[row], x[m].T @ y[m])
    assert not got[4:].any()


def test_distributed_fit_beats_the_mean(spark):
    cells = spark.createDataFrame(planted(), "occ long, item string, rating double")
    s = splits.stratified(cells, ["occ", "item"], "item", 0.2)
    train, test = s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")
    extra = spark.createDataFrame([(9999, "i00", 0.0), (1, "new", 0.0)], "occ long, item string, rating double")
    rows = test.unionByName(extra).join(factor.distributed_scores(train, test.unionByName(extra), k=3, checkpoint=False), ["occ", "item"]).collect()
    known = [(r.rating, r.score) for r in rows if r.occ != 9999 and r.item != "new"]
    y, p = np.array(known).T
    assert len(rows) == test.count() + 2 and np.sqrt(((y - p) ** 2).mean()) < 0.6 * y.std()
    assert all(math.isfinite(r.score) for r in rows)


def test_tuning_names_the_edge(spark):
    found = spark.createDataFrame([('{"reg": 1.0}', 0.3, 0.2), ('{"reg": 10.0}', 0.3, 0.5), ('{"reg": 3.0}', 0.3, 0.5)], "params string, rmse double, p_10 double")
    row = factor.tuned(found, "reg", [1.0, 3.0, 10.0]).first()
    assert (row.value, row.p_10, row.at_edge) == (3.0, 0.5, False)
    assert factor.tuned(found.where("rmse < 1 and params like '%10%'"), "reg", [1.0, 3.0, 10.0]).first().at_edge


def test_one_pass_bootstrap_has_the_right_width(spark):
    r = random.Random(0)
    rows = [("a", i, r.gauss(100, 15)) for i in range(400)] + [("b", 1, 5.0), ("c", 2, None)]
    got = {x.g: x for x in trust.poisson_ci(spark.createDataFrame(rows, "g string, k int, v double"), ["g"], "k", "v").collect()}
    assert got["a"].lo < got["a"].mean < got["a"].hi and (got["a"].hi - got["a"].lo) / 2 == pytest.approx(1.96 * 15 / math.sqrt(400), rel=0.1)
    assert (got["b"].n, got["b"].lo, got["b"].hi) == (1, 5.0, 5.0) and "c" not in got
    steps = [int(s, 16) / 16**4 for s in trust.poisson_steps()]
    assert sum(1 - s for s in steps) == pytest.approx(1.0, abs=1e-3)  # the mean of the draw


def test_nearest_information_equals_brute_force(spark):
    r = random.Random(5)
    rows = [(r.gauss(0, 1) + (2 if c == "x" else 0), r.gauss(0, 1), c) for c in ["x"] * 60 + ["y"] * 90] + [(None, 1.0, "x"), (0.5, 0.5, "z")]
    got = {x.feature: x.mutual_information for x in metrics.nearest_mutual_information(spark.createDataFrame(rows, "a double, b double, c string"), ["a", "b"], "c").collect()}
    psi = lambda n: sum(1 / j for j in range(1, n)) - np.euler_gamma
    for j, f in enumerate("ab"):
        pts = [(x[j], x[2]) for x in rows if x[j] is not None and x[2] != "z"]
        total = []
        for n, (v, c) in enumerate(pts):
            own = sorted(abs(v - w) for m, (w, d) in enumerate(pts) if m != n and d == c)
            radius = math.nextafter(own[2], 0)
            total.append(psi(3) - psi(len(own) + 1) - psi(sum(abs(v - w) <= radius for w, _ in pts)))
        assert got[f] == pytest.approx(max(0.0, psi(len(pts)) + sum(total) / len(total)), abs=1e-9)
    assert got["a"] > 0.2 > got["b"]


def test_svd_rows_equal_numpy(spark):
    r = random.Random(7)
    cells = [(d, f"t{r.randrange(30)}", r.random()) for d in range(25) for _ in range(6)]
    f = spark.createDataFrame(cells, "doc long, term string, weight double").groupBy("doc", "term").agg(F.sum("weight").alias("weight"))
    got = {x.doc: np.array(x.v) for x in textops.svd_embedding(f, "doc", dims=64, k=5).collect()}
    x = np.zeros((25, 64))
    for c in f.select("doc", F.pmod(F.xxhash64("term"), F.lit(64)).alias("i"), "weight").collect():
        x[c.doc, c.i] += c.weight
    u, s, vt = np.linalg.svd(x)
    want = x @ vt[:5].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    mine = np.stack([got[d] for d in range(25)])
    assert np.allclose(mine @ mine.T, want @ want.T, atol=1e-8)


def test_hashed_rows_reach_workers_as_arrays(spark):
    f = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.25), (2, "a", 1.0)], "doc long, term string, weight double")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b")
    rows = textops.hashed_rows(f, "doc", 1)
    assert dict(rows.dtypes) == {"doc": "bigint", "i": "array<int>", "w": "array<double>"}
    assert spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= 8 << 20
    assert {x.doc: (x.i, sorted(x.w)) for x in rows.collect()} == {1: ([0, 0], [0.25, 0.5]), 2: ([0], [1.0])}
    part = rows.orderBy("doc").toArrow().combine_chunks().slice(1)
    assert textops._dense(part.column("i").chunk(0), part.column("w").chunk(0), 2).tolist() == [[1.0, 0.0]]


def test_rows_weighted_in_place_equal_joined_ones(spark, monkeypatch):
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(12)}" for _ in range(r.randrange(30))) for _ in range(40)] + [None, "", "once"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, t string")

    def rows(frame):
        return {x.d: [round(v, 9) for v in np.bincount(x.i, weights=x.w, minlength=64)] for x in textops.tfidf_rows(frame, "d", "t", dims=64, least_df=3).collect()}

    want = {x.d: [round(v, 9) for v in np.bincount(x.i, weights=x.w, minlength=64)] for x in textops.hashed_rows(textops.tfidf(docs, "d", "t", least_df=3), "d", 64).collect()}
    assert rows(docs) == want and 42 not in want
    twice = docs.union(docs.where("d < 3"))
    assert len(rows(twice)) == len(want)
    f = textops.tfidf_rows(docs, "d", "t", dims=64, least_df=3)
    model = spark.createDataFrame([("x", 0.5, [float(i % 3) for i in range(64)]), ("none", 1.0, [0.0] * 64)], "label string, bias double, w array<double>")
    few = {(x.d, x.label): round(x.score, 9) for x in textops.linear_scores(f, model, "d", dims=64).collect()}
    monkeypatch.setattr(textops, "FEW_LABELS", 0)
    assert few == {(x.d, x.label): round(x.score, 9) for x in textops.linear_scores(f, model, "d", dims=64).collect()} and few
    monkeypatch.setattr(textops, "FEW_TERMS", 0)
    assert rows(docs) == want


def test_hashed_terms_and_phrases_equal_brute_force(spark, monkeypatch):
    texts = ["The red fox and the red hen", "red fox", "", "hen and the fox; THE RED fox!", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    vocab = spark.createDataFrame([("red fox",), ("hen",), ("the red hen",), ("four words are long",), ("",)], "p string")
    want = {(0, "red fox"), (0, "hen"), (0, "the red hen"), (1, "red fox"), (3, "hen"), (3, "red fox")}
    assert {(x.d, x.p) for x in textops.gazetteer(docs, vocab, "d", "t", "p").collect()} == want
    monkeypatch.setattr(textops, "FEW_PHRASES", 1)
    assert {(x.d, x.p) for x in textops.gazetteer(docs, vocab, "d", "t", "p").collect()} == want
    got = textops.tfidf(docs, "d", "t", least_df=2, sizes=(1,)).groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("weight") * F.col("weight")).alias("l")).collect()
    assert {x.d: x.n for x in got} == {0: 5, 1: 2, 3: 5} and all(x.l == pytest.approx(1) for x in got)


def test_packed_similarities_and_votes_equal_joins(spark, monkeypatch):
    r = random.Random(9)
    cells = [(o, f"i{i:03}", float(r.randrange(6))) for o in range(40) for i in range(70) if r.random() < 0.4] + [(99, "only", 5.0), (98, "i001", 0.0)]
    train = spark.createDataFrame(cells, "occ long, item string, rating double")
    held = spark.createDataFrame([(o, f"i{i:03}", 1.0) for o in range(0, 40, 3) for i in range(0, 70, 9)] + [(99, "i000", 1.0), (7, "new", 1.0), (500, "i000", 1.0)], "occ long, item string, rating double")
    read = lambda df: {tuple(x[:-1]): round(x[-1], 9) for x in df.collect()}
    core = recommend.core_items(train)
    assert recommend.jaccard_similarities(core)._jdf.queryExecution().toString().count("BroadcastNestedLoopJoin")
    packed, joined = read(recommend.jaccard_similarities(core)), read(recommend._joined_similarities(core))
    assert packed == joined and packed
    assert read(recommend.jaccard_similarities(core, digits=6)) == {k: round(v, 6) for k, v in joined.items()}
    forms = lambda: [read(recommend.jaccard_cf(train, held, k=3)), read(recommend.jaccard_cf_dense(train, held, k=5))]
    one = forms()
    monkeypatch.setattr(recommend, "MAX_CELLS", 0)
    assert forms() == one and len(one[0]) == held.count()
    monkeypatch.setattr(recommend, "MOST_ITEMS", 3)
    assert read(recommend.jaccard_similarities(core)) == joined


def test_votes_of_many_slabs_take_no_joins(spark, monkeypatch):
    r = random.Random(19)
    cells = [(o, f"i{i:02}", float(r.randrange(6)) if r.random() < 0.9 else None) for o in range(60) for i in range(12) if r.random() < 0.6]
    cells += [(o + 100, *rest) for o, *rest in cells if o < 20] + [(3, None, 5.0), (5, None, 1.0), (None, "i01", 5.0), (98, "i01", 0.0), (99, "only", 5.0)]
    train = spark.createDataFrame(cells, "occ long, item string, rating double")
    held = spark.createDataFrame([(o, f"i{i:02}", 1.0) for o in range(0, 110, 3) for i in range(0, 12, 5)] + [(98, "i00", 1.0), (7, "new", 1.0), (500, "i00", 1.0), (6, None, 1.0), (None, "i00", 1.0)], "occ long, item string, rating double")
    read = lambda df: {tuple(x[:-1]): x[-1] if x[-1] is None else round(x[-1], 9) for x in df.collect()}
    forms = lambda: [read(recommend.jaccard_cf(train, held, k=3)), read(recommend.jaccard_cf_dense(train, held, k=5)), read(recommend.jaccard_cf_dense(train, held, k=500))]
    blocks, joins = recommend._neighbour_votes, recommend._joined_votes
    monkeypatch.setattr(recommend, "_neighbour_votes", joins)
    want = forms()
    monkeypatch.setattr(recommend, "_neighbour_votes", blocks)
    monkeypatch.setattr(recommend, "_joined_votes", None)
    for name, value in {"MAX_CELLS": 150, "SLAB_CELLS": 40, "SLABS": 3, "QUERY_BLOCK": 9, "PAIRS": 20}.items():
        monkeypatch.setattr(recommend, name, value, raising=False)
    assert forms() == want and len(want[1]) == held.count()
    # the slabs are read where they lie: one exchange for the blocks and one for the slabs, none of a copy for each block
    plan = recommend._neighbour_votes(train, held, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan


def test_cosine_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (5, [0.0, 0.0]), (10, None), (1, [3.0, 4.0]), (2, [1.0, None]), (3, [1.0]), (4, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, e array<float>")
    plan = recommend.latent_cosine(v, v.where("id % 5 = 0"), "e")
    got = {(x.query_id, x.id): x.score for x in plan.collect()}
    assert "MapInArrow" in plan._jdf.queryExecution().toString() and len(got) == 3 * 6
    assert got[0, 1] == pytest.approx(0.6) and got[0, 4] == got[5, 1] == 0.0
    assert all(got[0, i] is None for i in (2, 3, 10)) and got[10, 1] is None


def test_cosine_queries_go_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "id long, e array<double>")
    whole = {tuple(x) for x in recommend.latent_cosine(v, v.where("id % 5 = 0"), "e").collect()}
    monkeypatch.setattr(recommend, "QUERY_BLOCK", 2)
    assert {tuple(x) for x in recommend.latent_cosine(v, v.where("id % 5 = 0"), "e").collect()} == whole and len(whole) == 6 * 29


def test_calibration_never_sees_its_rows(spark):
    r = random.Random(11)
    rows = [(i, float(r.random() < 0.3 + 0.4 * (i % 2)), float(i % 2), r.random()) for i in range(240)]
    df = learn.assemble(splits.folds(spark.createDataFrame(rows, "id long, y double, a double, b double"), ["id"], "y", k=2), ["a", "b"])
    out = learn.calibrated_out_of_fold(df, lambda: learn.classifier("rf", "y", trees=5, depth=3), "id", "y", 2, folds=2).collect()
    assert len(out) == 3 * 240 and {x.method for x in out} == {"raw", "sigmoid", "isotonic"}
    assert all(sum(x.proba) == pytest.approx(1) and len(x.proba) == 2 for x in out)


def test_streams_take_in_only_what_is_new(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("t", T.StringType())])
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    take = lambda: records.take_in(spark, f"{tmp_path}/in", schema, keys, "k", f"{tmp_path}/out", f"{tmp_path}/seen")
    spark.createDataFrame([("a", "two\nlines"), ("c", "no")], schema).write.mode("append").options(header=True, escape='"').csv(f"{tmp_path}/in")
    assert [tuple(x) for x in take().collect()] == [("a", "two\nlines")]
    spark.createDataFrame([("b", "later"), ("a", "two\nlines")], schema).write.mode("append").options(header=True, escape='"').csv(f"{tmp_path}/in")
    assert sorted(tuple(x) for x in take().collect()) == [("a", "two\nlines"), ("b", "later")]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3  # each file was read once


def test_a_walk_model_stays_finite(spark):
    rows = [(u, f"i{i}", 5.0 if (u + i) % 2 else 1.0) for u in range(12) for i in range(8)]
    s = factor.score_models(spark.createDataFrame(rows, "occ long, item string, rating double"), ["node2vec"], k=8)
    assert s.where(F.isnan("score") | (F.abs("score") > 1e6)).count() == 0
    y = s.join(spark.createDataFrame(rows, "occ long, item string, rating double"), ["occ", "item"]).withColumn("y", (F.col("rating") > 2).cast("int"))
    assert ranking.roc_auc(y, "score", "y").first()[0] > 0.9


def test_filled_classes_do_not_depend_on_blocks(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, r.random(), r.random(), 1.0) for i in range(120)] + [(i, r.random(), float(i % 4), 0.0) for i in range(200, 250)] + [(999, 0.0, 0.0, 2.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y double")
    read = lambda: sorted(tuple(x) for x in learn.smote(df, ["a", "b"], "y", "k").collect())
    whole = read()
    assert sum(x[2] == 0.0 for x in whole) == sum(x[2] == 1.0 for x in whole) == 120 and len(whole) == 241
    monkeypatch.setattr(learn, "SMOTE_BLOCK", 7)
    assert read() == whole
    x = np.array([[v[1], v[2]] for v in rows[120:170]])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert (learn._nearest(x, np.arange(50), 3) == np.argsort(d, axis=1, kind="stable")[:, :3]).all()


def test_walks_of_all_nodes_have_second_order_steps():
    a, b = np.array([0, 0, 0, 1, 1, 2]), np.array([3, 4, 5, 3, 4, 3])
    paths = factor._walks(a, b, 7, 3000, 6, 1.0, 0.5, np.random.default_rng(1))
    edges = {(int(x), int(y)) for x, y in zip(a, b)} | {(int(y), int(x)) for x, y in zip(a, b)}
    assert paths.shape == (6 * 3000, 6) and {(int(x), int(y)) for w in paths[:200] for x, y in zip(w, w[1:])} <= edges
    at = (paths[:, 0] == 3) & (paths[:, 1] == 0)
    share = [(paths[at, 2] == x).mean() for x in (3, 4, 5)]  # weights 1, 2, 2
    assert np.allclose(share, [0.2, 0.4, 0.4], atol=0.03)
    m = np.zeros((3, 2))
    factor._take(m, np.array([2, 0, 2]), np.ones((3, 2)))
    assert m.tolist() == [[-1, -1], [0, 0], [-2, -2]]


def test_nearest_information_counts_equal_rows(spark):
    r = random.Random(8)
    few = [(float(r.randrange(12)), r.choice("xxyz")) for _ in range(150)]
    psi = lambda n: sum(1 / j for j in range(1, n)) - np.euler_gamma
    total = 0.0
    for n, (v, c) in enumerate(few):
        own = sorted(abs(v - w) for m, (w, d) in enumerate(few) if m != n and d == c)
        total += psi(3) - psi(len(own) + 1) - psi(sum(abs(v - w) < own[2] or v == w for w, _ in few))
    frame = spark.createDataFrame(few, "a double, c string")
    assert metrics.nearest_mutual_information(frame, ["a"], "c").first().mutual_information == pytest.approx(max(0.0, psi(150) + total / 150), abs=1e-9)
    many = spark.range(210_000).select(F.col("id").cast("double").alias("a"), (F.col("id") < 105_000).cast("string").alias("c"))
    assert metrics.nearest_mutual_information(many, ["a"], "c").first().mutual_information == pytest.approx(math.log(2), abs=0.01)


def test_weighted_cells_grow_the_same_boosted_trees(spark):
    r = random.Random(6)
    rows = [(a, b, 10.0 * (a == "x") + 3.0 * (b == "q") + r.random()) for a, b in ((r.choice("wxyz"), r.choice("pq")) for _ in range(400))]
    df = spark.createDataFrame(rows, "a string, b string, y double")
    prep = learn.encoded(["a", "b"], [], one_hot=False).fit(df)
    grid = prep.transform(df.select("a", "b").distinct())
    one = learn.regressor("gbt", "y", iters=5).fit(prep.transform(df))
    two = learn.regressor("gbt", "y", iters=5).setWeightCol("weight").fit(prep.transform(learn.weighted_cells(df, ["a", "b"], "y")))
    read = lambda m: {(x.a, x.b): x.prediction for x in m.transform(grid).collect()}
    want, got = read(one), read(two)
    assert len(want) == 8 and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


def test_linear_models_are_fitted_on_every_document(spark):
    n = 24_000
    docs = spark.range(n).select(F.col("id").alias("d"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("label"), F.xxhash64("id").alias("h"))
    last = {x.label: x.d for x in docs.groupBy("label").agg(F.max_by("d", "h").alias("d")).collect()}  # what a draw by hash would take last
    column = F.when(F.col("d") == last["even"], 2).when(F.col("d") == last["odd"], 3).otherwise(F.col("d") % 2).cast("int")
    rows = docs.select("d", F.array(column).alias("i"), F.array(F.lit(1.0)).alias("w"))
    labels = docs.select("d", "label").unionByName(spark.createDataFrame([(0, "both"), (1, "both"), (n + 5, "unseen"), (3, None)], "d long, label string"))
    got = {x.label: x for x in textops.ovr_linear(rows, labels, "d", dims=8).collect()}
    assert set(got) == {"even", "odd", "both", "unseen"}
    assert got["even"].w[0] > 0 > got["even"].w[1] and got["odd"].w[1] > 0 > got["odd"].w[0]
    assert got["even"].w[2] > 0 > got["odd"].w[2] and got["odd"].w[3] > 0 > got["even"].w[3]
    assert not any(got["unseen"].w[4:]) and got["unseen"].bias < 0


def test_one_shard_steps_as_plain_descent(spark):
    r = random.Random(2)
    cells = [(d, [r.randrange(6), r.randrange(6)], [r.random(), r.random()], r.choice("abc")) for d in range(50)]
    df = spark.createDataFrame(cells, "d long, i array<int>, w array<double>, label string")
    got = {x.label: x for x in textops.ovr_linear(df.drop("label"), df, "d", dims=6).collect()}
    order = [x.d for x in df.orderBy(F.xxhash64("d"), "d").collect()]
    for c in "abc":
        y = np.array([1.0 if cells[d][3] == c else -1.0 for d in order])
        share = np.where(y > 0, 50 / (2 * (y > 0).sum()), 50 / (2 * (y < 0).sum()))
        w, b, t, rng = np.zeros(6), 0.0, 0, np.random.Generator(np.random.PCG64(42))
        for _ in range(5):
            for n in rng.permutation(50):
                t += 1
                eta = 0.1 / (1 + 0.01 * t)
                w *= 1 - eta * 1e-5
                x = np.bincount(cells[order[n]][1], weights=cells[order[n]][2], minlength=6)
                if y[n] * (x @ w + b) < 1:
                    w, b = w + eta * share[n] * y[n] * x, b + eta * share[n] * y[n]
        assert np.allclose(got[c].w, w) and got[c].bias == pytest.approx(b)


def test_trees_of_cells_equal_those_of_rows(spark):
    r = random.Random(12)
    rows = [(i, a, b, 10.0 * (a in ("x", "z")) + 3.0 * (b == "q") * (a == "w") + r.random()) for i, a, b in ((i, r.choice(["w", "x", "y", "z", None]), r.choice("pqr")) for i in range(600))]
    df = spark.createDataFrame(rows, "k long, a string, b string, y double")
    wanted = df.select("a", "b").distinct().unionByName(spark.createDataFrame([("new", "q")], "a string, b string"))
    grid = learn.Grid.of(learn.weighted_cells(df, ["a", "b"], "y"), wanted, ["a", "b"], "y")
    prep = learn.encoded(["a", "b"], [], one_hot=False).fit(df)
    read = lambda f: {(x.a, x.b): x.prediction for x in f.collect()}
    want, got = read(learn.regressor("gbt", "y", iters=12).fit(prep.transform(df)).transform(prep.transform(wanted))), read(learn.boosted_cells(spark, grid, iters=12))
    assert set(got) == set(want) and len(got) == 16 and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    forest = read(learn.forest_cells(df, grid, ["k"], "y", trees=40))
    assert forest == pytest.approx(read(learn.forest_cells(df.repartition(7), grid, ["k"], "y", trees=40)), abs=1e-9) and set(forest) == set(want)
    rf = read(learn.regressor("rf", "y", trees=40).fit(prep.transform(df)).transform(prep.transform(wanted)))
    assert all(forest[k] == pytest.approx(v, abs=1.5) for k, v in rf.items() if k[0] != "new")
    draws = learn.bootstrap_counts(np.arange(40_000) * 7919, 30)
    assert draws.mean() == pytest.approx(1, abs=0.01) and draws.var() == pytest.approx(1, abs=0.02)
    assert np.abs(np.corrcoef(draws.T) - np.eye(30)).max() < 0.03


def test_salary_trees_take_sums_by_cell(spark, sf_dir, monkeypatch):
    from careerloom.plans import model_queries

    whole = model_queries.q_salary_models(spark, sf_dir).first()
    assert whole.model in ("linear", "rf", "gbt") and math.isfinite(whole.mae)
    monkeypatch.setattr(learn, "RandomForestRegressor", None)
    monkeypatch.setattr(learn, "GBTRegressor", None)
    assert model_queries.q_salary_models(spark, sf_dir).first().model == whole.model


def test_salary_models_boost_all_rounds(spark, sf_dir, monkeypatch):
    from careerloom.plans import model_queries

    taken, boost = [], learn.boosted_cells
    monkeypatch.setattr(learn, "boosted_cells", lambda *a, **o: taken.append(o) or boost(*a, **o))
    model_queries.q_salary_models(spark, sf_dir)
    assert taken == [{"iters": 200}]


def test_walk_steps_of_busy_nodes_do_not_overshoot():
    r = np.random.default_rng(0)
    u, i = np.repeat(np.arange(9000), 3), np.tile(np.arange(3), 9000)
    got = factor.fit_node2vec(u, i, np.where(r.random(len(u)) < 0.5, 5.0, 1.0), 9000, 3, walks=1, epochs=1)
    assert all(np.isfinite(m).all() and np.abs(m).max() < 10 for m in got[2:])
    places = np.array([0, 1, factor.MOST_PLACES, 4 * factor.MOST_PLACES])
    assert factor._share(places, np.array([[3, 0], [1, 2]])).tolist() == [[0.25, 1], [1, 1]]


def test_walk_model_places_groups_apart():
    rows = [(u, i, 5.0 if u % 4 == i % 4 else 1.0) for u in range(400) for i in range(24)]
    u, i, r = (np.array(c) for c in zip(*rows))
    _, _, P, Q = factor.fit_node2vec(u, i, r, 400, 24, walks=4)
    s = (P @ Q.T)[u, i]
    assert s[r > 4].min() > s[r < 4].max()
