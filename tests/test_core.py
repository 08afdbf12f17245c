"""Hand-computed cases for metrics, audits, tiers, codes, splits and stores."""

import math

import pytest
from pyspark.sql import functions as F

from careerloom.functions.columns import detect_language, pad_code, parse_rated, sentences, sigmoid, singular, tier, tier_label, token_set, verdict
from careerloom.operators import factor, metrics, ranking, recommend, relational, splits, textops, trust
from careerloom.operators.ordered import dense_ids, row_numbers, terciles
from careerloom.sources import io


def one(df):
    return df.first().asDict()


def test_ece_matches_two_bins(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 1), (0.9, 0), (0.6, 1), (0.6, 0)], "c double, k int")
    want = 3 / 5 * abs(2 / 3 - 0.9) + 2 / 5 * abs(0.5 - 0.6)
    assert one(metrics.ece(df, "c", "k"))["ece"] == pytest.approx(want)


def test_ece_is_zero_when_perfect(spark):
    df = spark.createDataFrame([(1.0, 1)] * 4, "c double, k int")
    assert one(metrics.ece(df, "c", "k"))["ece"] == 0


def test_confidence_zero_falls_in_no_bin(spark):
    df = spark.createDataFrame([(0.0, 1)], "c double, k int")
    assert one(metrics.ece(df, "c", "k"))["ece"] == 0
    assert metrics.reliability(df, "c", "k").where("n > 0").count() == 0


def test_reliability_keeps_empty_bins(spark):
    rows = metrics.reliability(spark.createDataFrame([(0.95, 1)], "c double, k int"), "c", "k").collect()
    assert len(rows) == 10 and sum(r.n for r in rows) == 1 and [r for r in rows if r.bin == 1][0].accuracy is None


def test_brier(spark):
    df = spark.createDataFrame([([0.7, 0.2, 0.1], 0), ([0.1, 0.8, 0.1], 1), ([0.3, 0.3, 0.4], 2)], "p array<double>, y int")
    want = ((0.09 + 0.04 + 0.01) + (0.01 + 0.04 + 0.01) + (0.09 + 0.09 + 0.36)) / 3
    assert one(metrics.brier(df, "p", "y"))["brier"] == pytest.approx(want)


def test_bootstrap_covers_mean_and_width(spark):
    import random

    r = random.Random(0)
    df = spark.createDataFrame([("a", i, r.gauss(100, 15)) for i in range(400)], "g string, k int, v double")
    got = one(trust.bootstrap_ci(df, ["g"], "k", "v", draws=400))
    assert got["lo"] < got["mean"] < got["hi"]
    assert (got["hi"] - got["lo"]) / 2 == pytest.approx(1.96 * 15 / math.sqrt(400), rel=0.25)


def test_bootstrap_of_nothing_is_empty(spark):
    df = spark.createDataFrame([], "g string, k int, v double")
    assert trust.bootstrap_ci(df, ["g"], "k", "v", draws=10).count() == 0


AUDIT = "group string, metric double, lo double, hi double"


@pytest.mark.parametrize(
    ("rows", "higher", "best", "significant"),
    [
        ([("a", 0.9, 0.85, 0.95), ("b", 0.6, 0.5, 0.7)], True, "a", True),
        ([("a", 10.0, 9.0, 11.0), ("b", 20.0, 18.0, 22.0)], False, "a", True),
        ([("a", 0.9, 0.6, 0.95), ("b", 0.8, 0.5, 0.9)], True, "a", False),
    ],
)
def test_disparity(spark, rows, higher, best, significant):
    got = one(trust.disparity(spark.createDataFrame(rows, AUDIT), higher_is_better=higher))
    assert got["best"] == best and got["significant"] is significant and got["overlap"] is (not significant)
    assert got["gap"] == pytest.approx(abs(rows[0][1] - rows[1][1]))


def test_disparity_floor_and_single_group(spark):
    low = one(trust.rendered(trust.disparity(spark.createDataFrame([("a", 1.0, 0.9, 1.1), ("b", 3.0, 2.0, 4.0)], AUDIT), higher_is_better=False, floor=5.0)))
    assert low["relative_reliable"] is False and low["shown"] == "n/a"
    lone = one(trust.disparity(spark.createDataFrame([("a", 1.0, 0.9, 1.1)], AUDIT), higher_is_better=False))
    assert lone["gap"] is None and lone["note"]


def test_codes_keep_leading_zeros(spark):
    df = spark.createDataFrame([("111",), ("21100",), ("123456",)], "c string")
    assert [r[0] for r in df.select(pad_code(F.col("c"))).collect()] == ["00111", "21100", "123456"]
    assert [r[0] for r in df.select(tier(F.col("c"))).collect()] == ["0", "1", "2"]
    assert [r[0] for r in df.select(tier_label(F.col("c"), {"1": "University"})).collect()] == ["TEER 0", "University", "TEER 2"]


def test_terciles_are_near_equal(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 31)], "k int, v double")
    sizes = {r[0]: r[1] for r in terciles(df, [F.col("v")]).groupBy("pop_tier").count().collect()}
    assert sizes == {"low": 10, "medium": 10, "high": 10}
    tied = spark.createDataFrame([(i, 1.0) for i in range(4)], "k int, v double")
    assert terciles(tied, [F.col("v"), F.col("k")]).count() == 4


def test_grouped_audits(spark):
    rows = [("a", i, 10.0 * i, 10.0 * i + 10) for i in range(25)] + [("b", 100 + i, 1.0, 1.0) for i in range(3)]
    got = trust.regression_audit(spark.createDataFrame(rows, "g string, k int, t double, p double"), "g", "k", "t", "p", draws=20).collect()
    assert [(r.group, r.n, r.metric) for r in got] == [("a", 25, 10.0)]
    hits = spark.createDataFrame([("x", i, i % 2, i % 2) for i in range(10)], "g string, k int, t int, p int")
    got = one(trust.classification_audit(hits, "g", "k", "t", "p", draws=20))
    assert got["metric"] == 1.0 and got["macro_f1"] == 1.0


def test_metric_record(spark, tmp_path):
    w = io.Writer()
    path = w.metric(spark, "Trust", "A b", {"ece": 0.1}, f"file://{tmp_path}")
    assert path.endswith("trust__a_b") and w.saved == [path]
    assert spark.read.json(path).first().metrics.ece == 0.1


def test_model_store(spark, tmp_path):
    io.Writer().model({"mu": 2.5}, {"items": spark.createDataFrame([("a", 0.5)], "k string, b double")}, spark, f"file://{tmp_path}/m")
    scalars, tables = io.load_model(spark, f"file://{tmp_path}/m", ["items"])
    assert scalars == {"mu": 2.5} and tables["items"].count() == 1


def test_sources_fail_early(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        io.check_present(spark, [f"file://{tmp_path}/none"])
    twice = spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0)], "occupation_id int, descriptor_id int, rating double")
    with pytest.raises(ValueError):
        io.load_ratings(twice)
    calls = []
    build = lambda: calls.append(1) or spark.range(3).toDF("i")
    for _ in range(2):
        assert io.build_or_load(spark, f"file://{tmp_path}/cache", build).count() == 3
    assert calls == [1]


def test_ranking_invariants(spark):
    rows = [("q", i, float(5 - i), int(i < 2), float(5 - i)) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, i int, s double, rel int, gr double")
    got = one(ranking.per_group(df, "g", "i", "s", "rel", "gr", ks=(2,)))
    assert got["ndcg_2"] == pytest.approx(1) and got["p_2"] == 1 and got["mrr"] == 1 and got["recall_2"] == 1
    none = df.withColumn("rel", F.lit(0)).withColumn("gr", F.lit(0.0))
    got = one(ranking.per_group(none, "g", "i", "s", "rel", "gr", ks=(2,)))
    assert got["recall_2"] is None and got["ndcg_2"] is None and got["mrr"] == 0


def test_auc(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert one(ranking.roc_auc(df, "s", "y"))["roc_auc"] == pytest.approx(0.75)
    assert one(ranking.pr_auc(df, "s", "y"))["pr_auc"] == pytest.approx(0.8333333)
    tied = spark.createDataFrame([(0.5, 0), (0.5, 1)], "s double, y int")
    assert one(ranking.roc_auc(tied, "s", "y"))["roc_auc"] == 0.5


def test_random_scores_are_near_half(spark):
    df = spark.range(4000).select(F.col("id").alias("occ"), F.lit("i").alias("item"), (F.col("id") % 2).cast("int").alias("y"))
    scored = recommend.random_scores(df).join(df, ["occ", "item"])
    assert 0.45 < one(ranking.roc_auc(scored, "score", "y"))["roc_auc"] < 0.55


def test_pearson_without_variance(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (2, "a", 1.0), (2, "b", 3.0)], "occ int, item string, rating double")
    got = {r.occ: r.score for r in recommend.pearson_with(rows, rows.where("occ = 2")).collect()}
    assert got[1] == 0 and got[2] == pytest.approx(1)


def test_splits(spark):
    df = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 99)], "s string, k int")
    got = splits.stratified(df, ["k"], "s", 0.1).groupBy("s", "split").count().collect()
    assert sorted((r.s, r.split, r["count"]) for r in got) == [("a", "test", 2), ("a", "train", 18), ("b", "train", 1)]
    sizes = [r["count"] for r in splits.folds(df.where("s = 'a'"), ["k"], "s").groupBy("fold").count().collect()]
    assert sizes == [4] * 5


def test_row_numbers_and_ids(spark):
    df = spark.createDataFrame([(3,), (1,), (2,), (2,), (None,)], "v int")
    assert sorted((r.v, r.id) for r in dense_ids(df, "v", "id").collect()) == [(1, 0), (2, 1), (3, 2)]
    ranked = row_numbers(spark.range(1000).toDF("k"), [F.col("k").desc()]).collect()
    assert all(r.rn == 1000 - r.k for r in ranked)


@pytest.mark.parametrize("few", [1000, 1])
def test_contains_join_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(relational, "FEW_PHRASES", few)
    texts, phrases = ["senior data analysts wanted", "nurse", "", None, "data"], ["data analyst", "nurse", "cook", "data"]
    t = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    p = spark.createDataFrame([(x,) for x in phrases], "p string")
    got = {(r.i, r.p) for r in relational.contains_join(t, p, "t", "p").collect()}
    assert got == {(i, x) for i, a in enumerate(texts) if a for x in phrases if x in a}


def test_ties_survive_the_neighbour_cut(spark):
    df = spark.createDataFrame([("u", i, s) for i, s in enumerate([0.9, 0.5, 0.5, 0.1])], "u string, v int, s double")
    assert relational.top_with_ties(df, ["u"], "s", 2).count() == 3


def test_text_functions(spark):
    df = spark.createDataFrame([("The nurses of the ward. Short. And for a longer sentence",)], "t string")
    r = df.select(detect_language(F.col("t")), sentences(F.col("t")), token_set(F.col("t")), singular(F.lit("cats"))).first()
    assert r[0] == "en" and r[1] == ["The nurses of the ward", "And for a longer sentence"] and "nurse" in r[2] and r[3] == "cat"
    parsed = spark.range(1).select(parse_rated(F.lit("A:9, b ,c:x,"))).first()[0]
    assert [(x.name, x.rating) for x in parsed] == [("a", 5.0), ("b", 4.0), ("c", 4.0)]
    assert spark.range(1).select(sigmoid(F.lit(-800.0)), sigmoid(F.lit(800.0))).first() == (0.0, 1.0)
    rules = spark.createDataFrame([(0.4, None), (0.4, 0.5), (0.6, 0.5)], "c double, t double")
    assert [x[0] for x in rules.select(verdict(F.col("c"), F.col("t"))).collect()] == ["never reliable", "abstain", "confident"]


def test_fuzzy_lookup(spark):
    names = spark.createDataFrame([("00001", "Registered nurses"), ("00002", "Cooks")], "code string, name string")
    assert textops.lookup(names, "code", "name", "registred nurse").first().route == "fuzzy"
    assert textops.lookup(names, "code", "name", "1").first().code == "00001"


def test_fold_in_solves_the_normal_equations(spark):
    import numpy as np

    items = [("item", "a", 0.1, [1.0, 0.0]), ("item", "b", 0.0, [0.0, 1.0]), ("mu", "", 2.0, [])]
    model = spark.createDataFrame(items, "side string, key string, bias double, p array<double>")
    prof = spark.createDataFrame([("u", "a", 4.0), ("u", "b", 3.0)], "user string, item string, rating double")
    got = factor.fold_in(model, prof, reg=1.0).first()
    X, y = np.array([[1, 0, 1], [0, 1, 1.0]]), np.array([1.9, 1.0])
    theta = np.array([*got.p, got.bias])
    assert np.allclose((X.T @ X + np.eye(3)) @ theta, X.T @ y)


def test_factor_models_learn(spark):
    rows = [(u, f"i{i}", 5.0 if (u + i) % 2 else 0.0) for u in range(20) for i in range(10) if (u * i) % 7]
    train = spark.createDataFrame(rows, "occ long, item string, rating double")
    s = factor.score_models(train, ["mf"], k=4, epochs=200, lr=0.05, batch=32).join(train, ["occ", "item"]).withColumn("y", (F.col("rating") > 2).cast("int"))
    assert one(ranking.roc_auc(s, "score", "y"))["roc_auc"] > 0.9


def test_regression_audit_query_takes_every_test_order(spark, sf_dir):
    import hashlib

    import numpy as np

    from careerloom.plans import posting_queries as p

    rows = p._predicted(spark, sf_dir).select("region", "o_orderkey", F.col("o_totalprice").cast("double").alias("y"), F.col("pred").cast("double").alias("pred")).toPandas().sort_values("o_orderkey")
    want = {}
    for region, g in rows.groupby("region"):
        if len(g) >= 20:
            e = (g["y"] - g["pred"]).abs().to_numpy()
            means = [e[[int(hashlib.md5(f"42:{b}:{i}".encode()).hexdigest()[:8], 16) % len(e) for i in range(len(e))]].mean() for b in range(100)]
            want[region] = (len(e), e.mean(), *np.percentile(means, [2.5, 97.5]))
    got = {r["group"]: (r["n"], r["metric"], r["lo"], r["hi"]) for r in p.q_grouped_reg_audit(spark, sf_dir).collect()}
    assert sum(n for n, *_ in got.values()) == len(rows) and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)
    worst, best = max(want, key=lambda k: (want[k][1], k)), min(want, key=lambda k: (want[k][1], k))
    found = one(p.q_disparity(spark, sf_dir))
    assert (found["best"], found["worst"]) == (best, worst) and found["gap"] == pytest.approx(want[worst][1] - want[best][1], abs=1e-3)


def test_foldin_query_folds_every_profile(spark, sf_dir):
    from careerloom.plans import model_queries as m

    users = {str(r.occ) for r in m.ratings(spark, sf_dir).where("rating >= 3").select("occ").distinct().collect()}
    items = {r.item for r in m._cells(spark, sf_dir)[0].select("item").distinct().collect()}
    got = [(r.user, r.item) for r in m.q_foldin(spark, sf_dir).collect()]
    assert len(users) > 3 and len(got) == len(set(got)) and set(got) == {(u, i) for u in users for i in items}
