"""Queries over the rating fact: facts, recommenders, gaps and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerloom.functions.columns import band, clip, code_group, tier
from careerloom.operators import ranking, recommend, relational, splits
from careerloom.operators.ordered import dense_ids, row_numbers, terciles
from careerloom.plans.base import RATINGS, Registry, draw_sql, ratings
from careerloom.sources.io import exists, scratch, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query(f"WITH {RATINGS} SELECT item, count(*) AS n, round(avg((rating >= 4)::INT), 6) AS core_share FROM ratings GROUP BY item ORDER BY core_share DESC, item")
def q_core_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of occupations for which each descriptor is core."""
    r = ratings(spark, sf_dir)
    return r.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("rating") >= 4).cast("double")), 6).alias("core_share")).orderBy(F.desc("core_share"), "item")


@query(f"WITH {RATINGS}, ids AS (SELECT item, (row_number() OVER (ORDER BY item) - 1)::INT AS item_id FROM (SELECT DISTINCT item FROM ratings)) SELECT occ, item_id, item, rating FROM ratings JOIN ids USING (item)")
def q_rating_fact(spark, sf_dir):
    """The rating fact with dense descriptor ids."""
    r = ratings(spark, sf_dir)
    return r.join(dense_ids(r, "item", "item_id"), "item").select("occ", "item_id", "item", "rating")


@query(f"WITH {RATINGS} SELECT count(*) AS n, count(DISTINCT occ) AS n_occ, count(DISTINCT item) AS n_item, round(count(*) / (count(DISTINCT occ) * count(DISTINCT item)), 6) AS coverage, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM ratings GROUP BY occ, item)) AS duplicates FROM ratings")
def q_coverage(spark, sf_dir):
    """Size, coverage and duplicate cells."""
    r = ratings(spark, sf_dir)
    size = r.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("occ").alias("n_occ"), F.count_distinct("item").alias("n_item"))
    return size.crossJoin(recommend.coverage(r).select(F.round("coverage", 6).alias("coverage"))).crossJoin(relational.duplicate_count(r, ["occ", "item"]))


@query(f"WITH {RATINGS} SELECT rating, count(*) AS n FROM ratings GROUP BY rating")
def q_rating_hist(spark, sf_dir):
    """A10: frequency of each rating."""
    return relational.counts(ratings(spark, sf_dir), "rating")


@query(f"WITH {RATINGS} SELECT CASE WHEN rating >= 4 THEN 'core' WHEN rating <= 1 THEN 'irrelevant' ELSE 'ambiguous' END AS band, count(*) AS n FROM ratings GROUP BY 1")
def q_ambiguous_band(spark, sf_dir):
    """P9"""
    return ratings(spark, sf_dir).groupBy(band(F.col("rating")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RATINGS} SELECT item, round(avg(rating), 6) AS mean, round(coalesce(stddev_samp(rating), 0), 6) AS std, min(rating) AS lo, max(rating) AS hi, median(rating) AS median FROM ratings GROUP BY item HAVING count(*) >= 3")
def q_item_stats(spark, sf_dir):
    """Spread of each descriptor's ratings, three occupations or more."""
    g = ratings(spark, sf_dir).groupBy("item").agg(
        F.round(F.avg("rating"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("rating"), F.lit(0.0)), 6).alias("std"), F.min("rating").alias("lo"), F.max("rating").alias("hi"), F.median("rating").alias("median"), F.count(F.lit(1)).alias("n")
    )
    return g.where("n >= 3").drop("n")


@query(f"WITH {RATINGS} SELECT occ, item, (rank() OVER (PARTITION BY item ORDER BY rating) - 1)::INT AS n_lower FROM ratings")
def q_n_lower(spark, sf_dir):
    """W10"""
    return relational.n_lower(ratings(spark, sf_dir), "item", "rating").select("occ", "item", F.col("n_lower").cast("int").alias("n_lower"))


_SPLIT = f"""{RATINGS}, split AS (
  SELECT occ, item, rating, CASE WHEN n > 1 AND rn <= floor(n * 0.1 + 0.5) THEN 'test' ELSE 'train' END AS split FROM (
    SELECT *, row_number() OVER (PARTITION BY item ORDER BY {draw_sql("42", "occ", "item")}, occ, item) AS rn, count(*) OVER (PARTITION BY item) AS n FROM ratings)),
train AS (SELECT occ, item, rating FROM split WHERE split = 'train'), test AS (SELECT occ, item, rating FROM split WHERE split = 'test')"""


def _split(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Training and held-out cells, written once: models read the training part several times."""
    s = splits.stratified(ratings(spark, sf_dir), ["occ", "item"], "item")
    path = scratch(spark, "split")
    s.write.partitionBy("split").parquet(path)
    cells = spark.read.schema(s.drop("split").schema)
    return cells.parquet(f"{path}/split=train"), _either(cells, f"{path}/split=test", spark)


def _either(reader, path: str, spark) -> DataFrame:
    """The part at ``path``, or no rows where nothing was held out."""
    return reader.parquet(path) if exists(spark, path) else spark.createDataFrame([], "occ long, item string, rating double")


@query(f"WITH {_SPLIT} SELECT item, split, count(*) AS n, round(avg(rating), 6) AS mean FROM split GROUP BY item, split")
def q_stratified_split(spark, sf_dir):
    """Held-out cells by descriptor."""
    s = splits.stratified(ratings(spark, sf_dir), ["occ", "item"], "item")
    return s.groupBy("item", "split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rating"), 6).alias("mean"))


@query(f"WITH {_SPLIT} SELECT count(*) AS shared FROM train JOIN test USING (occ, item)")
def q_edge_leakage(spark, sf_dir):
    """Shared cells of train and test; 0."""
    train, test = _split(spark, sf_dir)
    return splits.edge_leakage(train, test, ["occ", "item"])


@query(f"WITH {RATINGS} SELECT occ, item, ((row_number() OVER (PARTITION BY rating ORDER BY {draw_sql('42', 'occ', 'item')}, occ, item) - 1) % 5)::INT AS fold FROM ratings")
def q_folds(spark, sf_dir):
    """T4, T13"""
    return splits.folds(ratings(spark, sf_dir), ["occ", "item"], "rating").select("occ", "item", "fold")


_CORE = f"{RATINGS}, core AS (SELECT occ, item FROM ratings WHERE rating >= 4)"
_LOO = f"""{_CORE}, held AS (SELECT occ, item FROM (
  SELECT *, row_number() OVER (PARTITION BY occ ORDER BY {draw_sql("42", "occ", "item")}, occ, item) AS rn, count(*) OVER (PARTITION BY occ) AS n FROM core) WHERE rn = 1 AND n >= 2)"""


@query(f"WITH {_LOO} SELECT * FROM held")
def q_leave_one_out(spark, sf_dir):
    """One hidden core descriptor of each occupation."""
    return splits.leave_one_out(recommend.core_items(ratings(spark, sf_dir)), "occ", "item")


@query(f"WITH {RATINGS} SELECT occ FROM (SELECT DISTINCT occ FROM ratings) ORDER BY {draw_sql('42', 'occ')}, occ LIMIT 10")
def q_cold_entities(spark, sf_dir):
    """Ten occupations removed entirely."""
    return splits.cold_entities(ratings(spark, sf_dir), "occ", 10)


@query(f"WITH {RATINGS} SELECT occ, item, rating FROM (SELECT *, row_number() OVER (PARTITION BY occ ORDER BY rating DESC, item) AS rn FROM ratings) WHERE rn <= 5")
def q_sample_profile(spark, sf_dir):
    """The five top descriptors of each occupation."""
    return relational.sample_profile(ratings(spark, sf_dir), "occ", "item", "rating", 5, "core_first")


@query(f"""WITH {_SPLIT}, d AS (SELECT item, avg(rating) AS s FROM train GROUP BY item), o AS (SELECT occ, avg(rating) AS s FROM train GROUP BY occ), m AS (SELECT avg(rating) AS s FROM train)
SELECT occ, item, round(coalesce(d.s, m.s), 6) AS desc_pop, round(coalesce(o.s, m.s), 6) AS occ_pop FROM test LEFT JOIN d USING (item) LEFT JOIN o USING (occ), m""")
def q_popularity_models(spark, sf_dir):
    """Popularity scores of the held-out cells."""
    train, test = _split(spark, sf_dir)
    d, o = recommend.popularity(train, test, "item"), recommend.popularity(train, test, "occ")
    return d.withColumnRenamed("score", "desc_pop").join(o.withColumnRenamed("score", "occ_pop"), ["occ", "item"]).select("occ", "item", F.round("desc_pop", 6).alias("desc_pop"), F.round("occ_pop", 6).alias("occ_pop"))


@query(f"WITH {_SPLIT} SELECT occ, item, round({draw_sql('42', 'occ', 'item')} / 4294967296.0, 9)::DOUBLE AS score FROM test")
def q_random_scorer(spark, sf_dir):
    """R1"""
    _, test = _split(spark, sf_dir)
    return recommend.random_scores(test).select("occ", "item", F.round("score", 9).alias("score"))


@query(f"""WITH {_CORE}, n AS (SELECT item, count(*) AS score FROM core GROUP BY item), o AS (SELECT DISTINCT occ FROM ratings), c AS (SELECT occ, item, score FROM o, n WHERE (occ, item) NOT IN (SELECT (occ, item) FROM core))
SELECT occ, item, score, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY occ ORDER BY score DESC, item) AS rn FROM c) WHERE rn <= 3""")
def q_most_common_missing(spark, sf_dir):
    """The three most common core descriptors an occupation lacks."""
    r = ratings(spark, sf_dir)
    missing = recommend.most_common_missing(recommend.core_items(r), r.select("occ").distinct())
    return relational.top_per_group(missing, ["occ"], [F.desc("score"), F.col("item")], 3).select("occ", "item", "score", "rank")


_SIM = """sizes AS (SELECT occ, count(*) AS n FROM core GROUP BY occ),
sim AS (SELECT u, v, b::DOUBLE / (su.n + sv.n - b) AS sim FROM (SELECT a.occ AS u, c.occ AS v, count(*) AS b FROM core a JOIN core c USING (item) WHERE a.occ <> c.occ GROUP BY ALL) JOIN sizes su ON su.occ = u JOIN sizes sv ON sv.occ = v)"""


def _near(k: int) -> str:
    return f"near AS (SELECT u, v, sim FROM (SELECT *, rank() OVER (PARTITION BY u ORDER BY sim DESC) AS r FROM sim) WHERE r <= {k})"


_TRAIN_CORE = "core AS (SELECT occ, item FROM train WHERE rating >= 4)"


@query(f"WITH {_CORE}, {_SIM} SELECT u, v, round(sim, 6) AS sim FROM sim")
def q_jaccard_sim(spark, sf_dir):
    """Jaccard similarity of core sets."""
    return recommend.jaccard_similarities(recommend.core_items(ratings(spark, sf_dir)), digits=6)


@query(f"""WITH {_SPLIT}, {_TRAIN_CORE}, {_SIM}, {_near(30)},
votes AS (SELECT t.occ, t.item, sum(sim * r.rating) AS num, sum(sim) AS den FROM test t JOIN near ON u = t.occ JOIN train r ON r.occ = v AND r.item = t.item GROUP BY t.occ, t.item),
d AS (SELECT item, avg(rating) AS s FROM train GROUP BY item), m AS (SELECT avg(rating) AS s FROM train)
SELECT t.occ, t.item, round(CASE WHEN coalesce(den, 0) > 1e-9 THEN num / den ELSE coalesce(d.s, m.s) END, 6) AS score FROM test t LEFT JOIN votes USING (occ, item) LEFT JOIN d USING (item), m""")
def q_jaccard_cf(spark, sf_dir):
    """Neighbour scores of the held-out cells."""
    train, test = _split(spark, sf_dir)
    return recommend.jaccard_cf(train, test).select("occ", "item", F.round("score", 6).alias("score"))


@query(f"""WITH {_SPLIT}, {_TRAIN_CORE}, {_SIM}, {_near(50)}, total AS (SELECT u AS occ, sum(sim) AS den FROM near GROUP BY u),
votes AS (SELECT t.occ, t.item, sum(sim * r.rating) AS num FROM test t JOIN near ON u = t.occ JOIN train r ON r.occ = v AND r.item = t.item GROUP BY t.occ, t.item)
SELECT t.occ, t.item, round(CASE WHEN coalesce(den, 0) > 0 THEN coalesce(num, 0) / den ELSE 0.0 END, 6)::DOUBLE AS score FROM test t LEFT JOIN votes USING (occ, item) LEFT JOIN total USING (occ)""")
def q_jaccard_cf_dense(spark, sf_dir):
    """R5"""
    train, test = _split(spark, sf_dir)
    return recommend.jaccard_cf_dense(train, test).select("occ", "item", F.round("score", 6).alias("score"))


@query(f"WITH {_CORE}, n AS (SELECT item, count(*) AS n FROM core GROUP BY item) SELECT i, j, round(b / sqrt(a.n::DOUBLE * c.n), 6) AS sim FROM (SELECT x.item AS i, y.item AS j, count(*) AS b FROM core x JOIN core y USING (occ) WHERE x.item <> y.item GROUP BY ALL) JOIN n a ON a.item = i JOIN n c ON c.item = j")
def q_item_cosine(spark, sf_dir):
    """R24"""
    return recommend.item_cosine(recommend.core_items(ratings(spark, sf_dir))).select("i", "j", F.round("sim", 6).alias("sim"))


@query(f"""WITH {_CORE}, n AS (SELECT item, count(*) AS n FROM core GROUP BY item),
sim AS (SELECT i, j, b / sqrt(a.n::DOUBLE * c.n) AS sim FROM (SELECT x.item AS i, y.item AS j, count(*) AS b FROM core x JOIN core y USING (occ) WHERE x.item <> y.item GROUP BY ALL) JOIN n a ON a.item = i JOIN n c ON c.item = j),
k AS (SELECT occ, count(*) AS n FROM core GROUP BY occ)
SELECT s.occ, s.item, round(total / k.n, 6) AS score FROM (SELECT occ, i AS item, sum(sim) AS total FROM core JOIN sim ON j = core.item GROUP BY ALL) s JOIN k USING (occ) WHERE (s.occ, s.item) NOT IN (SELECT (occ, item) FROM core)""")
def q_item_cf(spark, sf_dir):
    """Mean similarity of candidates to the known core."""
    r = ratings(spark, sf_dir)
    return recommend.item_cf(recommend.core_items(r), r.select("occ").distinct()).select("occ", "item", F.round("score", 6).alias("score"))


_PROFILE = "profile AS (SELECT item, rating AS y FROM ratings WHERE occ = 1)"


@query(f"""WITH {RATINGS}, {_PROFILE}, s AS (SELECT occ, count(*)::DOUBLE AS n, sum(rating) AS sx, sum(y) AS sy, sum(rating * y) AS sxy, sum(rating * rating) AS sxx, sum(y * y) AS syy FROM ratings JOIN profile USING (item) GROUP BY occ)
SELECT occ, round(CASE WHEN sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy) > 1e-9 THEN (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) ELSE 0 END, 6)::DOUBLE AS score FROM s""")
def q_pearson_rows(spark, sf_dir):
    """Correlation of every occupation with occupation 1."""
    r = ratings(spark, sf_dir)
    return recommend.pearson_with(r, r.where("occ = 1").select("item", "rating")).select("occ", F.round("score", 6).alias("score"))


@query(f"WITH {RATINGS}, {_PROFILE} SELECT occ, round(-sqrt(avg((rating - y) * (rating - y))), 6) + 0.0 AS score FROM ratings JOIN profile USING (item) GROUP BY occ")
def q_raw_distance(spark, sf_dir):
    """R15"""
    r = ratings(spark, sf_dir)
    return recommend.negative_rmse(r, r.where("occ = 1").select("item", "rating")).select("occ", (F.round("score", 6) + 0.0).alias("score"))


@query("""SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))), 6) AS score
FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0""")
def q_latent_cosine(spark, sf_dir):
    """Cosine of every vector whose id is divisible by 50 with all others."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return recommend.latent_cosine(v, v.where("id % 50 = 0"), "embedding").select("query_id", "id", F.round("score", 6).alias("score"))


_GRADED = f"{_SPLIT}, d AS (SELECT occ, avg(rating) AS s FROM train GROUP BY occ), scored AS (SELECT t.occ, t.item, t.rating, round(d.s, 9) AS score, (t.rating >= 4)::INT AS rel FROM test t JOIN d USING (occ))"
_RANKED = """r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, occ) AS rk, row_number() OVER (PARTITION BY item ORDER BY rating DESC, occ) AS ik FROM scored),
g AS (SELECT item, count(*) AS n, sum(rel) AS n_relevant, coalesce(1.0 / min(CASE WHEN rel = 1 THEN rk END), 0)::DOUBLE AS mrr,
  sum(CASE WHEN rk <= 5 THEN rel ELSE 0 END) / least(5, count(*)) AS p_5, sum(CASE WHEN rk <= 5 THEN rel ELSE 0 END) / nullif(sum(rel), 0) AS recall_5,
  sum(CASE WHEN rk <= 5 THEN (2 ** rating - 1) / log2(rk + 1.0) ELSE 0 END) / nullif(sum(CASE WHEN ik <= 5 THEN (2 ** rating - 1) / log2(ik + 1.0) ELSE 0 END), 0) AS ndcg_5 FROM r GROUP BY item)"""


def _scored(spark, sf_dir) -> DataFrame:
    train, test = _split(spark, sf_dir)
    s = recommend.popularity(train, test, "occ")
    return test.join(s, ["occ", "item"]).select("occ", "item", "rating", F.round("score", 9).alias("score"), (F.col("rating") >= 4).cast("int").alias("rel"))


@query(f"WITH {_GRADED}, {_RANKED} SELECT item, n, n_relevant::BIGINT AS n_relevant, round(mrr, 6) AS mrr, round(p_5, 6) AS p_5, round(recall_5, 6) AS recall_5, round(ndcg_5, 6) AS ndcg_5 FROM g")
def q_ranking_metrics(spark, sf_dir):
    """Metrics of every descriptor's ranking of held-out occupations."""
    g = ranking.per_group(_scored(spark, sf_dir), "item", "occ", "score", "rel", "rating", ks=(5,))
    return g.select("item", "n", "n_relevant", *[F.round(c, 6).alias(c) for c in ("mrr", "p_5", "recall_5", "ndcg_5")])


@query(f"WITH {_GRADED}, {_RANKED} SELECT round(avg(mrr) FILTER (n_relevant > 0), 6) AS mrr, round(avg(p_5) FILTER (n_relevant > 0), 6) AS p_5, round(avg(recall_5) FILTER (n_relevant > 0), 6) AS recall_5, round(avg(ndcg_5) FILTER (n_relevant > 0), 6) AS ndcg_5, count(*) FILTER (n_relevant > 0) AS n_queries, round(avg(n), 6) AS mean_candidates FROM g")
def q_ranking_report(spark, sf_dir):
    """E5, A26"""
    g = ranking.per_group(_scored(spark, sf_dir), "item", "occ", "score", "rel", "rating", ks=(5,))
    out = ranking.report(g, ks=(5,))
    return out.select(*[F.round(c, 6).alias(c) for c in ("mrr", "p_5", "recall_5", "ndcg_5")], "n_queries", F.round("mean_candidates", 6).alias("mean_candidates"))


_POOLED = f"{_GRADED}, pooled AS (SELECT score, rel FROM scored WHERE rating >= 4 OR rating <= 1)"


@query(f"WITH {_POOLED}, k AS (SELECT rel, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM pooled) SELECT round((sum(r) FILTER (rel = 1) - count(*) FILTER (rel = 1) * (count(*) FILTER (rel = 1) + 1) / 2.0) / (count(*) FILTER (rel = 1) * count(*) FILTER (rel = 0)), 6)::DOUBLE AS roc_auc FROM k")
def q_roc_auc(spark, sf_dir):
    """Pooled AUC over core and irrelevant cells."""
    return ranking.roc_auc(_scored(spark, sf_dir).where("rating >= 4 or rating <= 1"), "score", "rel").select(F.round("roc_auc", 6).alias("roc_auc"))


@query(f"WITH {_POOLED}, b AS (SELECT score, sum(rel) AS p, count(*) AS n FROM pooled GROUP BY score), c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS t FROM b) SELECT round(sum(p * tp / t) / sum(p), 6) AS pr_auc FROM c")
def q_pr_auc(spark, sf_dir):
    """E6"""
    return ranking.pr_auc(_scored(spark, sf_dir).where("rating >= 4 or rating <= 1"), "score", "rel").select(F.round("pr_auc", 6).alias("pr_auc"))


@query(f"WITH {_GRADED} SELECT item, round(avg(rel), 6) AS chance FROM scored GROUP BY item")
def q_chance(spark, sf_dir):
    """E16"""
    return ranking.chance(_scored(spark, sf_dir), "item", "rel").select("item", F.round("chance", 6).alias("chance"))


@query(f"WITH {_GRADED} SELECT o.occ, t.item, coalesce(s.rating, 0) AS graded, coalesce((s.rating >= 4)::INT, 0) AS relevant, coalesce(s.rating < 4 AND s.rating > 1, false) AS masked FROM (SELECT DISTINCT occ FROM ratings) o CROSS JOIN (SELECT DISTINCT item FROM ratings) t LEFT JOIN test s ON s.occ = o.occ AND s.item = t.item WHERE (o.occ, t.item) NOT IN (SELECT (occ, item) FROM train)")
def q_query_sets(spark, sf_dir):
    """Candidates of each occupation with binary and graded relevance."""
    train, test = _split(spark, sf_dir)
    r = ratings(spark, sf_dir)
    c = relational.candidates(r.select("occ").distinct(), r.select("item").distinct(), train, ["occ", "item"])
    return splits.query_sets(test, c, ["occ", "item"]).select("occ", "item", "graded", "relevant", "masked")


@query(f"WITH {_CORE}, n AS (SELECT item, count(*) AS n_core FROM core GROUP BY item) SELECT item, n_core, round(n_core / max(n_core) OVER (), 6) AS leverage FROM n")
def q_leverage(spark, sf_dir):
    """A22"""
    return relational.leverage(recommend.core_items(ratings(spark, sf_dir)), "item").select("item", "n_core", F.round("leverage", 6).alias("leverage"))


_GAP = f"""{_CORE}, lev AS (SELECT item, count(*) / (SELECT max(n) FROM (SELECT count(*) AS n FROM core GROUP BY item)) AS leverage FROM core GROUP BY item),
need AS (SELECT item, rating AS need FROM ratings WHERE occ = 2 AND rating >= 4), level AS (SELECT item, rating AS level FROM ratings WHERE occ = 1)"""


@query(f"WITH {_GAP} SELECT item, need, level, round(need - level, 6) AS gap, round(need - level + 0.5 * coalesce(leverage, 0), 6) AS score FROM need JOIN level USING (item) LEFT JOIN lev USING (item) WHERE item NOT IN (SELECT item FROM core WHERE occ = 1) ORDER BY score DESC, item LIMIT 5")
def q_gap_ranking(spark, sf_dir):
    """What occupation 1 lacks for occupation 2."""
    r = ratings(spark, sf_dir)
    core = recommend.core_items(r)
    scores = r.withColumnRenamed("rating", "score")
    out = recommend.gap_ranking(scores, 1, 2, core.where("occ = 1"), relational.leverage(core, "item"))
    return out.select("item", "need", "level", F.round("gap", 6).alias("gap"), F.round("score", 6).alias("score"))


@query(f"""WITH {RATINGS}, demand AS (SELECT occ, item, CASE WHEN {draw_sql('obs', 'occ', 'item')} % 3 = 0 THEN 0.5 ELSE rating END AS demand FROM ratings), lev AS (SELECT item, count(*) AS n FROM demand WHERE demand >= 1 GROUP BY item),
mean AS (SELECT item, avg(rating) AS mean FROM ratings GROUP BY item),
f AS (SELECT m.item, m.rating AS model, d.demand AS obs, mean, coalesce(l.n / (SELECT max(n) FROM lev), 0) AS leverage, h.rating * 0.5 AS have FROM ratings m JOIN demand d USING (occ, item) JOIN mean USING (item) LEFT JOIN lev l USING (item) JOIN ratings h ON h.item = m.item AND h.occ = 1 WHERE m.occ = 2),
n AS (SELECT *, obs < 1 AND model >= 2 AND model - mean >= 0.5 AS filled FROM f), k AS (SELECT item, CASE WHEN filled THEN 'model' ELSE 'data' END AS source, CASE WHEN filled THEN model ELSE obs END AS need, have, leverage FROM n)
SELECT item, source, need, round(need - have + 0.3 * leverage, 6) AS score FROM k WHERE need >= 1.5 AND have < need AND item <> 'Brand#11' ORDER BY score DESC, item LIMIT 8""")
def q_market_gap(spark, sf_dir):
    """Hybrid gap with model backfill."""
    from careerloom.functions.draws import draw

    r = ratings(spark, sf_dir)
    demand = r.select("occ", "item", F.when(draw("occ", "item", salt="obs") % 3 == 0, 0.5).otherwise(F.col("rating")).alias("demand"))
    mean = r.groupBy("item").agg(F.avg("rating").alias("mean"))
    own = r.where("occ = 1").select("item", (F.col("rating") * 0.5).alias("have"))
    excluded = spark.createDataFrame([("Brand#11",)], "item string")
    out = recommend.market_gap(demand.where("occ = 2"), r.where("occ = 2").withColumnRenamed("rating", "score"), mean, own, excluded, recommend.market_leverage(demand))
    return out.select("item", "source", "need", F.round("score", 6).alias("score"))


@query(f"WITH {RATINGS}, t AS (SELECT occ, avg(rating) AS m, avg(CASE WHEN item IN ('Brand#11', 'Brand#12', 'Brand#13') THEN rating END) AS raw FROM ratings GROUP BY occ) SELECT occ, round(raw, 6) AS raw, round(raw - m, 6) + 0.0 AS centred FROM t")
def q_level_and_fit(spark, sf_dir):
    """R13, R19"""
    profile = spark.createDataFrame([("Brand#11",), ("Brand#12",), ("Brand#13",)], "item string")
    out = recommend.level_and_fit(ratings(spark, sf_dir).withColumnRenamed("rating", "score"), profile)
    return out.select("occ", F.round("raw", 6).alias("raw"), (F.round("centred", 6) + 0.0).alias("centred"))


@query(f"WITH {RATINGS}, m AS (SELECT occ, avg(rating) AS mean FROM ratings GROUP BY occ) SELECT occ, round(mean, 6) AS mean, row_number() OVER (ORDER BY round(mean, 6) DESC, occ) AS rank FROM m")
def q_occupation_rank(spark, sf_dir):
    """National rank of each occupation by mean rating, without a single-task sort."""
    m = ratings(spark, sf_dir).groupBy("occ").agg(F.round(F.avg("rating"), 6).alias("mean"))
    return row_numbers(m, [F.col("mean").desc(), F.col("occ")], "rank")


@query(f"WITH {RATINGS}, c AS (SELECT occ, sum(rating) AS n FROM ratings GROUP BY occ), r AS (SELECT *, row_number() OVER (ORDER BY n, occ) AS rn, count(*) OVER () AS t FROM c) SELECT occ, n, CASE WHEN 3 * (rn - 1) <= t - 1 THEN 'low' WHEN 3 * (rn - 1) <= 2 * (t - 1) THEN 'medium' ELSE 'high' END AS pop_tier FROM r")
def q_pop_tier(spark, sf_dir):
    """W9"""
    c = ratings(spark, sf_dir).groupBy("occ").agg(F.sum("rating").alias("n"))
    return terciles(c, [F.col("n"), F.col("occ")])


@query(f"WITH {RATINGS} SELECT occ, least(greatest(sum(rating) / 10 - 5, 0), 5) AS clipped, substr(lpad(occ::VARCHAR, 5, '0'), 2, 1) AS tier, substr(lpad(occ::VARCHAR, 5, '0'), 1, 2) AS grp FROM ratings GROUP BY occ")
def q_codes(spark, sf_dir):
    """Padded codes, hierarchy group, tier digit and clipping."""
    s = ratings(spark, sf_dir).groupBy("occ").agg(F.sum("rating").alias("s"))
    code = F.lpad(F.col("occ").cast("string"), 5, "0")
    return s.select("occ", clip(F.col("s") / 10 - 5).alias("clipped"), tier(code).alias("tier"), code_group(code, 2).alias("grp"))


