"""Queries over postings: cleaning, reposts, splits, baselines, volumes, audits and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from careerloom.functions.columns import direction, recode, verdict
from careerloom.functions.draws import draw
from careerloom.operators import export, metrics, ranking, relational, splits, trust
from careerloom.operators.ordered import terciles
from careerloom.plans.base import CUTOFF, POSTINGS, Registry, draw_sql, postings
from careerloom.schemas import BOOTSTRAP
from careerloom.sources.io import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

#: The priorities of the order table, the stand-in for months of a snapshot.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 1000 AND 5000 AND length(c_mktsegment) = 9")
def q_clean_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range and length filters, pushed to the scan."""
    return relational.exact_length(relational.within(table(spark, sf_dir, "customer"), "c_acctbal", 1000, 5000), "c_mktsegment", 9).select("c_custkey", "c_acctbal")


@query("SELECT event_type, count(*) AS n, round(sum(ln(1 + value::DECIMAL(18,6)::DOUBLE)), 4) AS log_sum FROM events WHERE event_type IS NOT NULL AND trim(lower(event_type)) NOT IN ('', 'nan', 'none') AND value IS NOT NULL AND value > -1 GROUP BY event_type")
def q_junk_and_log(spark, sf_dir):
    """Junk tokens and nulls dropped, log1p."""
    e = relational.without_junk(table(spark, sf_dir, "events"), "event_type").na.drop(subset=["value"]).where("value > -1")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.log1p(F.col("value").cast("decimal(18,6)").cast("double"))), 4).alias("log_sum"))


@query("WITH x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS bal FROM supplier), m AS (SELECT median(bal) AS m FROM x) SELECT s_suppkey, round(coalesce(bal, m), 6) AS bal FROM x, m")
def q_median_fill(spark, sf_dir):
    """P5, P6"""
    x = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("bal"))
    return relational.fill_median(x, ["bal"]).select("s_suppkey", F.round("bal", 6).alias("bal"))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'other' END AS status, count(*) AS n FROM orders GROUP BY 1")
def q_recode(spark, sf_dir):
    """P7"""
    return table(spark, sf_dir, "orders").groupBy(recode(F.col("o_orderstatus"), {"F": "filled", "O": "open"}, F.lit("other")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def q_anti_join(spark, sf_dir):
    """Customers without an order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return relational.member(table(spark, sf_dir, "customer"), o, ["c_custkey"], inside=False).select("c_custkey")


@query("SELECT p_partkey, 'size' AS variable, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def q_melt_part(spark, sf_dir):
    """A14, U1"""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return relational.melt(p, ["p_partkey"], ["size", "price"], "variable", "value")


_PIVOT = ", ".join(f"round(avg(p_size) FILTER (p_type = '{t}'), 6) AS \"{t}\"" for t in TYPES)


@query(f"SELECT p_brand, {_PIVOT} FROM part GROUP BY p_brand")
def q_pivot_category(spark, sf_dir):
    """Mean size by brand and type."""
    out = relational.pivot_mean(table(spark, sf_dir, "part"), "p_brand", "p_type", TYPES, "p_size")
    return out.select("p_brand", *[F.round(F.col(f"`{t}`"), 6).alias(t) for t in TYPES])


_MONTHS = ", ".join(f"count(*) FILTER (month(o_orderdate) = {m}) AS m{m}" for m in range(1, 5))


@query(f"WITH {POSTINGS} SELECT code, o_orderpriority, {_MONTHS} FROM postings WHERE year(o_orderdate) = 1997 AND month(o_orderdate) <= 4 GROUP BY code, o_orderpriority")
def q_pivot_month(spark, sf_dir):
    """Postings by nation, priority and month."""
    return _volume(spark, sf_dir)


def _volume(spark, sf_dir) -> DataFrame:
    p = postings(spark, sf_dir).where((F.year("o_orderdate") == 1997) & (F.month("o_orderdate") <= 4))
    return relational.pivot_count(p.withColumn("m", F.concat(F.lit("m"), F.month("o_orderdate").cast("string"))), ["code", "o_orderpriority"], "m", [f"m{m}" for m in range(1, 5)])


@query(f"""WITH {POSTINGS}, v AS (SELECT code, o_orderpriority, {_MONTHS} FROM postings WHERE year(o_orderdate) = 1997 AND month(o_orderdate) <= 4 GROUP BY ALL)
SELECT 'persistence' AS model, round(avg(abs(m4 - m3)), 6) AS mae, round(sqrt(avg((m4 - m3) * (m4 - m3))), 6) AS rmse, count(*) AS n FROM v UNION ALL
SELECT 'mean_of_3', round(avg(abs(m4 - (m1 + m2 + m3) / 3)), 6), round(sqrt(avg((m4 - (m1 + m2 + m3) / 3) * (m4 - (m1 + m2 + m3) / 3))), 6), count(*) FROM v""")
def q_volume_baselines(spark, sf_dir):
    """Persistence and mean of three months against the fourth."""
    v = _volume(spark, sf_dir).withColumn("mean3", relational.row_mean(["m1", "m2", "m3"]))
    one = lambda name, c: metrics.regression_report(v, "m4", c).select(F.lit(name).alias("model"), F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), "n")
    return one("persistence", "m3").unionByName(one("mean_of_3", "mean3"))


@query("SELECT l_partkey, l_suppkey, l_quantity, l_shipdate, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_quantity ORDER BY l_shipdate NULLS LAST, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def q_dedup_earliest(spark, sf_dir):
    """The earliest line of each identity."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_orderkey", "l_linenumber")
    return relational.keep_first(li, ["l_partkey", "l_suppkey", "l_quantity"], [F.col("l_shipdate").asc_nulls_last(), F.col("l_orderkey"), F.col("l_linenumber")])


@query(f"SELECT CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' THEN 'train' ELSE 'test' END AS split, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def q_temporal_split_stats(spark, sf_dir):
    """T5, F23"""
    s = splits.temporal(table(spark, sf_dir, "orders"), "o_orderdate", CUTOFF)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query(f"""WITH s AS (SELECT o_custkey, o_orderdate, CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' THEN 'train' ELSE 'test' END AS split FROM orders)
SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM s WHERE split = 'train' INTERSECT SELECT DISTINCT o_custkey FROM s WHERE split = 'test')) AS shared, max(CASE WHEN split = 'train' THEN o_orderdate END) < min(CASE WHEN split = 'test' THEN o_orderdate END) AS sound FROM s""")
def q_leakage_checks(spark, sf_dir):
    """Shared customers and the order of time."""
    s = splits.temporal(table(spark, sf_dir, "orders"), "o_orderdate", CUTOFF)
    return splits.edge_leakage(s.where("split = 'train'"), s.where("split = 'test'"), ["o_custkey"]).crossJoin(splits.temporal_leakage(s, "o_orderdate"))


@query(f"WITH {POSTINGS} SELECT CASE WHEN region IN ('ASIA') THEN 'test' ELSE 'train' END AS split, region, count(*) AS n FROM postings GROUP BY ALL")
def q_region_split(spark, sf_dir):
    """T6"""
    return splits.by_region(postings(spark, sf_dir), "region", ["ASIA"]).groupBy("split", "region").agg(F.count(F.lit(1)).alias("n"))


_BASE = f"""{POSTINGS}, train AS (SELECT * FROM postings WHERE o_orderdate < TIMESTAMP '{CUTOFF}'), test AS (SELECT * FROM postings WHERE o_orderdate >= TIMESTAMP '{CUTOFF}'),
g AS (SELECT code, o_orderpriority, avg(o_totalprice) AS p FROM train GROUP BY ALL), a AS (SELECT avg(o_totalprice) AS p FROM train),
pred AS (SELECT t.*, coalesce(g.p, a.p) AS pred FROM test t LEFT JOIN g USING (code, o_orderpriority), a)"""


def _predicted(spark, sf_dir) -> DataFrame:
    s = splits.temporal(postings(spark, sf_dir), "o_orderdate", CUTOFF)
    return relational.mean_lookup(s.where("split = 'train'"), s.where("split = 'test'"), ["code", "o_orderpriority"], "o_totalprice")


@query(f"WITH {_BASE} SELECT round(avg(abs(o_totalprice - pred)), 4) AS mae, round(sqrt(avg((o_totalprice - pred) ** 2)), 4) AS rmse, round(1 - sum((o_totalprice - pred) ** 2) / (sum(o_totalprice ** 2) - sum(o_totalprice) ** 2 / count(*)), 6) AS r2, round(avg(abs((o_totalprice - pred) / o_totalprice)) FILTER (o_totalprice <> 0), 6) AS mape, count(*) AS n FROM pred")
def q_group_mean_baseline(spark, sf_dir):
    """Group mean of the training postings with a global fallback."""
    r = metrics.regression_report(_predicted(spark, sf_dir), "o_totalprice", "pred")
    return r.select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"), F.round("mape", 6).alias("mape"), "n")


@query(f"WITH t AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '{CUTOFF}' GROUP BY 1) SELECT o_orderkey, coalesce(n, 0) AS freq FROM orders o LEFT JOIN t USING (o_custkey) WHERE o_orderdate >= TIMESTAMP '{CUTOFF}'")
def q_freq_encoding(spark, sf_dir):
    """A11, J1"""
    s = splits.temporal(table(spark, sf_dir, "orders"), "o_orderdate", CUTOFF)
    return relational.frequency_encoding(s.where("split = 'train'"), s.where("split = 'test'"), "o_custkey", "freq").select("o_orderkey", "freq")


@query(f"WITH {POSTINGS}, c AS (SELECT code, o_orderpriority AS v, count(*) AS n FROM postings GROUP BY ALL) SELECT code, first(v ORDER BY n DESC, v) AS mode FROM c GROUP BY code")
def q_mode_profile(spark, sf_dir):
    """A12, M20, L15 shape: the most frequent priority of each nation."""
    return relational.lowest_mode(postings(spark, sf_dir), ["code"], "o_orderpriority")


@query(f"WITH {POSTINGS} SELECT code, o_orderpriority, round_even(median(o_totalprice), 0) AS predicted, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM postings GROUP BY ALL HAVING count(*) >= 3")
def q_salary_stats_having(spark, sf_dir):
    """A5: named aggregates with a size screen."""
    g = postings(spark, sf_dir).groupBy("code", "o_orderpriority").agg(F.bround(F.median("o_totalprice"), 0).alias("predicted"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.count(F.lit(1)).alias("n"))
    return g.where("n >= 3")


_CARD = f"""{POSTINGS}, m AS (SELECT code, year(o_orderdate) AS y, avg(o_totalprice) AS a FROM postings GROUP BY ALL),
c AS (SELECT code, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS top, count(*) AS n FROM postings GROUP BY code)"""


@query(f"WITH {_CARD} SELECT code, mean, top, n, row_number() OVER (ORDER BY mean DESC, code) AS rank, n < 600 AS small_sample FROM c")
def q_rank_card(spark, sf_dir):
    """Occupation card with national rank and a small-sample flag."""
    from careerloom.operators.ordered import row_numbers

    c = postings(spark, sf_dir).groupBy("code").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.max("o_totalprice").alias("top"), F.count(F.lit(1)).alias("n"))
    return row_numbers(c, [F.col("mean").desc(), F.col("code")], "rank").withColumn("small_sample", F.col("n") < 600)


@query(f"WITH {_CARD}, f AS (SELECT code, first(a ORDER BY y) AS a1, last(a ORDER BY y) AS a2, string_agg(y::VARCHAR, '>' ORDER BY y) AS path FROM m GROUP BY code) SELECT code, path, CASE WHEN a2 > a1 THEN 'up' WHEN a2 < a1 THEN 'down' ELSE 'flat' END AS trend FROM f")
def q_trend(spark, sf_dir):
    """W3, P14, A13"""
    m = postings(spark, sf_dir).groupBy("code", F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("a"))
    g = m.groupBy("code").agg(F.min_by("a", "y").alias("a1"), F.max_by("a", "y").alias("a2"), F.array_join(F.transform(F.sort_array(F.collect_list("y")), lambda y: y.cast("string")), ">").alias("path"))
    return g.select("code", "path", direction(F.col("a1"), F.col("a2")).alias("trend"))


@query(f"WITH {_CARD} SELECT a.code AS code_a, b.code AS code_b, round(a.mean - b.mean, 4) AS mean_gap, a.n - b.n AS n_gap FROM c a, c b WHERE a.code = '00001' AND b.code = '00002'")
def q_compare(spark, sf_dir):
    """Two occupations side by side."""
    c = postings(spark, sf_dir).where(F.col("code").isin("00001", "00002")).groupBy("code").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.count(F.lit(1)).alias("n"))
    a, b = c.where("code = '00001'").select(F.col("code").alias("code_a"), F.col("mean").alias("ma"), F.col("n").alias("na")), c.where("code = '00002'").select(F.col("code").alias("code_b"), F.col("mean").alias("mb"), F.col("n").alias("nb"))
    return a.crossJoin(F.broadcast(b)).select("code_a", "code_b", F.round(F.col("ma") - F.col("mb"), 4).alias("mean_gap"), (F.col("na") - F.col("nb")).alias("n_gap"))


@query(f"WITH {POSTINGS} SELECT region, status, priority FROM (SELECT DISTINCT region FROM postings), (SELECT DISTINCT o_orderstatus AS status FROM orders), (SELECT DISTINCT o_orderpriority AS priority FROM orders)")
def q_cross_grid(spark, sf_dir):
    """J9, L14 shape: every combination of three small dimensions."""
    o = table(spark, sf_dir, "orders")
    return relational.grid(table(spark, sf_dir, "region").select(F.col("r_name").alias("region")), o.select(F.col("o_orderstatus").alias("status")), o.select(F.col("o_orderpriority").alias("priority")))


@query(f"WITH {POSTINGS}, c AS (SELECT region, count(*) AS n, round(avg(o_totalprice), 4) AS m FROM postings GROUP BY region) SELECT first(region ORDER BY m DESC, region) AS best, first(region ORDER BY m, region) AS worst FROM c")
def q_best_worst(spark, sf_dir):
    """W8, L10"""
    c = postings(spark, sf_dir).groupBy(F.col("region").alias("group")).agg(F.round(F.avg("o_totalprice"), 4).alias("m"))
    return relational.best_and_worst(c, "group", "m")


# Classifier truth and hash scores over labels.
_LABELS = f"""lab AS (SELECT doc_id, quality, lang, {draw_sql("conf", "doc_id")} % 1000 / 1000.0::DOUBLE AS conf, CASE WHEN {draw_sql("pred", "doc_id")} % 10 < 7 THEN quality ELSE 1 - quality END AS pred FROM (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) JOIN documents USING (doc_id))"""


def _labels(spark, sf_dir) -> DataFrame:
    lab = table(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    d = lab.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    pred = F.when(draw("doc_id", salt="pred") % 10 < 7, F.col("quality")).otherwise(1 - F.col("quality"))
    return d.withColumns({"conf": (draw("doc_id", salt="conf") % 1000) / 1000.0, "pred": pred})


@query(f"WITH {_LABELS} SELECT quality, pred, count(*) AS n FROM lab GROUP BY ALL")
def q_confusion(spark, sf_dir):
    """E7"""
    return metrics.confusion(_labels(spark, sf_dir), "quality", "pred")


@query(f"""WITH {_LABELS}, t AS (SELECT quality AS l, count(*) AS s, count(*) FILTER (quality = pred) AS tp FROM lab GROUP BY 1), p AS (SELECT pred AS l, count(*) AS n FROM lab GROUP BY 1),
f AS (SELECT s, tp, 2.0 * tp / (s + n) AS f1 FROM t JOIN p USING (l)) SELECT round(sum(tp) / sum(s), 6)::DOUBLE AS accuracy, round(avg(f1), 6)::DOUBLE AS macro_f1, round(sum(f1 * s) / sum(s), 6)::DOUBLE AS weighted_f1, sum(s)::BIGINT AS n, (SELECT round(max(s) / sum(s), 6)::DOUBLE FROM t) AS majority_accuracy FROM f""")
def q_classification_report(spark, sf_dir):
    """E7, E26"""
    d = _labels(spark, sf_dir)
    r = metrics.classification_report(d, "quality", "pred").select(*[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")], "n")
    return r.crossJoin(metrics.majority_floor(d, "quality").select(F.round("majority_accuracy", 6).alias("majority_accuracy")))


_BINS = f"{_LABELS}, b AS (SELECT CASE WHEN conf > 0 THEN ceil(conf * 10)::INT END AS bin, count(*) AS n, avg(conf) AS c, avg((quality = pred)::INT) AS a FROM lab GROUP BY 1)"


def _correct(spark, sf_dir) -> DataFrame:
    return _labels(spark, sf_dir).withColumn("ok", (F.col("quality") == F.col("pred")))


@query(f"WITH {_BINS} SELECT round(sum(n / (SELECT count(*) FROM lab) * abs(a - c)), 6) AS ece FROM b WHERE bin IS NOT NULL")
def q_ece(spark, sf_dir):
    """E9, A24"""
    return metrics.ece(_correct(spark, sf_dir), "conf", "ok").select(F.round("ece", 6).alias("ece"))


@query(f"WITH {_BINS} SELECT r.i::INT AS bin, coalesce(n, 0) AS n, round(c, 6) AS confidence, round(a, 6) AS accuracy FROM range(1, 11) AS r(i) LEFT JOIN b ON b.bin = r.i")
def q_reliability(spark, sf_dir):
    """E11"""
    return metrics.reliability(_correct(spark, sf_dir), "conf", "ok").select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {_LABELS} SELECT round(avg(((1 - conf) - (quality = 0)::INT) ** 2 + (conf - (quality = 1)::INT) ** 2), 6) AS brier FROM lab")
def q_brier(spark, sf_dir):
    """E10, F27"""
    return metrics.brier(_labels(spark, sf_dir).withColumn("p", F.array(1 - F.col("conf"), F.col("conf"))), "p", "quality").select(F.round("brier", 6).alias("brier"))


_LEARN = f"""{_LABELS}, s AS (SELECT pred AS label, t, count(*) AS n, count(*) FILTER (quality = pred) AS k FROM lab, range(30, 96) AS g(t) WHERE conf * 100 + 1e-9 >= t GROUP BY ALL), ok AS (SELECT * FROM s WHERE n >= 15 AND k >= 0.5 * n),
f AS (SELECT label, min(t) AS t FROM ok GROUP BY label), rules AS (SELECT l.label, f.t / 100.0 AS threshold, k / n AS precision, n AS support FROM (SELECT DISTINCT pred AS label FROM lab) l LEFT JOIN f USING (label) LEFT JOIN ok ON ok.label = l.label AND ok.t = f.t)"""


@query(f"WITH {_LEARN} SELECT label, round(threshold, 6)::DOUBLE AS threshold, round(precision, 6)::DOUBLE AS precision, coalesce(support, 0) AS support FROM rules")
def q_threshold_learn(spark, sf_dir):
    """E18"""
    out = metrics.learn_thresholds(_correct(spark, sf_dir), "pred", "conf", "ok")
    return out.select("label", F.round("threshold", 6).alias("threshold"), F.round("precision", 6).alias("precision"), F.coalesce("support", F.lit(0)).alias("support"))


@query(f"WITH {_LEARN} SELECT doc_id, CASE WHEN threshold IS NULL THEN 'never reliable' WHEN conf < threshold THEN 'abstain' ELSE 'confident' END AS verdict FROM lab LEFT JOIN rules ON label = pred")
def q_verdict(spark, sf_dir):
    """Confident, abstaining or never reliable."""
    d = _correct(spark, sf_dir)
    rules = metrics.learn_thresholds(d, "pred", "conf", "ok").select(F.col("label").alias("pred"), "threshold")
    return d.join(rules, "pred", "left").select("doc_id", verdict(F.col("conf"), F.col("threshold")).alias("verdict"))


_GRID = [0.1 * i for i in range(1, 10)]


@query(f"""WITH {_LABELS}, g AS (SELECT lang AS label, t, 2.0 * count(*) FILTER (conf > t AND quality = 1) AS a, count(*) FILTER (conf > t) + count(*) FILTER (quality = 1) AS b FROM lab, (SELECT unnest([{", ".join(f"({g!r})::DOUBLE" for g in _GRID)}]) AS t) GROUP BY ALL),
f AS (SELECT label, t, CASE WHEN b > 0 THEN a / b ELSE 0 END AS f1 FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, t) AS rn FROM f)
SELECT label, round(CASE WHEN f1 = 0 THEN 0.5 ELSE t END, 6)::DOUBLE AS threshold, round(f1, 6)::DOUBLE AS f1 FROM k WHERE rn = 1""")
def q_threshold_tune(spark, sf_dir):
    """E19"""
    out = metrics.tune_thresholds(_labels(spark, sf_dir), "lang", "conf", "quality", _GRID)
    return out.select(F.col("lang").alias("label"), F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1"))


def _boot_sql(source: str, by: str, key: str, value: str, draws: int) -> str:
    return f"""o AS (SELECT {by} AS g, {key} AS k, ({value})::DOUBLE AS v, row_number() OVER (PARTITION BY {by} ORDER BY {key}) - 1 AS pos FROM {source} WHERE ({value}) IS NOT NULL),
z AS (SELECT g, count(*) AS n, avg(v) AS mean FROM o GROUP BY g),
picks AS (SELECT o.g, b, {draw_sql("42", "b", "o.pos")} % z.n AS pos FROM o JOIN z USING (g), range({draws}) AS r(b)),
reps AS (SELECT p.g, b, avg(v) AS m FROM picks p JOIN o ON o.g = p.g AND o.pos = p.pos GROUP BY ALL),
ends AS (SELECT g, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM reps GROUP BY g),
ci AS (SELECT g, n, mean, lo, hi FROM z JOIN ends USING (g))"""


@query(f"WITH {_LABELS}, {_boot_sql('lab', 'lang', 'doc_id', 'conf', 200)} SELECT g AS lang, n, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ci")
def q_bootstrap_ci(spark, sf_dir):
    """T19"""
    out = trust.bootstrap_ci(_labels(spark, sf_dir), ["lang"], "doc_id", "conf", draws=200)
    return out.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")])


@query(f"WITH {_LABELS}, d AS (SELECT doc_id, 'all' AS one, conf - {draw_sql('other', 'doc_id')} % 1000 / 1000.0 AS diff FROM lab), {_boot_sql('d', 'one', 'doc_id', 'diff', 200)} SELECT round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN lo > 0 THEN 'win' WHEN hi < 0 THEN 'lose' ELSE 'not established' END AS verdict FROM ci")
def q_paired_verdict(spark, sf_dir):
    """Paired difference of two methods with its verdict."""
    lab = _labels(spark, sf_dir)
    a, b = lab.select("doc_id", F.col("conf").alias("m")), lab.select("doc_id", ((draw("doc_id", salt="other") % 1000) / 1000.0).alias("m"))
    out = trust.bootstrap_ci(ranking.paired(a, b, "doc_id", "m").withColumn("one", F.lit("all")), ["one"], "doc_id", "diff", draws=200)
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")], ranking.verdict(F.col("lo"), F.col("hi")).alias("verdict"))


_AUDIT = f"""{_BASE}, {_boot_sql('pred', 'region', 'o_orderkey', 'abs(o_totalprice - pred)', 100)},
fit AS (SELECT region AS g, 1 - sum((o_totalprice - pred) ** 2) / (sum(o_totalprice ** 2) - sum(o_totalprice) ** 2 / count(*)) AS r2 FROM pred GROUP BY 1), audit AS (SELECT g, n, mean, lo, hi, r2 FROM ci JOIN fit USING (g) WHERE n >= 20)"""


def _audit(spark, sf_dir) -> DataFrame:
    return trust.regression_audit(_predicted(spark, sf_dir), "region", "o_orderkey", "o_totalprice", "pred", draws=100)


@query(f"WITH {_AUDIT} SELECT g AS \"group\", n, round(mean, 4) AS metric, round(lo, 4) AS lo, round(hi, 4) AS hi, round(r2, 6) AS r2 FROM audit")
def q_grouped_reg_audit(spark, sf_dir):
    """Error of the baseline by region on all test orders."""
    return _audit(spark, sf_dir).select("group", "n", *[F.round(c, 4).alias(c) for c in ("metric", "lo", "hi")], F.round("r2", 6).alias("r2"))


@query(f"WITH {_AUDIT}, b AS (SELECT * FROM audit ORDER BY mean, g LIMIT 1), w AS (SELECT * FROM audit ORDER BY mean DESC, g LIMIT 1) SELECT coalesce(b.g, '') AS best, coalesce(w.g, '') AS worst, round(abs(b.mean - w.mean), 4) AS gap, round(abs(b.mean - w.mean) / abs(b.mean), 6) AS relative_gap, coalesce(NOT (b.lo > w.hi OR w.lo > b.hi), false) AS overlap, coalesce(b.lo > w.hi OR w.lo > b.hi, false) AS significant FROM (SELECT count(*) AS c FROM audit) LEFT JOIN b ON c >= 2 LEFT JOIN w ON c >= 2")
def q_disparity(spark, sf_dir):
    """Best and worst region."""
    d = trust.disparity(_audit(spark, sf_dir), higher_is_better=False)
    named, sure = [F.coalesce(c, F.lit("")).alias(c) for c in ("best", "worst")], [F.coalesce(c, F.lit(False)).alias(c) for c in ("overlap", "significant")]
    return d.select(*named, F.round("gap", 4).alias("gap"), F.round("relative_gap", 6).alias("relative_gap"), *sure)


@query(f"""WITH {_LABELS}, {_boot_sql('lab', 'lang', 'doc_id', '(quality = pred)::INT', 100)}, t AS (SELECT lang AS g, quality AS l, count(*) AS s, count(*) FILTER (quality = pred) AS tp FROM lab GROUP BY ALL), p AS (SELECT lang AS g, pred AS l, count(*) AS n FROM lab GROUP BY ALL),
f AS (SELECT g, avg(2.0 * coalesce(tp, 0) / (coalesce(s, 0) + coalesce(n, 0))) AS macro_f1 FROM t FULL JOIN p USING (g, l) GROUP BY g)
SELECT g AS "group", n, round(mean, 6) AS metric, round(lo, 6) AS lo, round(hi, 6) AS hi, round(macro_f1, 6)::DOUBLE AS macro_f1 FROM ci JOIN f USING (g) WHERE n >= 8""")
def q_grouped_cls_audit(spark, sf_dir):
    """E21, E23"""
    out = trust.classification_audit(_labels(spark, sf_dir), "lang", "doc_id", "quality", "pred", draws=100)
    return out.select("group", "n", *[F.round(c, 6).alias(c) for c in ("metric", "lo", "hi", "macro_f1")])


def _poisson_sql(source: str, by: str, key: str, value: str) -> str:
    often = " + ".join(f"(u >= '{x}')::INT" for x in trust.poisson_steps())
    return f"""o AS (SELECT {by} AS g, {key} AS k, ({value})::DOUBLE AS v FROM {source} WHERE ({value}) IS NOT NULL),
z AS (SELECT g, count(*) AS n, avg(v) AS mean FROM o GROUP BY g),
digests AS (SELECT g, v, j, md5(concat_ws(':', '42', j::VARCHAR, k::VARCHAR)) AS h FROM o, range({(BOOTSTRAP + 7) // 8}) AS r(j)),
picks AS (SELECT g, v, 8 * j + c AS b, {often} AS w FROM (SELECT g, v, j, c, substr(h, (4 * c + 1)::INT, 4) AS u FROM digests, range(8) AS s(c))),
reps AS (SELECT g, b, sum(w * v) / nullif(sum(w), 0) AS m FROM picks WHERE b < {BOOTSTRAP} GROUP BY g, b),
ends AS (SELECT g, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM reps GROUP BY g),
ci AS (SELECT g, n, mean, lo, hi FROM z JOIN ends USING (g))"""


@query(f"WITH {_LABELS}, {_poisson_sql('lab', 'lang', 'doc_id', 'conf')} SELECT g AS lang, n, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ci")
def q_bootstrap_full(spark, sf_dir):
    """T19 with all 2,000 draws, in one pass."""
    return trust.poisson_ci(_labels(spark, sf_dir), ["lang"], "doc_id", "conf").select("lang", "n", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")])


@query(f"WITH {_LABELS}, d AS (SELECT doc_id, 'all' AS one, conf - {draw_sql('other', 'doc_id')} % 1000 / 1000.0 AS diff FROM lab), {_poisson_sql('d', 'one', 'doc_id', 'diff')} SELECT round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN lo > 0 THEN 'win' WHEN hi < 0 THEN 'lose' ELSE 'not established' END AS verdict FROM ci")
def q_paired_full(spark, sf_dir):
    """J11, E17 with all 2,000 draws, in one pass."""
    lab = _labels(spark, sf_dir)
    a, b = lab.select("doc_id", F.col("conf").alias("m")), lab.select("doc_id", ((draw("doc_id", salt="other") % 1000) / 1000.0).alias("m"))
    out = trust.poisson_ci(ranking.paired(a, b, "doc_id", "m").withColumn("one", F.lit("all")), ["one"], "doc_id", "diff")
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")], ranking.verdict(F.col("lo"), F.col("hi")).alias("verdict"))


_AUDIT_FULL = f"""{_BASE}, {_poisson_sql('pred', 'region', 'o_orderkey', 'abs(o_totalprice - pred)')},
fit AS (SELECT region AS g, 1 - sum((o_totalprice - pred) ** 2) / (sum(o_totalprice ** 2) - sum(o_totalprice) ** 2 / count(*)) AS r2 FROM pred GROUP BY 1), audit AS (SELECT g, n, mean, lo, hi, r2 FROM ci JOIN fit USING (g) WHERE n >= 20)"""


@query(f"WITH {_AUDIT_FULL}, b AS (SELECT * FROM audit ORDER BY mean, g LIMIT 1), w AS (SELECT * FROM audit ORDER BY mean DESC, g LIMIT 1) SELECT a.g AS \"group\", a.n, round(a.mean, 4) AS metric, round(a.lo, 4) AS lo, round(a.hi, 4) AS hi, round(a.r2, 6) AS r2, a.g = b.g AS best, a.g = w.g AS worst, NOT (b.lo > w.hi OR w.lo > b.hi) AS overlap FROM audit a, b, w")
def q_audit_full(spark, sf_dir):
    """E20, E22, M13 with all 2,000 draws, in one pass: every region's error, and how far the best and the worst are apart."""
    audit = trust.regression_audit(_predicted(spark, sf_dir), "region", "o_orderkey", "o_totalprice", "pred", interval=trust.poisson_ci)
    apart = trust.disparity(audit, higher_is_better=False).select(F.col("best").alias("_b"), F.col("worst").alias("_w"), "overlap")
    rows = audit.crossJoin(F.broadcast(apart))
    return rows.select("group", "n", *[F.round(c, 4).alias(c) for c in ("metric", "lo", "hi")], F.round("r2", 6).alias("r2"), (F.col("group") == F.col("_b")).alias("best"), (F.col("group") == F.col("_w")).alias("worst"), "overlap")


@query(f"""WITH {_LABELS}, {_poisson_sql('lab', 'lang', 'doc_id', '(quality = pred)::INT')}, t AS (SELECT lang AS g, quality AS l, count(*) AS s, count(*) FILTER (quality = pred) AS tp FROM lab GROUP BY ALL), p AS (SELECT lang AS g, pred AS l, count(*) AS n FROM lab GROUP BY ALL),
f AS (SELECT g, avg(2.0 * coalesce(tp, 0) / (coalesce(s, 0) + coalesce(n, 0))) AS macro_f1 FROM t FULL JOIN p USING (g, l) GROUP BY g)
SELECT g AS "group", n, round(mean, 6) AS metric, round(lo, 6) AS lo, round(hi, 6) AS hi, round(macro_f1, 6)::DOUBLE AS macro_f1 FROM ci JOIN f USING (g) WHERE n >= 8""")
def q_cls_audit_full(spark, sf_dir):
    """E21, E23 with all 2,000 draws, in one pass."""
    out = trust.classification_audit(_labels(spark, sf_dir), "lang", "doc_id", "quality", "pred", interval=trust.poisson_ci)
    return out.select("group", "n", *[F.round(c, 6).alias(c) for c in ("metric", "lo", "hi", "macro_f1")])


@query(f"""WITH {_LABELS}, e AS (SELECT min(conf) AS lo, max(conf) AS hi FROM lab), c AS (SELECT CASE WHEN hi > lo THEN least(floor((conf - lo) / (hi - lo) * 10), 9) ELSE 0 END AS b, quality AS l FROM lab, e),
j AS (SELECT b, l, count(*) AS n, sum(count(*)) OVER (PARTITION BY b) AS nb, sum(count(*)) OVER (PARTITION BY l) AS nl, sum(count(*)) OVER () AS t FROM c GROUP BY b, l) SELECT round(sum(n / t * ln(n * t / (nb * nl))), 6)::DOUBLE AS mutual_information FROM j""")
def q_mutual_information(spark, sf_dir):
    """E25 (binned)"""
    return metrics.binned_mutual_information(_labels(spark, sf_dir), "conf", "quality").select(F.round("mutual_information", 6).alias("mutual_information"))


@query(f"WITH {_LABELS}, k AS (SELECT greatest(50, 2 * count(*) FILTER (quality = 0)) AS k FROM lab), r AS (SELECT doc_id, row_number() OVER (ORDER BY {draw_sql('42', 'doc_id')}, doc_id) AS rn FROM lab WHERE quality = 1) SELECT doc_id FROM lab WHERE quality = 0 UNION ALL SELECT doc_id FROM r, k WHERE rn <= k")
def q_negative_subsample(spark, sf_dir):
    """Every row of the rare class and a bounded number of the other."""
    d = _labels(spark, sf_dir).withColumn("rare", (F.col("quality") == 0).cast("int"))
    return splits.negatives(d, "rare", ["doc_id"], least=50, ratio=2).select("doc_id")


@query(f"WITH {_LABELS}, r AS (SELECT doc_id, lang, doc_id % 10 = 0 AS gold, row_number() OVER (PARTITION BY lang, doc_id % 10 = 0 ORDER BY {draw_sql('42', 'doc_id')}, doc_id) AS rn, floor(count(*) OVER (PARTITION BY lang, doc_id % 10 = 0) * 0.15 + 0.5) AS k FROM lab) SELECT doc_id, CASE WHEN gold OR rn <= k THEN 'test' WHEN rn <= 2 * k THEN 'val' ELSE 'train' END AS split FROM r")
def q_three_way(spark, sf_dir):
    """T11"""
    return splits.three_way(_labels(spark, sf_dir), "doc_id", ["lang"], F.col("doc_id") % 10 == 0).select("doc_id", "split")


@query("SELECT event_type, count(*) AS n, round(avg((props->>'$.k')::DOUBLE), 6) AS mean_k FROM events GROUP BY event_type")
def q_json_props(spark, sf_dir):
    """a JSON column parsed with a declared schema."""
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k double").alias("p"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p.k"), 6).alias("mean_k"))


@query("SELECT o_custkey, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_totalprice DESC, o_orderkey) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 15 GROUP BY o_custkey")
def q_nested_export(spark, sf_dir):
    """The fifteen largest orders of each customer as a nested array."""
    n = export.nested(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], ["-o_totalprice", "o_orderkey"], most=15)
    return n.select("o_custkey", F.size("rows").cast("long").alias("n"), F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("string")), ",").alias("keys"))


@query("SELECT n_regionkey, '{' || string_agg('\"' || n_nationkey || '\":\"' || n_name || '\"', ',' ORDER BY n_nationkey::VARCHAR) || '}' AS doc FROM nation GROUP BY n_regionkey")
def q_json_export(spark, sf_dir):
    """A JSON map a region."""
    return export.keyed_map(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", F.col("n_name"))


@query("SELECT DISTINCT c_nationkey AS nation FROM customer UNION SELECT DISTINCT s_nationkey FROM supplier")
def q_set_union(spark, sf_dir):
    """U1, U4, U5"""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def q_set_intersect(spark, sf_dir):
    """U3"""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_custkey, CASE WHEN 3 * (rn - 1) <= t - 1 THEN 'low' WHEN 3 * (rn - 1) <= 2 * (t - 1) THEN 'medium' ELSE 'high' END AS pop_tier FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rn, count(*) OVER () AS t FROM customer)")
def q_customer_tier(spark, sf_dir):
    """W9 over a larger table, by range partitions."""
    return terciles(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal"), F.col("c_custkey")]).select("c_custkey", "pop_tier")


@query(f"SELECT o_orderkey FROM orders ORDER BY {draw_sql('42', 'o_orderkey')}, o_orderkey LIMIT 200")
def q_sample_rows(spark, sf_dir):
    """A sample by hash order (the limit is the feature)."""
    return relational.sample_rows(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 200)


@query("SELECT * FROM (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM customer) WHERE rank <= 3")
def q_top_per_group(spark, sf_dir):
    """W6"""
    return relational.top_per_group(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3)


@query("WITH c AS (SELECT o_orderpriority AS p, o_orderstatus AS s, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY ALL) SELECT p, s, round(m, 4) AS mean, n, round(m - lag(m) OVER (PARTITION BY s ORDER BY p), 4) AS step FROM c")
def q_summary_steps(spark, sf_dir):
    """Multi-key means and lag steps."""
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s")).agg(F.avg("o_totalprice").alias("m"), F.count(F.lit(1)).alias("n"))
    return c.select("p", "s", F.round("m", 4).alias("mean"), "n", F.round(F.col("m") - F.lag("m").over(W.partitionBy("s").orderBy("p")), 4).alias("step"))
