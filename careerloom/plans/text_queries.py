"""Queries over text: extraction, bridge, lookups and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerloom.functions.columns import canonical_key, described, detect_language, first_token, leading_phrase, one_hot, overlap, parse_rated, sentences, sigmoid, singular_phrase, slug, strip_boilerplate, tier_label, token_set, tokens
from careerloom.operators import metrics, relational, textops
from careerloom.plans.base import Registry
from careerloom.sources import io
from careerloom.sources.io import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_LANG = {"en": ("the", "and", "of", "to", "in", "for", "with"), "fr": ("le", "la", "les", "et", "des", "pour", "une")}
_HITS = {k: "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{v}'" for v in vs) + ")))" for k, vs in _LANG.items()}


@query(f"WITH d AS (SELECT doc_id, regexp_split_to_array(lower(substr(text, 1, 4000)), '[^a-z]+') AS w FROM documents), h AS (SELECT doc_id, {_HITS['en']} AS en, {_HITS['fr']} AS fr FROM d) SELECT doc_id, CASE WHEN en >= fr AND en > 0 THEN 'en' WHEN fr > en THEN 'fr' ELSE 'other' END AS lang FROM h")
def q_lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the reference rule reads a text's head, which is its definition."""
    return table(spark, sf_dir, "documents").select("doc_id", detect_language(F.col("text")).alias("lang"))


@query(r"WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: substr(trim(x), 1, 300)), lambda x: length(x) >= 8)[1:60] AS s FROM documents) SELECT doc_id, len(s)::INT AS n, coalesce(s[1], '') AS first FROM s")
def q_sentences(spark, sf_dir):
    """F12"""
    s = table(spark, sf_dir, "documents").select("doc_id", sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("first"))


@query(r"SELECT doc_id, length(trim(regexp_replace(regexp_replace(text || ' Show more Show less ', '(?i)\s*show more\s*show less\s*$', ''), '[ \t]+', ' ', 'g')))::INT AS n FROM documents")
def q_boilerplate(spark, sf_dir):
    """F7"""
    return table(spark, sf_dir, "documents").select("doc_id", F.length(strip_boilerplate(F.concat("text", F.lit(" Show more Show less ")))).alias("n"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9+#]', '', 'g') AS key, 'oa_' || replace(lower(p_type), ' ', '_') AS slug, split_part(p_brand, '#', 1) AS maker, lower(p_name || '. ' || coalesce(p_type, '')) AS text FROM part")
def q_text_keys(spark, sf_dir):
    """F2, F5, F6, F15, M19, M21"""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", canonical_key(F.col("p_name")).alias("key"), slug(F.col("p_type"), "oa_").alias("slug"), first_token(F.col("p_brand"), "#").alias("maker"), described(F.col("p_name"), F.col("p_type")).alias("text"))


_GRAMS = r"list_distinct(list_concat({0}, list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]), list_transform(range(1, len({0}) - 1), lambda i: {0}[i] || ' ' || {0}[i + 1] || ' ' || {0}[i + 2])))"
_VOCAB = r"""vocab AS (SELECT DISTINCT phrase FROM (SELECT w[1] || ' ' || w[2] AS phrase FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9+#]+') AS w FROM benchmark) WHERE len(w) >= 2 UNION ALL SELECT w[1] || ' ' || w[2] || ' ' || w[3] FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9+#]+') AS w FROM benchmark) WHERE len(w) >= 3))"""


def _vocab(spark, sf_dir) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select(tokens(F.col("text")).alias("w"))
    two = w.where(F.size("w") >= 2).select(F.array_join(F.slice("w", 1, 2), " ").alias("phrase"))
    return two.union(w.where(F.size("w") >= 3).select(F.array_join(F.slice("w", 1, 3), " "))).distinct()


_FOUND = f"{_VOCAB}, found AS (SELECT doc_id, phrase FROM (SELECT doc_id, unnest({_GRAMS.format('w')}) AS phrase FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9+#]+') AS w FROM documents)) JOIN vocab USING (phrase))"


def _found(spark, sf_dir) -> DataFrame:
    return textops.gazetteer(table(spark, sf_dir, "documents"), _vocab(spark, sf_dir), "doc_id", "text", "phrase")


@query(f"WITH {_FOUND} SELECT * FROM found")
def q_gazetteer(spark, sf_dir):
    """Phrases of the benchmark in documents, as whole words."""
    return _found(spark, sf_dir)


@query(f"WITH {_FOUND}, f AS (SELECT phrase, count(DISTINCT doc_id) AS doc_freq FROM found WHERE length(phrase) BETWEEN 2 AND 60 GROUP BY phrase HAVING count(DISTINCT doc_id) >= 5) SELECT phrase AS label, doc_freq, (row_number() OVER (ORDER BY phrase) - 1)::INT AS label_id FROM f")
def q_label_space(spark, sf_dir):
    """X1, A8, P13"""
    return textops.label_space(_found(spark, sf_dir), "doc_id", "phrase", least_df=5).select("label", "doc_freq", "label_id")


_ML = f"""{_FOUND}, lab AS (SELECT DISTINCT doc_id, phrase FROM found), pred AS (SELECT doc_id, phrase FROM lab WHERE ('0x' || substr(md5('ml:' || doc_id || ':' || phrase), 1, 8))::BIGINT % 10 < 7 UNION SELECT doc_id + 1, phrase FROM lab WHERE ('0x' || substr(md5('mf:' || doc_id || ':' || phrase), 1, 8))::BIGINT % 10 < 2),
cells AS (SELECT doc_id, phrase, (t IS NOT NULL AND p IS NOT NULL)::INT AS tp, (t IS NULL)::INT AS fp, (p IS NULL)::INT AS fn FROM (SELECT doc_id, phrase, 1 AS t FROM lab) FULL JOIN (SELECT doc_id, phrase, 1 AS p FROM pred) USING (doc_id, phrase))"""
_F1 = "CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) > 0 THEN 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) ELSE 0 END"


def _predictions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    from careerloom.functions.draws import draw

    truth = _found(spark, sf_dir)
    kept = truth.where(draw("doc_id", "phrase", salt="ml") % 10 < 7)
    wrong = truth.where(draw("doc_id", "phrase", salt="mf") % 10 < 2).select((F.col("doc_id") + 1).alias("doc_id"), "phrase")
    return truth, kept.union(wrong).distinct()


@query(f"WITH {_ML} SELECT round(sum(tp) / (sum(tp) + sum(fp)), 6) AS micro_p, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS micro_r, round({_F1}, 6)::DOUBLE AS micro_f1, (SELECT round(avg(f), 6)::DOUBLE FROM (SELECT coalesce(f, 0) AS f FROM vocab LEFT JOIN (SELECT phrase, {_F1} AS f FROM cells GROUP BY phrase) USING (phrase))) AS macro_f1, (SELECT round(avg(f), 6)::DOUBLE FROM (SELECT coalesce(f, 0) AS f FROM documents LEFT JOIN (SELECT doc_id, {_F1} AS f FROM cells GROUP BY doc_id) USING (doc_id))) AS samples_f1 FROM cells")
def q_multilabel_report(spark, sf_dir):
    """E12, E14"""
    truth, pred = _predictions(spark, sf_dir)
    out = metrics.multilabel_report(truth, pred, _vocab(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", "phrase")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"WITH {_ML}, f AS (SELECT phrase, count(*) AS n FROM lab GROUP BY phrase) SELECT CASE WHEN n >= 20 THEN 'head' WHEN n >= 5 THEN 'middle' ELSE 'tail' END AS band, round({_F1}, 6)::DOUBLE AS f1, count(DISTINCT phrase) AS n_labels FROM cells JOIN f USING (phrase) GROUP BY 1")
def q_band_f1(spark, sf_dir):
    """E13"""
    truth, pred = _predictions(spark, sf_dir)
    freq = truth.groupBy("phrase").agg(F.count(F.lit(1)).alias("doc_freq"))
    out = metrics.band_f1(metrics.multilabel_cells(truth, pred, "doc_id", "phrase"), freq, "phrase", edges=(20, 5))
    return out.select("band", F.round("f1", 6).alias("f1"), "n_labels")


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 5),
x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1) AS w FROM tf JOIN df USING (term)), l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM x GROUP BY doc_id)
SELECT doc_id, count(*) AS n_terms, round(sum(w / l), 5) AS total, round(max(w / l), 6) AS top FROM x JOIN l USING (doc_id) GROUP BY doc_id""")
def q_tfidf(spark, sf_dir):
    """TF-IDF rows, summed for each document."""
    t = textops.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text")
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 5).alias("total"), F.round(F.max("weight"), 6).alias("top"))


_TOKSET = "list_distinct(list_filter(list_transform(regexp_split_to_array(lower({}), '[^a-z0-9+#]+'), lambda x: regexp_replace(x, 's+$', '')), lambda x: length(x) > 2))"
_BRIDGE = f"""skills AS (SELECT 'skill ' || r_name AS skill, r_regionkey AS k, 10 - r_regionkey AS doc_freq FROM region), names AS (SELECT n_nationkey AS id, n_name AS name FROM nation),
sv AS (SELECT skill, doc_freq, {_TOKSET.format("skill")} AS t, embedding::DOUBLE[] AS v FROM skills JOIN embeddings ON vec_id = k), nv AS (SELECT id, name, {_TOKSET.format("name")} AS t, embedding::DOUBLE[] AS v FROM names JOIN embeddings ON vec_id = id + 100),
p AS (SELECT skill, doc_freq, id, name, CASE WHEN least(len(sv.t), len(nv.t)) = 0 THEN 0 ELSE len(list_intersect(sv.t, nv.t)) / least(len(sv.t), len(nv.t)) END AS lex, list_inner_product(sv.v, nv.v) / (sqrt(list_inner_product(sv.v, sv.v)) * sqrt(list_inner_product(nv.v, nv.v))) AS cos FROM sv, nv),
b AS (SELECT skill, doc_freq, first(id ORDER BY lex DESC, id) AS lid, max(lex) AS lex, first(id ORDER BY cos DESC, id) AS cid, max(cos) AS cos FROM p GROUP BY ALL),
bridge AS (SELECT skill, doc_freq, CASE WHEN lex >= 0.8 THEN lid ELSE cid END AS descriptor_id, round(cos, 6) AS cosine, CASE WHEN lex >= 0.8 THEN 'lexical' WHEN cos >= 0.2 THEN 'semantic' ELSE 'none' END AS match_type, lex >= 0.8 OR cos >= 0.2 AS mapped FROM b)"""


def _bridge(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    s = table(spark, sf_dir, "region").select(F.concat(F.lit("skill "), "r_name").alias("skill"), (10 - F.col("r_regionkey")).alias("doc_freq"), F.col("r_regionkey").cast("long").alias("vec_id")).join(e, "vec_id").select("skill", "doc_freq", F.col("embedding").alias("v"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("descriptor_id"), F.col("n_name").alias("name"), (F.col("n_nationkey") + 100).cast("long").alias("vec_id")).join(e, "vec_id").select("descriptor_id", "name", F.col("embedding").alias("v"))
    return textops.bridge(s, n, semantic=0.2)


@query(f"WITH {_BRIDGE} SELECT * FROM bridge")
def q_bridge(spark, sf_dir):
    """X9, J13, F13, F14"""
    return _bridge(spark, sf_dir).select("skill", "doc_freq", "descriptor_id", F.round("cosine", 6).alias("cosine"), "match_type", "mapped")


@query(f"WITH {_BRIDGE} SELECT skill, doc_freq FROM bridge WHERE NOT mapped ORDER BY doc_freq DESC, skill")
def q_emerging(spark, sf_dir):
    """X10"""
    return textops.emerging(_bridge(spark, sf_dir)).select("skill", "doc_freq")


@query(f"WITH {_BRIDGE} SELECT c_custkey, lower(skill) AS label, descriptor_id FROM bridge JOIN nation ON n_regionkey = 10 - doc_freq JOIN customer ON c_nationkey = n_nationkey WHERE mapped")
def q_handoff(spark, sf_dir):
    """X11, M7"""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
    r = table(spark, sf_dir, "region").select("r_regionkey", F.lower(F.concat(F.lit("skill "), "r_name")).alias("label"))
    preds = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(n, "c_nationkey").join(r, "r_regionkey").select("c_custkey", "label")
    return textops.handoff(preds, _bridge(spark, sf_dir), "c_custkey")


@query("WITH ph AS (SELECT item_id, lower(substr(text, 1, 24)) AS ph FROM benchmark), hits AS (SELECT doc_id, item_id FROM documents JOIN ph ON contains(lower(text), ph)) SELECT item_id, count(DISTINCT doc_id) AS n FROM hits GROUP BY item_id HAVING count(DISTINCT doc_id) >= 1")
def q_title_contains(spark, sf_dir):
    """Raw containment, joined on 12-grams and decided by the substring test."""
    ph = table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.substring("text", 1, 24)).alias("ph"))
    hits = relational.contains_join(table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t")), ph, "t", "ph", least_chars=12)
    return hits.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n")).where("n >= 1")


@query(r"SELECT p_partkey, trim(split_part(p_name, ' ', 1)) AS lead, array_to_string(list_transform(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END), ' ') AS singular FROM part")
def q_phrases(spark, sf_dir):
    """F9, F10"""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", leading_phrase(F.col("p_name"), " ").alias("lead"), singular_phrase(F.col("p_name")).alias("singular"))


@query("SELECT n_nationkey, n_name, 'exact' AS route, 1.0::DOUBLE AS score FROM nation WHERE lower(n_name) = 'nation_2'")
def q_lookup_priority(spark, sf_dir):
    """exact before substring before fuzzy."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return textops.lookup(n, "n_nationkey", "n_name", "Nation_2")


@query("SELECT n_nationkey::VARCHAR AS code, n_name AS name, true AS ambiguous FROM nation WHERE regexp_matches(lower(n_name), '_1[0-3]$')")
def q_lookup_regex(spark, sf_dir):
    """F19"""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    return textops.lookup_regex(n, "code", "name", "_1[0-3]$")


@query("SELECT * FROM (VALUES ('mid', 'MIDDLE EAST'), ('asia', 'ASIA'), ('a', NULL), ('rop', 'EUROPE')) AS t(q, match)")
def q_match_unique(spark, sf_dir):
    """exact, unique prefix, unique substring."""
    q = spark.createDataFrame([("mid",), ("asia",), ("a",), ("rop",)], "q string")
    return textops.match_unique(table(spark, sf_dir, "region"), "r_name", q, "q")


@query("SELECT r_name FROM region WHERE lower(r_name) LIKE '%afri%' OR lower(r_name) LIKE '%amer%' ORDER BY r_name LIMIT 5")
def q_suggest(spark, sf_dir):
    """F21"""
    return textops.suggest(table(spark, sf_dir, "region"), "r_name", "african americas of")


@query("SELECT * FROM (VALUES ('Nation_3', 3), ('Skill ASIA', coalesce((WITH " + _BRIDGE + " SELECT CASE WHEN mapped THEN descriptor_id END FROM bridge WHERE skill = 'skill ASIA'), -1)), ('nowhere', -1)) AS t(raw, descriptor_id)")
def q_user_skills(spark, sf_dir):
    """exact, loose and bridge routes; -1 where no route hits."""
    raw = spark.createDataFrame([("Nation_3",), ("Skill ASIA",), ("nowhere",)], "raw string")
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("descriptor_id"), F.col("n_name").alias("name"))
    return textops.map_user_skills(raw, "raw", names, _bridge(spark, sf_dir)).na.fill(-1, ["descriptor_id"])


@query("SELECT * FROM (VALUES ('nation_3', 'NATION_3'), ('Nation 4', 'NATION_4'), ('nation_5 skills', 'NATION_5'), ('mars', NULL)) AS t(raw, mapped)")
def q_gold_normaliser(spark, sf_dir):
    """F16"""
    raw = spark.createDataFrame([("nation_3",), ("Nation 4",), ("nation_5 skills",), ("mars",)], "raw string")
    vocab = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("v"))
    return textops.normalise_to_vocab(raw, vocab, "raw", "v").select("raw", F.upper("mapped").alias("mapped"))


@query("SELECT * FROM (VALUES ('python', 4.5), ('sql', 4.0), ('excel', 5.0)) AS t(name, rating)")
def q_parse_skills(spark, sf_dir):
    """F17"""
    raw = spark.createDataFrame([("Python:4.5, SQL, Excel:9",)], "s string")
    return raw.select(F.explode(parse_rated(F.col("s"))).alias("x")).select("x.name", "x.rating")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 1 THEN 'TEER 0' ELSE 'TEER ' || substr(lpad(s_suppkey::VARCHAR, 5, '0'), 2, 1) END AS label, round(1 / (1 + exp(-(s_acctbal / 1000))), 6) AS p, list_transform(range(3), lambda i: (i = s_nationkey % 3)::DOUBLE) AS hot FROM supplier")
def q_scalar_kernels(spark, sf_dir):
    """F4, F25, F27, P16"""
    s = table(spark, sf_dir, "supplier")
    code = F.lpad(F.col("s_suppkey").cast("string"), 5, "0")
    return s.select("s_suppkey", F.when(F.col("s_suppkey") % 10 == 1, "TEER 0").otherwise(tier_label(code, {"none": "-"})).alias("label"), F.round(sigmoid(F.col("s_acctbal") / 1000), 6).alias("p"), one_hot(F.col("s_nationkey") % 3, 3).alias("hot"))


@query(f"SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN least(len({_TOKSET.format('a.n_name')}), len({_TOKSET.format('b.n_name')})) = 0 THEN 0.0 ELSE round(len(list_intersect({_TOKSET.format('a.n_name')}, {_TOKSET.format('b.n_name')})) / least(len({_TOKSET.format('a.n_name')}), len({_TOKSET.format('b.n_name')})), 6) END::DOUBLE AS o FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey")
def q_overlap(spark, sf_dir):
    """F13, F14"""
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), token_set(F.col("n_name")).alias("ta")), n.select(F.col("n_nationkey").alias("b"), token_set(F.col("n_name")).alias("tb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(overlap(F.col("ta"), F.col("tb")), 6).alias("o"))


@query("SELECT lpad(c_nationkey::VARCHAR, 5, '0') AS code, count(*) AS n, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS total FROM customer GROUP BY 1")
def q_csv_round_trip(spark, sf_dir):
    """Codes survive a gzip CSV as strings."""
    src = table(spark, sf_dir, "customer").select(F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("code"), F.col("c_acctbal").cast("decimal(18,2)").alias("bal"), "c_name")
    path = io.Writer().csv(src, io.scratch(spark, "csv"), gzip=True)
    back = io.read_csv(spark, path, columns=["code", "bal"])
    return back.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("try_cast(bal AS decimal(18,2))")).cast("double").alias("total"))


@query("SELECT 'recommender' AS component, 'mf no bi' AS model, 0.5::DOUBLE AS ndcg")
def q_metric_round_trip(spark, sf_dir):
    """A metric record written and read."""
    root = io.scratch(spark, "metrics")
    io.Writer().metric(spark, "recommender", "mf no bi", {"ndcg": 0.5}, root, {"k": "32"})
    return spark.read.option("recursiveFileLookup", True).json(root).select("component", "model", F.col("metrics.ndcg").alias("ndcg"))


@query("SELECT count(*) AS n, count(DISTINCT p_brand) AS brands, max(p_retailprice) AS top FROM part")
def q_tolerant_csv(spark, sf_dir):
    """A semicolon file found by glob, its roles by header words."""
    root = io.scratch(spark, "tolerant")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("part code"), F.col("p_brand").alias("label"), F.col("p_retailprice").cast("string").alias("price"))
    p.write.options(header=True, sep=";").csv(f"{root}/ratings.csv")
    df = io.read_tolerant(spark, io.find_one(spark, f"{root}/*.csv"))
    code, label, values = io.split_roles(df.columns)
    return df.agg(F.count(F.col(code)).alias("n"), F.count_distinct(F.col(label)).alias("brands"), F.max(F.expr(f"try_cast(`{values[0]}` AS double)")).alias("top"))


@query("SELECT count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def q_record_scan(spark, sf_dir):
    """A multi-line CSV reduced to wanted keys."""
    path = io.Writer().csv(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"), io.scratch(spark, "records"))
    keys = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("doc_id"))
    return io.read_records(spark, path, keys, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
