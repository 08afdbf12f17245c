"""The registered queries of the operators, and their DuckDB text where SQL can express them.

Each query is thin: it hands whole tables to its operator with production
parameters and derives the digest columns from the operator's real output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from careerloom.llm import bpe, chat, langid, licenses, neardup, packing, quality, secrets, sharding, topk
from careerloom.llm.shared import table

SHARDS = 40


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document: best licence, its Dice coefficient, all licences found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs)
    return found.select("doc_id", "license", F.round("dice", 9).alias("dice"), F.array_join("licenses", ",").alias("licenses"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded to ids and decoded again; digests of both."""
    ranks = bpe.read_ranks(TOKENIZER["rank_path"])
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, TOKENIZER["rank_path"], TOKENIZER["pattern"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), ranks), 256).alias("decoded_sha256"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 equal shards by rendezvous hashing of doc_id (law ``key``)."""
    body = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    placed = sharding.shard_records(docs, "doc_id", [1.0] * SHARDS, grown=1.0)
    slots = sharding.number_slots(placed, "shard", ["doc_id", "size", "text_crc32", "grown_shard"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document; base findings counted and digested apart."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    every = F.filter(F.split("base_spans", ","), lambda x: x != "")
    count = lambda kind: F.size(F.filter(every, lambda x: x.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest integer inner products of every hundredth vector against all others."""
    raw = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    vectors = raw.select("vec_id", topk.whole_components(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


TOKENIZER = {
    "json_path": public_tokenizers.path("byte_bpe_50k.json"),
    "rank_path": public_tokenizers.path("byte_bpe_50k.tiktoken"),
    "pattern": public_tokenizers.PATTERN,
}


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed along the curve into sequences of 1,024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), **TOKENIZER)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    found = neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size", "n_links", (F.col("is_head") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))


_PROBE = "</s>[INST] ok [/INST]"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and read back from the formatted text and its loss mask."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", _PROBE), (-1, 1, "assistant", _PROBE)], turns.schema)
    out = chat.format_conversations(turns.unionByName(probe))
    back = out.select("conv_id", chat.parse_turns(F.col("formatted")).alias("turns"), F.array_join(chat.masked_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"), "formatted")
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    rows = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in licenses.TEMPLATES)
    grams = """list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"""
    cut = r"""list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"""
    return rf"""
WITH templates AS (SELECT name, {grams} AS grams, len(w) AS words FROM (SELECT name, {cut.format("body")} AS w FROM (VALUES {rows}) AS t(name, body))),
units AS (
  SELECT DISTINCT doc_id, u FROM (
    SELECT doc_id, coalesce(text, '') AS u FROM documents
    UNION ALL SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents
    UNION ALL SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\n[\x20\x09\r]*\n')) FROM documents)),
cut AS (SELECT doc_id, {grams} AS grams FROM (SELECT doc_id, {cut.format("u")} AS w FROM units) WHERE len(w) > 1),
whole AS (SELECT doc_id, w, {grams} AS grams FROM (SELECT doc_id, {cut.format("coalesce(text, '')")} AS w FROM documents) WHERE len(w) > 1),
near AS (SELECT doc_id, t.* FROM whole d JOIN templates t ON len(d.grams) * 3 >= 2 * len(t.grams) WHERE len(list_intersect(d.grams, t.grams)) * 3 >= 2 * len(t.grams)),
lines AS (
  SELECT doc_id, sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS before, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS after
  FROM (SELECT doc_id, i, len({cut.format("l[i]")}) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IN (SELECT doc_id FROM near))))),
runs AS (
  SELECT DISTINCT a.doc_id, t.name, t.grams, d.w[a.before + 1 : e.after] AS w
  FROM near t JOIN whole d ON d.doc_id = t.doc_id JOIN lines a ON a.doc_id = t.doc_id JOIN lines e ON e.doc_id = t.doc_id AND e.after > a.before + 1 AND e.after - a.before <= {licenses.RUN} * t.words),
scored AS (
  SELECT doc_id, name, 2.0 * len(list_intersect(c.grams, t.grams)) / (len(c.grams) + len(t.grams)) AS dice
  FROM cut c JOIN templates t ON len(c.grams) * 3 >= 2 * len(t.grams) AND 2 * len(c.grams) <= 3 * len(t.grams)
  UNION ALL
  SELECT doc_id, name, 2.0 * len(list_intersect(own, grams)) / (len(own) + len(grams)) FROM (SELECT doc_id, name, grams, {grams} AS own FROM runs)),
fits AS (SELECT doc_id, name, max(dice) AS dice FROM scored WHERE dice >= 0.8 GROUP BY doc_id, name),
best AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses, first(name ORDER BY dice DESC, name) AS license, max(dice) AS dice FROM fits GROUP BY doc_id)
SELECT d.doc_id, b.license, round(coalesce(b.dice, 0.0), 9)::DOUBLE AS dice, coalesce(b.licenses, '') AS licenses
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id
"""


def _draw_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT"


_SHARD_SQL = f"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i::BIGINT) AS v FROM range(256) AS r(i))),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT),
      lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) AS text_crc32
  FROM documents, crc_table),
draws AS (
  SELECT doc_id, size, text_crc32, list_transform(range({SHARDS + 1}), lambda s: {_draw_sql("doc_id::VARCHAR || ':' || s::VARCHAR")}) AS d FROM sized),
placed AS (
  SELECT doc_id, size, text_crc32, (list_position(d[1:{SHARDS}], list_max(d[1:{SHARDS}])) - 1)::INT AS shard, (list_position(d, list_max(d)) - 1)::INT AS grown_shard FROM draws)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY {_draw_sql("concat_ws(':', doc_id, size, text_crc32, grown_shard)")}, doc_id) - 1 AS slot, grown_shard
FROM placed
"""


def _escape_sql(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for mark in chat.CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


_CHAT_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{_PROBE}'),
marked AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, length({_escape_sql("text")}) + CASE WHEN before IS NULL OR before <> role
    THEN length({_escape_sql("role")}) + {len(chat.START) + len(chat.SEP) + len(chat.END)} ELSE {len(chat.NEXT)} END AS chars FROM marked)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""

_WORDS_SQL = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_BARE_SQL = r"regexp_replace({}, '[\x20\x09-\x0D]', '', 'g')"
_QUALITY_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text, {_WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, host, body, l FROM (SELECT doc_id, host, md5(text) AS body, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE {_BARE_SQL.format("l")} <> ''),
dups AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines GROUP BY doc_id),
hashed AS (
  SELECT doc_id, host, body, ('0x' || substr(md5(trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g'))), 1, 15))::BIGINT AS h, len({_WORDS_SQL.format("l")}) AS words FROM lines),
held AS (SELECT doc_id, host, body, h, sum(words) AS words FROM hashed GROUP BY ALL),
frequent AS (SELECT host, h FROM held GROUP BY host, h HAVING count(DISTINCT body) > {quality.MAX_LINE_DOCS}),
lost AS (SELECT doc_id, sum(words) AS lost_words FROM held JOIN frequent USING (host, h) GROUP BY doc_id),
measured AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length({_BARE_SQL.format("text")})::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost_words, 0)::BIGINT AS lost_words
  FROM docs d LEFT JOIN repeats USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words)
    AND 100 * (n_words - lost_words) >= {quality.MIN_KEPT_PERCENT} * n_words AS kept
FROM measured
"""


def queries() -> dict:
    found = [op1_language_id, op2_license_scan, op3_bpe_round_trip, op4_sharding, op5_secret_scan, op6_exact_topk, op7_packing, op8_near_dedup, op9_chat_format, op10_quality_rules]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    return {"op2_license_scan": _license_sql(), "op4_sharding": _SHARD_SQL, "op6_exact_topk": _TOPK_SQL, "op9_chat_format": _CHAT_SQL, "op10_quality_rules": _QUALITY_SQL}
