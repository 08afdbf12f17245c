"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import public_tokenizers
from pyspark.sql import functions as F

from careerloom.llm import bpe, chat, langid, licenses, neardup, packing, quality, secrets, sharding, topk
from careerloom.llm.queries import TOKENIZER


def test_language_id(odd, empty):
    model = langid.train(odd)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count() and len(rows[0]) == len(odd.columns) + 1  # score is replaced
    by = {(r.doc_id, r.text is None): r for r in rows}
    for key in [(3, True), (4, False), (5, False), (7, False)]:
        assert by[key].lang_pred == "und" and by[key].score == 0
    assert all(0 <= r.score <= 1 for r in rows)
    assert by[(8, False)].lang_pred in model.languages
    none = langid.train(empty)
    assert none is None and langid.identify(empty, none).count() == 0
    assert langid.identify(odd, none).select("lang_pred").distinct().first()[0] == "und"


def test_license_scan(odd, empty):
    rows = licenses.scan(odd).collect()
    assert len(rows) == odd.count() and all(r.license is None and r.dice == 0 and r.licenses == [] for r in rows)
    assert licenses.scan(empty).count() == 0


def test_bpe(odd, empty):
    ranks = bpe.read_ranks(TOKENIZER["rank_path"])
    short = odd.where("doc_id is null or doc_id <> 6")
    native = lambda df: bpe.encode_native(df, ranks, public_tokenizers.PATTERN)
    arrow = lambda df: bpe.encode(df, TOKENIZER["rank_path"], public_tokenizers.PATTERN)
    for df, n, run in ((short, short.count(), native), (empty, 0, native), (odd, odd.count(), arrow), (empty, 0, arrow)):
        coded = run(df).select("doc_id", "text", "ids", bpe.decode(F.col("ids"), ranks).alias("back")).collect()
        assert len(coded) == n
        assert all(bytes(r.back).decode() == (r.text or "") for r in coded)


def test_sharding(odd, empty):
    placed = sharding.shard_records(odd, "doc_id", [1.0] * 5, grown=1.0)
    rows = placed.collect()
    assert all(r.grown_shard in (r.shard, 5) and 0 <= r.shard < 5 for r in rows)
    slots = sharding.number_slots(placed, "shard", ["doc_id", "text"]).collect()
    assert len(slots) == len(rows)
    by = {}
    for r in slots:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.number_slots(sharding.shard_records(empty, "doc_id", [1.0] * 5), "shard", ["doc_id"]).count() == 0


def test_secret_scan(odd, empty):
    net = secrets.train(odd)
    rows = secrets.scan(odd, net).collect()
    assert len(rows) == odd.count() and all(r.base_spans == "" for r in rows)
    assert secrets.scan(empty, net).count() == 0
    out = secrets.redact(odd, net)
    assert out.columns == odd.columns and out.where("text is null").count() == 1


def test_topk(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [0.5]), (8, []), (100, [-1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = df.where(topk.usable(F.col("embedding"))).select("vec_id", topk.whole_components(F.col("embedding")).alias("v"))
    got = topk.top_k(v, v.where("vec_id % 100 = 0"), 3).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: (r.query_id, r.rank)) if r.query_id == 0] == [(1, 1), (2, 2), (3, 7)]
    assert len([r for r in got if r.query_id == 100]) == 3
    assert topk.top_k(v.limit(0), v.limit(0), 3).count() == 0


def test_packing(odd, empty):
    rows = packing.pack(odd, **TOKENIZER).collect()
    total = {}
    for r in rows:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert all(n == 1024 or n & (n - 1) == 0 for n in total.values())
    pieces = [r for r in rows if r.doc_id == 3]
    assert [(r.start, r.length, r.doc_tokens) for r in pieces] == [(0, 1, 1)]
    assert len([r for r in rows if r.doc_id == 1 and r.start == 0]) == 2
    assert packing.pack(empty, **TOKENIZER).count() == 0


def test_near_dedup(odd, empty):
    got = {(r.doc_id, r.node is None): r for r in neardup.classes(odd).collect()}
    assert got[(1, False)].class_id == got[(2, False)].class_id == 1 and got[(2, False)].class_size == 3
    assert got[(3, True)].class_id == 3 and got[(None, False)].class_id is None
    out = neardup.keep_one(odd)
    assert out.columns == odd.columns
    kept = sorted(r.doc_id if r.doc_id is not None else -1 for r in out.collect())
    assert kept == [-1, 1, 3, 4, 5, 6, 7, 8, 9]
    assert neardup.classes(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_chat(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (2, 0, "as<|sep|>x\\", "t</s>\\\\<|end|>"), (None, 0, "assistant", ""), (3, 0, "assistant", "q"), (3, 1, "assistant", "r")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, turns string, formatted int")
    out = chat.format_conversations(df)
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.parse_turns(F.col("formatted")).alias("t"), chat.masked_texts(F.col("formatted"), F.col("loss_spans")).alias("m")).collect()}
    assert [(t.role, t.text) for t in got[1].t] == [("", ""), ("user", "a"), ("user", "a"), ("assistant", "b")] and got[1].m == ["b"]
    assert [(t.role, t.text) for t in got[2].t] == [("as<|sep|>x\\", "t</s>\\\\<|end|>")]
    assert got[3].formatted.count("<|start|>") == 1 and got[3].m == ["q", "r"]
    assert got[None].m == [""]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_quality(odd, empty):
    rows = {(r.doc_id): r for r in quality.judge(odd).collect()}
    assert quality.judge(odd).count() == odd.count()
    assert rows[3].n_words == 0 and rows[3].base_failed and not rows[3].kept
    assert rows[6].n_words == 60_000
    out = quality.clean(odd)
    assert out.columns == odd.columns
    assert quality.judge(empty).count() == 0 and quality.clean(empty).count() == 0
