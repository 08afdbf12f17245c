"""The pipeline against the operators, stage by stage."""

import collections
import random
import re
import zlib

import numpy as np

import pytest

import corpus_pipeline
from careerloom.llm import langid, neardup, quality, secrets, tokens
from careerloom.llm.queries import TOKENIZER


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        rows = {r.doc_id: r.text for r in out.collect()}
        kept[name] = (docs, rows)
        docs = spark.createDataFrame(out.collect(), out.schema)
    before, after = kept["quality_rules"]
    assert set(after) == {r.doc_id for r in quality.judge(before).where("kept").collect()}
    before, after = kept["minhash_near_dedup"]
    assert set(after) == {r.class_id for r in neardup.classes(before).collect()}
    before, after = kept["secret_scan"]
    assert len(after) == before.count() and not any(secrets.base_spans(t) for t in after.values())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in last} == set(after)
    for r in last:
        ids = np.append(tokens.encode(after[r.doc_id], **TOKENIZER), np.uint32(0))
        assert zlib.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes()) == r.ids_crc32


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_and_empty_tables(spark, odd, empty, number):
    """Nulls, blank and long texts, repeated rows, clashing columns, no rows."""
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, odd, "")
    rows = out.collect()
    assert stage(spark, empty, "").count() == 0
    if number < 4:
        assert out.columns == odd.columns
        ids = collections.Counter(r.doc_id for r in rows)
        # repeated rows stay in every stage but near-dedup
        want = {"language_id": {1: 2, 2: 1, None: 1, 6: 1, 8: 1, 9: 1}, "quality_rules": {6: 1}, "minhash_near_dedup": dict.fromkeys([1, 3, 4, None, 5, 6, 7, 8, 9], 1), "secret_scan": {1: 2, 2: 1, 3: 1, 4: 1, None: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1}}[name]
        assert ids.keys() <= want.keys() if name == "language_id" else ids == want
        assert all(ids[k] <= want[k] for k in ids)
    else:
        assert sum(r.length for r in rows if r.doc_id == 6) == next(r.doc_tokens for r in rows if r.doc_id == 6)


def _plain_quality(docs):
    """The kept documents and their texts, in plain Python."""
    norm = lambda line: re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip()
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    held = collections.defaultdict(set)
    for _, source, text in docs:
        for line in text.split("\n"):
            if norm(line):
                held[source, norm(line)].add(text)
    out = []
    for doc, source, text in docs:
        w = split(text)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        repeated = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        often = lambda line: bool(norm(line)) and len(held[source, norm(line)]) > quality.MAX_LINE_DOCS
        lost = sum(len(split(x)) for x in text.split("\n") if often(x))
        if len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and 100 * (len(w) - lost) >= quality.MIN_KEPT_PERCENT * len(w):
            out.append((doc, "\n".join(x for x in text.split("\n") if not often(x))))
    return out


def _plain_heads(docs):
    """The smallest id of each near-duplicate class, by all pairs."""
    bags = []
    for _, text in docs:
        w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
        bags.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))))
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total():
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [d for i, d in enumerate(docs) if root[i] == i]


def test_run_equals_plain_python(spark, tmp_path):
    r = random.Random(21)
    words = {"en": [f"word{i}ing" for i in range(300)], "fr": [f"été{i}eux" for i in range(300)]}
    words = {k: ["".join(r.choice("abcdefgh" if k == "en" else "éàçstuvw") for _ in range(r.randrange(3, 9))) for _ in v] for k, v in words.items()}
    prose = lambda lang, n: "\n".join(" ".join(r.choice(words[lang]) for _ in range(20)) for _ in range(n))
    rows = []
    for i in range(60):
        lang = ("en", "fr")[i % 2]
        text = prose(lang, r.randrange(1, 9))
        if i % 3 == 0:
            text += "\nthe menu of this site as found on every page of the host"
        if i % 7 == 0:
            text += f"\npassword={i}hunter{i}x and key AKIA{'Q7' * 8} here"
        rows.append((i, text, lang, "h" if i % 3 == 0 else "g"))
    rows += [(100 + i, rows[5][1].replace(rows[5][1].split()[3 * i + 2], "edited"), "fr", "g") for i in range(3)] + [(110, rows[8][1], "en", "k"), (111, "12345 67890 !!!", None, "k"), (112, None, "en", "k")]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    model = langid.train(docs)
    lang, score = model.predict([x[1] for x in rows])
    kept = [(x[0], x[3], x[1]) for x, found, s in zip(rows, lang, score) if found != langid.UNKNOWN and s >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    kept = _plain_heads(_plain_quality(kept))
    assert 30 < len(kept) < 62
    net = secrets.train(spark.createDataFrame([(d, t) for d, t in kept], "doc_id long, text string"))
    want = {}
    for doc, text in kept:
        spans = sorted(secrets.base_spans(text) + secrets.added_spans([text], [secrets.base_spans(text)], net)[0])
        for s, _, e in reversed(spans):
            text = text[:s] + "[SECRET]" + text[e:]
        want[doc] = [*tokens.encode(text, **TOKENIZER).tolist(), 0]
    got, sequences = collections.defaultdict(list), collections.Counter()
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[x.doc_id].append((x.start, x.length, x.ids_crc32, x.doc_tokens))
        sequences[x.sequence_id] += x.length
    assert got.keys() == want.keys()
    for doc, parts in got.items():
        at = 0
        for start, n, crc, total in sorted(parts):
            assert start == at and total == len(want[doc]) and crc == zlib.crc32(np.array(want[doc][at : at + n], "<u4").tobytes())
            at += n
        assert at == len(want[doc])
    assert all(n == 1024 or n & (n - 1) == 0 for n in sequences.values())
