"""Language identification by string kernels.

The kernel of two texts counts the n-grams (n = 1, 2, 3) that are present in both
(blended-spectrum presence kernel), normalised by the geometric mean of their own
counts, all over the n-grams of the landmarks.  Landmark texts give a Nyström map; one-versus-rest kernel ridge
regression in that map gives one score a language, and a temperature fitted on
rows kept aside turns scores into probabilities.  Scoring is batched: presence
rows of many texts times the landmarks' presence matrix, times the fitted
weights.

N-grams are hashed into BUCKETS, and the columns are the buckets that the landmarks
hit, so letters of any script count and no letter table has an end.  Everything that
is no letter is one boundary symbol, and case is folded.  The fit uses a bounded
sample: FIT_ROWS labelled texts shared equally among all labelled languages (at least
two of each), drawn by hash, of each a window of at most FIT_CHARS characters at a
drawn place; LANDMARKS of them, at least one a language, are landmarks.  Scoring reads
whole texts of every row; long texts and many texts go through in pieces of at most
PIECE characters and CELLS presence cells, which bound the memory and not the result.

Defined results: null text and text without a letter give ``und`` with score 0;
a text that shares no n-gram with a landmark ties between all languages; a table
without a labelled row gives ``und`` for all; ties go to the first language by name;
repeated rows get equal results; other columns pass through; a column named like a
result is replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from careerloom.llm.shared import bound_batches, extended

UNKNOWN = "und"
FIT_ROWS, FIT_CHARS, LANDMARKS = 2400, 20_000, 192
#: Labels whose counts are broadcast.
BROADCAST_LANGUAGES = 20_000
BUCKETS = 1 << 18
PIECE, CELLS = 1 << 19, 1 << 22
RIDGE = 1e-3
_BATCH = 256
#: Odd multipliers of the multiply-shift hash, one for each place of an n-gram, and one for each n.
_PLACE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_SHIFT = np.uint64(64 - 18)


@functools.cache
def _folded() -> np.ndarray:
    """Code point to its lower-case letter plus one; 1 for what is no letter."""
    out = np.ones(0x110000, np.uint32)
    for c in filter(str.isalpha, map(chr, range(0x110000))):
        low = c.lower()
        out[ord(c)] = ord(low if len(low) == 1 else c) + 1
    return out


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers and texts in groups of about PIECE characters; parts of a longer text overlap by two."""
    rows, parts, n = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - 2), PIECE):
            part = t[at : at + PIECE + 2]
            if parts and n + len(part) > PIECE:
                yield rows, parts
                rows, parts, n = [], [], 0
            rows.append(i)
            parts.append(part)
            n += len(part)
    if parts:
        yield rows, parts


def _hits(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every 1-, 2- and 3-gram."""
    for rows, parts in _pieces(texts):
        raw = "\0".join(parts).encode("utf-32-le", "surrogatepass")
        ids = _folded()[np.frombuffer(raw, np.uint32)]
        sizes = np.array([len(t) for t in parts], np.int64)
        owner = np.repeat(np.array(rows, np.int64), sizes + 1)[: len(ids)]
        ids[np.cumsum(sizes + 1)[:-1] - 1] = 0
        code, known = np.zeros(len(ids), np.uint64), np.ones(len(ids), bool)
        for n in range(3):
            here = ids[n:]
            known = known[: len(here)] & (here > 0)
            code = code[: len(here)] + here * _PLACE[n]
            key = ((code ^ (code >> np.uint64(31))) * _PLACE[(n + 1) % 3]) >> _SHIFT
            yield owner[: len(here)][known], key[known].astype(np.int64)


@dataclass
class Grams:
    """Maps texts to presence rows over the buckets of the landmarks' n-grams."""

    column: np.ndarray  # bucket -> column, or the last one
    size: int

    def presence(self, texts: list[str]) -> np.ndarray:
        """(texts, size + 1) of 0 and 1; the last column, for n-grams of no landmark, stays 0."""
        out = np.zeros((len(texts), self.size + 1), np.uint8)
        for row, key in _hits(texts):
            out[row, self.column[key]] = 1
        out[:, self.size] = 0
        return out

    def batches(self, texts: list[str]) -> Iterator[list[str]]:
        step = max(1, min(_BATCH, CELLS // (self.size + 1)))
        return (texts[at : at + step] for at in range(0, len(texts), step))


def fit_grams(texts: list[str]) -> Grams:
    seen = np.zeros(BUCKETS, bool)
    for _, key in _hits(texts):
        seen[key] = True
    column = np.full(BUCKETS, seen.sum(), np.int32)
    column[seen] = np.arange(seen.sum())
    return Grams(column, int(seen.sum()))


@dataclass
class Model:
    grams: Grams
    landmarks: np.ndarray  # (grams, landmarks) presence
    norms: np.ndarray  # square roots of the landmarks' counts
    weights: np.ndarray  # (landmarks, languages)
    languages: list[str]
    temperature: float

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Normalised kernel values with every landmark; only columns that the batch hits are multiplied."""
        parts = [np.zeros((0, len(self.norms)), np.float32)]
        for batch in self.grams.batches(texts):
            rows = self.grams.presence(batch)[:, :-1]
            used = np.flatnonzero(rows.any(0))
            near = rows[:, used].astype(np.float32)
            parts.append((near @ self.landmarks[used].astype(np.float32)) / self.norms / np.sqrt(np.maximum(near.sum(1, keepdims=True), 1)))
        return np.concatenate(parts)

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernel(texts) @ self.weights

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return _softmax(self.scores(texts) * self.temperature)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        some = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if some:
            p = self.probabilities([texts[i] for i in some])
            for i, j, best in zip(some, p.argmax(1), p.max(1)):
                lang[i], score[i] = self.languages[j], float(min(1.0, best))
        return lang, score


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str], langs: list[str]) -> Model:
    """Fit on labelled texts; every fourth text of a language is kept for the temperature."""
    names = sorted(set(langs))
    order = _interleaved(langs)
    marks = [texts[i] for i in order[: max(LANDMARKS, len(names))]]
    grams = fit_grams(marks)
    rows = np.concatenate([grams.presence(batch)[:, :-1] for batch in grams.batches(marks)])
    norms = np.sqrt(np.maximum(rows.sum(1, dtype=np.int64), 1)).astype(np.float32)
    model = Model(grams, rows.T.copy(), norms, np.zeros((len(marks), len(names))), names, 1.0)
    k, among = model.kernel(texts).astype(np.float64), model.kernel(marks).astype(np.float64)
    value, vector = np.linalg.eigh((among + among.T) / 2)
    good = value > 1e-6 * value.max()
    nystrom = vector[:, good] / np.sqrt(value[good])
    target = np.array([names.index(x) for x in langs])
    aside = np.array([rank % 4 == 3 for rank in _ranks(langs)])
    if len(names) == 1:
        aside[:] = False
    phi, y = k @ nystrom, 2.0 * np.eye(len(names))[target] - 1
    fitted, held = phi[~aside], phi[aside]
    solve = np.linalg.solve(fitted.T @ fitted + RIDGE * len(fitted) * np.eye(fitted.shape[1]), fitted.T @ y[~aside])
    model.weights = (nystrom @ solve).astype(np.float32)
    if len(held):
        raw, grid = held @ solve, [1, 2, 3, 4, 6, 8, 12, 16]
        loss = [-np.log(np.maximum(_softmax(raw * t)[np.arange(len(held)), target[aside]], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def _ranks(langs: list[str]) -> list[int]:
    """Each text's number among those of its language."""
    seen: dict[str, int] = {}
    ranks = []
    for x in langs:
        ranks.append(seen.get(x, 0))
        seen[x] = ranks[-1] + 1
    return ranks


def _interleaved(langs: list[str]) -> list[int]:
    """Indices with the languages taking turns."""
    ranks = _ranks(langs)
    return sorted(range(len(langs)), key=lambda i: (ranks[i], langs[i]))


def training_sample(df: DataFrame, *, doc: str, text: str, lang: str, rows: int = FIT_ROWS) -> DataFrame:
    """About ``rows`` labelled texts (text, lang, _rank), equally many a language, by hash order; long ones as a window."""
    labelled = df.where(F.col(lang).isNotNull()).select(F.col(doc).alias("_doc"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    counts = labelled.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"))  # reads the labels alone
    n_languages = counts.count()
    each = max(2, rows // max(1, n_languages))
    # a row a language: beside the texts where their number is checked, through a shuffle beyond it
    known = counts.withColumnRenamed("_lang", "_of")
    drawn = (
        labelled.where(F.col("_text").rlike(r"\p{L}"))
        .withColumn("_draw", F.pmod(F.xxhash64(F.lit(5), "_doc", "_text"), F.lit(1 << 30)))
        .join(F.broadcast(known) if n_languages <= BROADCAST_LANGUAGES else known, F.col("_lang") == F.col("_of"))
        # twice the wanted number on average: the exact cut follows on these few rows
        .where(F.col("_draw") * F.col("_n") < F.lit((2 * each + 8) * (1 << 30)))
    )
    place = (F.col("_draw") % F.greatest(F.lit(1), F.length("_text") - FIT_CHARS + 1)).cast("int") + 1
    w = W.partitionBy("_lang").orderBy("_draw", F.col("_doc").asc_nulls_first())
    ranked = drawn.select("_doc", "_lang", "_draw", F.substring("_text", place, F.lit(FIT_CHARS)).alias("_text")).withColumn("_rank", F.row_number().over(w))
    return ranked.where((F.col("_rank") <= each) & F.col("_text").rlike(r"\p{L}")).select(F.col("_text").alias("text"), F.col("_lang").alias("lang"), "_rank")


def train(df: DataFrame, *, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    sample = training_sample(df, doc=doc, text=text, lang=lang).toPandas().sort_values(["lang", "_rank"])
    return fit(sample["text"].tolist(), sample["lang"].tolist()) if len(sample) else None


def identify(df: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score."""
    bound_batches(df.sparkSession)
    if model is None:
        return extended(df, F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")), ["lang_pred", "score"])
    shared = df.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        lang, score = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return extended(df, predict(F.col(text)), ["lang_pred", "score"])
