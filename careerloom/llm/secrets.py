"""Secret scans: base patterns, and a character convolutional network for the rest.

Candidates are runs of 16 or more of ``[A-Za-z0-9+/_.=-]``.  Each candidate and its
surrounding context go through a small network: character embedding with a flag
for candidate or context, one convolution, global maximum and mean pooling, one
logistic output.  It is trained in numpy on labelled findings: generated ones of
common secret formats and of harmless look-alikes, and candidates of a bounded
sample of the corpus, those that a base pattern finds and those of letters only.
A fifth of the findings is kept aside: Platt scaling on one half of it calibrates the
network, and the threshold is the largest that keeps RECALL of the positives of the
other half that lie in no base span, for only such candidates are scored.

The network only adds spans (kind ``cnn``); base spans stay as they are.  All
offsets are code points.

Defined results: null text counts as empty and has no span; repeated rows get
equal results; an empty table gives an empty result; other columns pass through; a column named
like a result is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from careerloom.llm.shared import bound_batches, extended

KINDS = ("assign", "access", "hex", "cnn")
#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")

LEFT, BODY, RIGHT = 20, 48, 8
RECALL = 0.97
#: Candidates of the corpus that the fit uses at most, and documents they are drawn from.
FIT_CANDIDATES, FIT_DOCS = 3000, 2000
#: Generated findings of the fit.
GENERATED = 4000
_WIDTH, _EMBED, _FILTERS = 5, 8, 24


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base findings, sorted."""
    found = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    # a hex run of 24 lies in a run of 16 of the wider class
    for run in _RUN.finditer(text):
        if run.end() - run.start() >= HEX_LEAST:
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, run.start(), run.end()) if m.end() - m.start() >= HEX_LEAST]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Candidate runs, without dots and dashes at their ends."""
    out = []
    for m in _RUN.finditer(text):
        body = m[0].strip(".-")
        if len(body) >= 16:
            start = m.start() + len(m[0]) - len(m[0].lstrip(".-"))
            out.append((start, start + len(body)))
    return out


def _codes(text: str) -> np.ndarray:
    """Printable ASCII as 2..96, other white space 1, the rest 97; 0 pads."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((c >= 32) & (c < 127), c - 30, np.where(c < 32, 1, 97)).astype(np.int8)


def windows(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, np.ndarray]]:
    """(span number, codes and flags); a candidate longer than BODY has several windows."""
    out = []
    for i, (start, stop) in enumerate(spans):
        for at in range(start, stop, BODY):
            end = min(stop, at + BODY)
            row = np.zeros((2, LEFT + BODY + RIGHT), np.int8)
            left, right = _codes(text[max(0, start - LEFT) : start]), _codes(text[stop : stop + RIGHT])
            row[0, LEFT - len(left) : LEFT] = left
            row[0, LEFT : LEFT + end - at] = _codes(text[at:end])
            row[1, LEFT : LEFT + end - at] = 1
            row[0, LEFT + BODY : LEFT + BODY + len(right)] = right
            out.append((i, row))
            if end == stop:
                break
    return out


@dataclass
class Net:
    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    threshold: float = 0.5
    scale: tuple[float, float] = (1.0, 0.0)

    @staticmethod
    def fresh() -> Net:
        rng = np.random.Generator(np.random.PCG64(3))
        return Net(
            rng.normal(0, 0.5, (98, _EMBED)), rng.normal(0, 0.3, (_WIDTH * (_EMBED + 1), _FILTERS)), np.zeros(_FILTERS), rng.normal(0, 0.1, 2 * _FILTERS + 1)
        )

    def _forward(self, x: np.ndarray):
        chars, flag = x[:, 0].astype(np.int64), x[:, 1].astype(np.float64)
        e = np.concatenate([self.embed[chars], flag[:, :, None]], axis=2)
        n = e.shape[1] - _WIDTH + 1
        cols = np.concatenate([e[:, j : j + n] for j in range(_WIDTH)], axis=2)
        z = cols @ self.conv + self.bias
        a = np.maximum(z, 0)
        top = a.argmax(1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(1), np.ones((len(x), 1))], axis=1)
        return chars, cols, z, a, top, pooled, pooled @ self.out

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[-1] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(x) + b, -40, 40)))

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weighted logistic loss."""
        chars, cols, z, a, top, pooled, logit = self._forward(x)
        d = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) * weight / len(x)
        d_out = pooled.T @ d
        d_pool = d[:, None] * self.out[None]
        d_a = np.repeat(d_pool[:, None, _FILTERS : 2 * _FILTERS] / z.shape[1], z.shape[1], axis=1)
        rows = np.arange(len(x))[:, None]
        d_a[rows, top, np.arange(_FILTERS)[None]] += d_pool[:, :_FILTERS]
        d_z = d_a * (z > 0)
        d_conv = np.tensordot(cols, d_z, axes=([0, 1], [0, 1]))
        d_cols = d_z @ self.conv.T
        d_embed = np.zeros_like(self.embed)
        n, size = z.shape[1], _EMBED + 1
        for j in range(_WIDTH):
            np.add.at(d_embed, chars[:, j : j + n], d_cols[:, :, j * size : j * size + _EMBED])
        return [d_embed, d_conv, d_z.sum((0, 1)), d_out]


def fit(x: np.ndarray, y: np.ndarray, covered: np.ndarray | None = None, epochs: int = 8) -> Net:
    """Train, calibrate and set the threshold; every fifth finding is kept aside.

    ``covered`` marks findings inside a base span, which never meet the threshold.
    """
    net, rng = Net.fresh(), np.random.Generator(np.random.PCG64(4))
    order = rng.permutation(len(x))
    aside, own = order[::5], np.delete(order, slice(None, None, 5))
    weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    params = [net.embed, net.conv, net.bias, net.out]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        rng.shuffle(own)
        for at in range(0, len(own), 64):
            part = own[at : at + 64]
            t += 1
            for p, g, a, b in zip(params, net.step(x[part], y[part], weight[part]), m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 0.01 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    scaling, cut = aside[::2], aside[1::2]
    raw, truth = net.logits(x[scaling]), y[scaling]
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt scaling by gradient steps
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -40, 40)))
        a -= 0.05 * float(((p - truth) * raw).mean())
        b -= 0.05 * float((p - truth).mean())
    net.scale = (max(a, 1e-3), b)
    alone = y[cut] == 1 if covered is None else (y[cut] == 1) & ~covered[cut]
    positive = np.sort(net.probability(x[cut][alone]))
    net.threshold = float(positive[int((1 - RECALL) * len(positive))]) if len(positive) else 1.0
    return net


_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def generated_findings(count: int = GENERATED, seed: int = 6) -> tuple[list[np.ndarray], list[int]]:
    """Labelled findings of a fixed seed: secret formats (1) and harmless look-alikes (0) in context."""
    rows, labels, _ = _generated(count, seed)
    return rows, labels


def _generated(count: int, seed: int) -> tuple[list[np.ndarray], list[int], list[bool]]:
    """Generated findings: windows, labels, and whether a base span holds the candidate."""
    rng = np.random.Generator(np.random.PCG64(seed))
    draw = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    between = lambda a, b: int(rng.integers(a, b + 1))
    every = _LOWER + _UPPER + _DIGIT
    word = lambda a=2, b=9: draw(_LOWER, between(a, b))
    # Prefixes of public token formats and the alphabets that follow them.
    secret = [
        lambda: "ghp_" + draw(every, 36), lambda: "xoxb-" + draw(_DIGIT, 12) + "-" + draw(every, 24), lambda: "sk_live_" + draw(every, 24), lambda: "AIza" + draw(every + "_-", 35),
        lambda: "eyJ" + draw(every, between(20, 60)) + "." + draw(every + "_-", between(20, 60)), lambda: draw(every + "+/", between(24, 64)), lambda: draw(every, between(20, 48)),
        lambda: draw(_DIGIT + "abcdef", between(24, 64)), lambda: "AKIA" + draw(_UPPER + _DIGIT, 16), lambda: draw(_UPPER + _DIGIT, between(20, 40)), lambda: "glpat-" + draw(every, 20),
        lambda: draw(every + "+/", between(30, 60)) + "=",
    ]
    harmless = [
        lambda: draw(_LOWER, between(16, 30)), lambda: draw(_UPPER, 1) + draw(_LOWER, between(15, 30)), lambda: "-".join(word() for _ in range(4)) + "-" + word(), lambda: "/".join(word(3) for _ in range(5)),
        lambda: ".".join(word(3) for _ in range(3)) + ".example.com", lambda: draw(_DIGIT, between(16, 22)), lambda: "_".join(word(4) for _ in range(4)), lambda: "-" * between(16, 40), lambda: "=" * between(16, 60),
        lambda: word(4) + "." + word(4) + "/" + word(4) + "." + draw(_DIGIT, 2), lambda: word(3) + "".join(draw(_UPPER, 1) + word(3, 7) for _ in range(3)), lambda: "_" * between(16, 40), lambda: "." * between(16, 40),
        lambda: "".join((lambda s: s * between(4, 9))(draw(_LOWER, between(1, 4))).ljust(16, "a") for _ in range(1)), lambda: "2024-" + draw(_DIGIT, 2) + "-" + draw(_DIGIT, 2) + "T" + draw(_DIGIT, 2) + "-00-00.000",
        lambda: draw(_UPPER, between(16, 28)),
    ]
    rows, labels, covered = [], [], []
    for i in range(count):
        y = i % 2
        make = (secret if y else harmless)[(i // 2) % len(secret if y else harmless)]
        body = make()
        lead = " ".join(word() for _ in range(4)) + [" ", " = ", ": ", ' "', "\n", " key="][between(0, 5)]
        text = lead + body + [" ", "\n", '"', ". ", ""][between(0, 4)] + " ".join(word() for _ in range(3))
        got = windows(text, [(len(lead), len(lead) + len(body))])
        rows.append(got[0][1])
        labels.append(y)
        covered.append(_inside(len(lead), len(lead) + len(body), base_spans(text)))
    return rows, labels, covered


def _inside(start: int, stop: int, base: list[tuple[int, int, int]]) -> bool:
    return any(a <= start and stop <= b for a, _, b in base)


def _labelled(texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
    """Labelled candidates of texts: 2 inside a base finding, 1 where one overlaps them, 0 where they are letters only.

    Other candidates may be secrets of an unknown format and stay unlabelled.
    """
    rows, labels = [], []
    for t in texts:
        base, spans = base_spans(t), candidates(t)
        for i, w in windows(t, spans):
            start, stop = spans[i]
            found = any(s < stop and e > start for s, _, e in base)
            if found or t[start:stop].isalpha():
                rows.append(w)
                labels.append(2 if _inside(start, stop, base) else int(found))
    return rows, labels


def train(df: DataFrame, *, doc: str = "doc_id", text: str = "text") -> Net:
    """Fit on generated findings and on a bounded sample of the corpus's candidates."""
    bound_batches(df.sparkSession)
    total = df.count()
    share = int(min(1.0, FIT_DOCS / max(1, total)) * (1 << 30))

    @pandas_udf("array<binary>")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            rows, labels = _labelled([t])
            out.append([bytes([y]) + r.tobytes() for r, y in zip(rows, labels)])
        return pd.Series(out, dtype=object)

    drawn = df.where(F.col(text).isNotNull() & F.col(text).rlike(_RUN.pattern)).where(F.pmod(F.xxhash64(F.lit(9), doc, text), F.lit(1 << 30)) < share)
    cells = drawn.select(F.explode(cut(F.col(text))).alias("cell"))
    own = cells.orderBy(F.xxhash64("cell"), "cell").limit(FIT_CANDIDATES).collect()
    rows, labels, covered = _generated(GENERATED, 6)
    for r in own:
        rows.append(np.frombuffer(bytes(r[0][1:]), np.int8).reshape(2, -1))
        labels.append(min(1, r[0][0]))
        covered.append(r[0][0] == 2)
    return fit(np.stack(rows), np.array(labels, float), np.array(covered, bool))


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], net: Net) -> list[list[tuple[int, int, int]]]:
    """Spans that the network adds to each text's base spans: of all candidates but those inside a base span."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    where, rows = [], []
    for i, (t, found) in enumerate(zip(texts, base)):
        spans = [(s, e) for s, e in candidates(t) if not _inside(s, e, found)]
        for j, w in windows(t, spans):
            where.append((i, spans[j]))
            rows.append(w)
        if len(rows) >= 4096 or (i == len(texts) - 1 and rows):
            hits = {where[k] for k in np.flatnonzero(net.probability(np.stack(rows)) >= net.threshold)}
            for doc, (s, e) in sorted(hits):
                out[doc].append((s, 3, e))
            where, rows = [], []
    if rows:
        hits = {where[k] for k in np.flatnonzero(net.probability(np.stack(rows)) >= net.threshold)}
        for doc, (s, e) in sorted(hits):
            out[doc].append((s, 3, e))
    return out


def scan(df: DataFrame, net: Net, *, text: str = "text") -> DataFrame:
    """``df`` with base_spans and spans: strings of kind:start:stop, sorted and comma-joined."""
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(net)

    @pandas_udf("base_spans string, spans string")
    def find(texts: pd.Series) -> pd.DataFrame:
        body = [t or "" for t in texts]
        base = [base_spans(t) for t in body]
        more = added_spans(body, base, shared.value)
        line = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        return pd.DataFrame({"base_spans": [line(b) for b in base], "spans": [line(sorted(b + m)) for b, m in zip(base, more)]})

    return extended(df, find(F.col(text)), ["base_spans", "spans"])


def redact(df: DataFrame, net: Net, *, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every found span replaced by ``mark``; same columns."""
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(net)

    @pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        body = [t or "" for t in texts]
        base = [base_spans(t) for t in body]
        more = added_spans(body, base, shared.value)
        out = []
        for raw, t, spans in zip(texts, body, map(lambda p: sorted(p[0] + p[1]), zip(base, more))):
            parts, at = [], 0
            for s, _, e in spans:
                if e > at:
                    if s >= at:
                        parts += [t[at:s], mark]
                    at = e
            out.append(None if raw is None else "".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    out = df.withColumn(text, masked(F.col(text)))
    return out.withColumn("n_chars", F.length(text).cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else out
