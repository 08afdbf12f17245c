"""DartMinHash kernel in numpy: sparse weighted signatures.

Darts are a Poisson process of unit intensity over (element, weight, rank),
drawn from hashes of the element, so every document sees the same darts.  An
element of weight w owns the region [0, w) of the weight axis; a document keeps,
for each of k coordinates, the dart of smallest rank that falls into its regions.
Two documents agree in a coordinate with the probability of their weighted
Jaccard similarity.

Darts are thrown up to rank t / |x| with t = k (ln k + 2), about t darts a
document whatever its length; where a coordinate stays empty the bound doubles.
"""

from __future__ import annotations

import numpy as np

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Elements and darts held at once; bounds memory, not results.
CHUNK = 20_000


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x + _G
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson_cdf(mean: float) -> np.ndarray:
    terms, total, p, n = [], 0.0, np.exp(-mean), 0
    while total < 1 - 1e-15 and n < mean + 40 * np.sqrt(mean) + 60:
        total += p
        terms.append(total)
        n += 1
        p *= mean / n
    return np.array(terms)


def _poisson(cdf: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Counts by inversion; u rarely passes the first few steps of a small mean."""
    n = (u >= cdf[0]).astype(np.int64)
    todo = np.flatnonzero(n)
    for c in cdf[1:]:
        todo = todo[u[todo] >= c]
        if not len(todo):
            break
        n[todo] += 1
    return n


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _throw(h: np.ndarray, owner: np.ndarray, weight: np.ndarray, bound: np.ndarray, k: int):
    """Darts in the regions below each owner's rank bound: owner, coordinate, rank and id."""
    parts = []
    level = 0
    while True:
        low, width = float(2**level - 1), float(2**level)
        here = weight > low
        if not here.any():
            break
        eh, eo, ew = h[here], owner[here], weight[here]
        cells = np.ceil(bound[eo]).astype(np.int64)
        cdf = _poisson_cdf(width)
        at = 0
        ends = np.cumsum(cells)
        while at < len(cells):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK)))
            c = cells[at:stop]
            m = _within(c)
            key = mix(np.repeat(mix(eh[at:stop] + np.uint64(level)), c) + m.astype(np.uint64) * _M2)
            n = _poisson(cdf, _unit(mix(key)))
            dart = mix(np.repeat(key, n) + (_within(n) + 1).astype(np.uint64) * _M1)
            rank = np.repeat(m, n) + _unit(mix(dart))
            place = low + width * _unit(mix(dart ^ _M2))
            o = np.repeat(np.repeat(eo[at:stop], c), n)
            w = np.repeat(np.repeat(ew[at:stop], c), n)
            ok = (rank <= bound[o]) & (place < w)
            parts.append((o[ok], (mix(dart ^ _M1) % np.uint64(k)).astype(np.int64)[ok], rank[ok], dart[ok]))
            at = stop
        level += 1
    return tuple(np.concatenate(x) for x in zip(*parts))


def signatures(elements: list[np.ndarray], k: int, weights: list[np.ndarray] | None = None) -> np.ndarray:
    """A (documents, k) array of dart ids; every document needs an element of positive weight.

    Without weights each element weighs 1; an element named twice counts once.
    """
    out = np.zeros((len(elements), k), np.uint64)
    todo = np.arange(len(elements))
    sizes = np.array([len(e) if weights is None else float(np.sum(weights[i])) for i, e in enumerate(elements)], np.float64)
    bound = k * (np.log(k) + 2) / np.maximum(sizes, 1e-300)
    while len(todo):
        again = []
        at = 0
        while at < len(todo):
            stop, n = at, 0
            while stop < len(todo) and (stop == at or n + len(elements[todo[stop]]) <= CHUNK):
                n += len(elements[todo[stop]])
                stop += 1
            docs = todo[at:stop]
            h = mix(np.concatenate([elements[i] for i in docs]).astype(np.uint64))
            owner = np.repeat(np.arange(len(docs)), [len(elements[i]) for i in docs])
            w = np.ones(len(h)) if weights is None else np.concatenate([np.asarray(weights[i], np.float64) for i in docs])
            o, c, rank, dart = _throw(h, owner, w, bound[docs], k)
            first = np.argsort(-rank, kind="stable")
            cell = (o * k + c)[first]
            own, seen = np.zeros(len(docs) * k, np.uint64), np.zeros(len(docs) * k, bool)
            own[cell], seen[cell] = dart[first], True
            full = seen.reshape(-1, k).all(axis=1)
            out[docs[full]] = own.reshape(-1, k)[full]
            again.append(docs[~full])
            at = stop
        todo = np.concatenate(again)
        bound[todo] *= 2
    return out


def bands(signature: np.ndarray, n_bands: int) -> np.ndarray:
    """One hash per band of consecutive coordinates, as signed 64-bit integers."""
    rows = signature.shape[1] // n_bands
    parts = signature[:, : n_bands * rows].reshape(len(signature), n_bands, rows)
    h = np.full(parts.shape[:2], 17, np.uint64)
    for r in range(rows):
        h = mix(h ^ parts[:, :, r])
    return h.view(np.int64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, given the words' hashes; a shorter text is one run."""
    w = mix(np.asarray(words, np.int64).view(np.uint64))
    n = max(1, len(w) - size + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(size, len(w))):
        h = mix(h * _M2 + w[j : j + n])
    return h
