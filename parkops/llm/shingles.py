"""Word shingles as 64-bit hashes, and ProbMinHash signatures of them."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_CACHE_WORDS = 300_000   # word hashes kept by one worker; a full cache starts anew
#: Odd multipliers, one a position (fixed values).
_POSITION = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                     dtype=np.uint64)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text (sorted hashes) and how often each occurs.

    Words are split at ASCII white space and lower-cased; a text of one to four
    words is one shingle; a null text or one without words has none."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < WIDTH:
        h = np.array([(w * _POSITION[:n]).sum(dtype=np.uint64) + np.uint64(n)], dtype=np.uint64)
    else:
        h = w[:n - 4] * _POSITION[0]
        for i in range(1, WIDTH):
            h += w[i:n - WIDTH + 1 + i] * _POSITION[i]
    return np.unique(mix(h), return_counts=True)


def prob_minhash(elements: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """ProbMinHash signature: per component the element that arrives first.

    Each element is a Poisson process whose rate is its weight; each arrival
    hits one component.  Two signatures agree in a component with probability
    Jaccard.  Arrivals are drawn only up to a horizon that covers all
    components; later ones can't be first, so drawing ends early.  Should a
    component stay empty, the horizon is doubled; the result does not depend on
    the horizon."""
    total, n = float(weights.sum()), len(elements)
    points = m * (np.log(m) + 3)
    while True:
        horizon = points / total
        block = int(points / n + 2 * np.sqrt(points / n)) + 1   # most elements need no second round
        live, last, scale, drawn = elements, np.zeros(n), 1.0 / weights, 0
        found = []
        while len(live):
            steps = (np.arange(drawn + 1, drawn + block + 1, dtype=np.uint64) * _GOLDEN)[None, :]
            bits = mix(live[:, None] + steps)
            gap = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) * scale[:, None]
            at = last[:, None] + np.cumsum(gap, axis=1)
            row, col = np.nonzero(at < horizon)
            part = ((mix(bits[row, col]) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            found.append((at[row, col], part.astype(np.int64), live[row]))
            last = at[:, -1]
            on = last < horizon
            live, last, scale, drawn = live[on], last[on], scale[on], drawn + block
        at, part, who = (np.concatenate(x) for x in zip(*found))
        latest_first = np.argsort(-at, kind="stable")
        out, hit = np.zeros(m, np.uint64), np.zeros(m, bool)
        out[part[latest_first]] = who[latest_first]
        hit[part] = True
        if hit.all():
            return out
        points *= 2


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band (the band's number is part of it)."""
    parts = signature.reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN
    for i in range(rows):
        h = mix(h ^ parts[:, i]) + _GOLDEN
    return h.view(np.int64)
