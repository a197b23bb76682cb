"""Runs of words against a brute-force search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from helpers import CLASHING, frame, words

from parkops.llm import periodic_runs
from parkops.llm.common import read


def brute_runs(text, powers=4, least=6):
    """Every period in turn; a stretch already found with a smaller one has that one."""
    numbers = {}
    w = np.array([numbers.setdefault(x, len(numbers)) for x in text], int)
    found = {}
    for q in range(1, len(w) // powers + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[0], (w[:-q] == w[q:]).astype(int), [0]])))
        for start, end in zip(same[::2].tolist(), same[1::2].tolist()):
            if end - start + q >= max(least, powers * q):
                found.setdefault((start, end + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def random_texts(rng, n):
    for _ in range(n):
        kind, out = rng.randrange(4), []
        for _ in range(rng.randrange(1, 7)):
            base = [f"w{rng.randrange(2 if kind else 30)}" for _ in range(rng.randrange(1, 9))]
            base *= rng.randrange(1, 9) if kind else rng.choice((1, 1, 3, 4, 5))
            out += base[:len(base) - rng.randrange(0, 3)] + [f"u{rng.randrange(10 ** 6)}"] * (kind == 2)
        yield " ".join(out)


@pytest.mark.parametrize("powers, least", [(4, 6), (3, 3), (5, 12)])
def test_runs_equal_brute_force(powers, least):
    texts = [split(t) for t in random_texts(random.Random(powers), 1500)]
    got = periodic_runs.runs_of([[w.encode() for w in t] for t in texts], powers, least)
    want = [brute_runs(t, powers, least) for t in texts]
    assert got == want
    assert sum(map(len, want)) > 300 and max(len(r) for r in want) > 3


def test_long_texts():
    rng = random.Random(5)
    once = words(rng, 40_000, 300)
    period = words(rng, 9_000, 300)
    text = once + period * 5 + once[:100] * 7 + ["x"] * 5000
    got = periodic_runs.runs_of([[w.encode() for w in text]], 4, 6)[0]
    assert (40_000, 45_000, 9_000) in [(s, n - n % 9000, q) for s, n, q in got]
    assert all(text[s:s + n - q] == text[s + q:s + n] for s, n, q in got)
    small = text[84_000:90_000]
    assert periodic_runs.runs_of([[w.encode() for w in small]], 4, 6)[0] == brute_runs(small)


def test_splitting_leaves_little_of_prose():
    rng = random.Random(7)
    w = np.array([int(500 * rng.random() ** 2) if rng.random() < 0.9 else 1000 + i for i in range(20_000)])
    w[5000:5060] = [1, 2, 3] * 20
    left = periodic_runs.split_by_frequency(w, np.zeros(len(w), int), 4, 6)
    assert set(range(5000, 5060)) <= set(left.tolist()) and len(left) < 300


def check(got, data):
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed) for r in got), key=key) == \
        sorted(((i, len(split(t)), brute_runs(split(t)), strongest(split(t)), collapsed(split(t))) for i, t, *_ in data), key=key)


def strongest(text):
    runs = brute_runs(text)
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None


def collapsed(text):
    gone = {i for s, n, q in brute_runs(text) for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(text) if i not in gone)


def test_rows_nulls_repeats_and_clashing_names(spark):
    rng = random.Random(11)
    data = [(i, t, "en", "a") for i, t in enumerate(random_texts(rng, 120))]
    data += [(500 + i, "la la la la la la", "en", "a") for i in range(150)]
    data += [(None, None, None, None), (None, "a b " * 9, None, None), (1, "", "en", "b"), (1, " \t\n ", "en", "b"), data[0], data[0],
             (700, "é\x0bé\x0cé é é é é\x1cé", "en", "b")]
    check(periodic_runs.find_runs(frame(spark, data, [*CLASHING, "runs", "words", "h"])).collect(), data)
    assert periodic_runs.find_runs(frame(spark, [])).count() == 0


def test_slices_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "SLICE_BYTES", 100)
    data = [(i, t, "en", "a") for i, t in enumerate(random_texts(random.Random(3), 60))]
    rows = [r for b in periodic_runs._find(4, 6)(frame(spark, data).select("doc_id", "text").toArrow().to_batches()) for r in b.to_pylist()]
    assert {r["doc_id"]: [tuple(x.values()) for x in r["runs"]] for r in rows} == {i: brute_runs(split(t)) for i, t, *_ in data}


def test_query_over_all_documents(spark):
    from parkops.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in read(spark, sf, "documents").collect():
        w, h = split(r.text), zlib.crc32(str(r.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs, best = brute_runs(w), strongest(w)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[r.doc_id] = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                          sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapsed(w)))
    got = QUERIES["op11_periodic_runs"](spark, sf)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
    assert dict(got.dtypes) == {c: "bigint" for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")} | {
        c: "string" for c in ("runs_sha256", "collapsed_sha256")}
    assert sum(v[0] > 0 for v in want.values()) > 5
