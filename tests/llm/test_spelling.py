"""Spelling variants against a comparison of all pairs."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from helpers import CLASHING, frame

from parkops.llm import spelling
from parkops.llm.common import read

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(docs, every=31, length=7, least=2):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= length:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least}


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n, pairs, times=10):
    near = {w: [] for w in n}
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= times * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def all_pairs(n):
    return [(a, b) for a, b in combinations(n, 2) if abs(len(a) - len(b)) <= 1 and distance_one(a, b)]


def random_words(rng, k, letters="abeé"):
    """Few letters, so that most words have near ones, and words that are edits of others."""
    out = {"".join(rng.choice(letters) for _ in range(rng.randrange(7, 10))) for _ in range(k)}
    for w in list(out)[:k // 3]:
        i = rng.randrange(len(w))
        out |= {w[:i] + rng.choice("zÿa×") + w[i:], w[:i] + w[i + 1:], w[:i] + rng.choice("qøe") + w[i + 1:]}
    return sorted(w for w in out if len(w) >= 7)


def as_rows(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("block, per_task", [(50_000, 100_000), (20, 500)])
def test_variants_equal_all_pairs(spark, monkeypatch, block, per_task):
    whole = spelling.links
    monkeypatch.setattr(spelling, "links", lambda words: whole(words, block, per_task))
    rng = random.Random(12)
    n = {w: int(10 ** rng.uniform(0.4, 6)) for w in random_words(rng, 500)}
    n |= {"a" * 7 + "b" * 400: 3, "a" * 7 + "b" * 401: 40}   # long ones
    df = spark.createDataFrame([(w, c, "x", "y") for w, c in n.items()], "word string, n long, cell string, role string").repartition(3)
    want = brute_variants(n, all_pairs(n))
    got = spelling.variants(df)
    assert got.count() == len(n) and as_rows(got) == want
    assert sum(r[2] not in (r[0], r[1]) for r in want) > 10   # chains of more than one form


def test_each_pair_is_found_once(spark):
    rng = random.Random(4)
    words = random_words(rng, 300, "ab")
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = Counter((r.word, r.near) for r in spelling.links(df, block=30).collect())
    assert set(got.values()) == {1}
    assert set(got) == {p for a, b in all_pairs(words) for p in ((a, b), (b, a))}


def test_search_is_whole_in_small_blocks():
    rng = random.Random(6)
    words = [w.encode("latin-1") for w in random_words(rng, 400)]
    counts, roots = spelling.letter_counts(words), np.zeros(len(words), np.int64)
    trie = spelling.Trie(roots, counts)
    found = [set(), set()]
    for seen, block in zip(found, (7, 10_000)):
        for p, m in trie.search(roots, counts, np.ones(len(words), np.int64), block):
            seen |= set(zip(p.tolist(), m.tolist()))
    assert found[0] == found[1]
    more, less = ((np.maximum(s * (counts[None] - counts[:, None]), 0)).sum(2) for s in (1, -1))
    assert found[0] == set(zip(*(x.tolist() for x in np.nonzero((more <= 1) & (less <= 1)))))


def test_counted_words(spark):
    rng = random.Random(9)
    vocabulary = random_words(rng, 60, "abcdefgÀé")
    texts = [(i, " ,1".join(rng.choice(vocabulary).title() for _ in range(rng.randrange(0, 80)))) for i in range(200)]
    texts += [(None, "Variant variant VARIANT"), (None, None), (5, ""), (7, "Übermäßig übermäßig Übermäßig ×÷×÷×÷×÷ ×÷×÷×÷×÷ ĀbcdefgĀ"),
              (8, "x" * 30_000), (8, "x" * 30_000), texts[0], texts[0]]
    df = frame(spark, [(i, t, None, None) for i, t in texts], [*CLASHING, "word"])
    for every in (31, 3, None):
        got = {r.word: r.n for r in spelling.count_words(df, spoil_every=every).collect()}
        assert got == brute_words(texts, every)


def test_empty(spark):
    assert spelling.variants(spelling.count_words(frame(spark, []))).count() == 0
    one = spelling.variants(spark.createDataFrame([("lonely", 2)], "word string, n long"))
    assert as_rows(one) == {("lonely", None, "lonely", 2, 0, None)}


def test_query_over_all_documents(spark):
    from parkops.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    n = brute_words([(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()])
    gaps = {}   # words that share a word with a letter taken out, or are that word
    for w in n:
        for i in range(len(w)):
            gaps.setdefault(w[:i] + "_" + w[i + 1:], set()).add(w)
            gaps.setdefault(w[:i] + w[i + 1:], set()).add(w)
        gaps.setdefault(w, set()).add(w)
    pairs = {p for s in gaps.values() for p in combinations(sorted(s), 2) if distance_one(*p)}
    got = QUERIES["op12_spelling_variants"](spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert as_rows(got) == brute_variants(n, pairs) and got.count() == len(n) > 1000
