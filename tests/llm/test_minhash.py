import random
from itertools import combinations

import numpy as np
from helpers import CLASHING, frame, words
from parkops.llm import minhash
from parkops.llm.components import components
from parkops.llm.shingles import prob_minhash, shingles


def rows():
    rng = random.Random(10)
    texts = []
    for _ in range(60):
        w = words(rng, rng.randrange(30, 200))
        texts.append(w)
        for _ in range(rng.randrange(0, 4)):
            edited = list(w)
            for _ in range(rng.randrange(0, 6)):
                edited[rng.randrange(len(edited))] = "edit"
            texts.append(edited)
    hot = words(rng, 120)
    for _ in range(120):     # a large group of near copies around the threshold
        edited = list(hot)
        for _ in range(rng.randrange(0, 5)):
            edited[rng.randrange(len(edited))] = f"x{rng.randrange(9)}"
        texts.append(edited)
    passage = words(rng, 60)
    texts += [passage + words(rng, 60) for _ in range(60)]     # a passage that many share
    texts = [" ".join(w) for w in texts] + ["one two", "one two", "One\tTWO\n", "a b c d", "solo"]
    texts += [texts[0]] * 80 + ["word " * 20_000, "word " * 30_000]
    return [(i, t, None, None) for i, t in enumerate(texts)] + [(9000, None, None, None), (9001, "", None, None), (9002, "", None, None), (4, texts[4], None, None)]


def brute(data):
    sets = {}
    for i, t, *_ in data:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_classes_equal_brute_force(spark):
    data = rows()
    want = brute(data)
    got = minhash.classes(frame(spark, data, CLASHING), block=16).collect()
    assert len(got) == len(data)
    assert {r.doc_id: r.class_id for r in got} == want
    kept = [r.doc_id for r in got if r.kept]
    assert sorted(kept) == sorted(set(want.values()))


def test_keep_one_keeps_rows_and_columns(spark):
    data = rows()
    df = frame(spark, data, CLASHING)
    out = minhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(brute(data).values()))


def test_repeated_lines_lose_no_link(spark):
    """Pairs alone: a line stands 50 times in one text and not at all in the other."""
    rng = random.Random(13)
    data = []
    for i in range(40):
        base, line = words(rng, 120), words(rng, 20)
        data += [(2 * i, " ".join(base), None, None), (2 * i + 1, " ".join(base + line * 50), None, None)]
    want = brute(data)
    assert all(want[i] == i - i % 2 for i in want)     # Jaccard 0.83
    assert {r.doc_id: r.class_id for r in minhash.classes(frame(spark, data)).collect()} == want


def test_rows_repeated_whole_are_one_set(spark, monkeypatch):
    rng = random.Random(16)
    w = words(rng, 100)
    data = [(1, " ".join(w), None, None)] * 300 + [(2, " ".join(w + ["more"]), None, None)]
    sizes, write = {}, minhash.materialize

    def watched(df, name):
        out = write(df, name)
        sizes.setdefault(name, out.count())
        return out
    monkeypatch.setattr(minhash, "materialize", watched)
    got = minhash.classes(frame(spark, data)).collect()
    assert len(got) == 301 and {r.class_id for r in got} == {1} and sum(r.kept for r in got) == 1
    assert sizes["sets"] == 2


def test_null_ids_and_empty(spark):
    got = minhash.classes(frame(spark, [(None, "a b", None, None), (None, "a b", None, None), (7, "a B", None, None)])).collect()
    assert [(r.class_id, r.doc_id) for r in got if r.kept] == [(7, 7)] and {r.class_id for r in got} == {7}
    big = 2**53 + 1
    assert {r.class_id for r in minhash.classes(frame(spark, [(None, "x y z", None, None), (big, "a b c", None, None)])).collect()} == {None, big}
    assert minhash.classes(frame(spark, [])).count() == 0
    assert minhash.keep_one(frame(spark, [])).count() == 0


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(11)
    with np.errstate(over="ignore"):
        items = rng.integers(0, 2**63, 300).astype(np.uint64)
        wa, wb = rng.integers(0, 4, 300).astype(float), rng.integers(0, 4, 300).astype(float)
        wb[:200] = wa[:200]
        a, b = wa > 0, wb > 0
        m = 4000
        equal = (prob_minhash(items[a], wa[a], m) == prob_minhash(items[b], wb[b], m)).mean()
        want = sum(1 / np.maximum(wa / wa[d], wb / wb[d]).sum() for d in np.flatnonzero(a & b))
        assert abs(equal - want) < 4 * np.sqrt(want * (1 - want) / m)
        few = prob_minhash(items[:1], np.ones(1), 130)
        assert (few == items[0]).all()


def test_shingles():
    with np.errstate(over="ignore"):
        assert len(shingles(None)[0]) == len(shingles(" \n")[0]) == 0
        assert len(shingles("a b")[0]) == 1 and list(shingles("a " * 30)[1]) == [26]
        assert (shingles("A b\tC d e")[0] == shingles("a B c\nd E ")[0]).all()


def test_components_against_union_find(spark):
    rng = random.Random(12)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)]
    pairs += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)] + [(5, 5)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in p and p[0] != p[1] for p in pairs)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
