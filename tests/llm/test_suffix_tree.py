import math
import random
from collections import Counter, defaultdict

from helpers import CLASHING, frame
from parkops.llm import suffix_tree
from pyspark.sql import functions as F


def rows():
    rng = random.Random(8)
    out = []
    for i in range(240):
        w = ["The" if rng.random() < .5 else "É"]
        for _ in range(rng.randrange(0, 50)):
            w.append({"the": "Cat", "cat": "sat"}.get(w[-1].lower()) if rng.random() < .7 and w[-1].lower() in ("the", "cat")
                     else rng.choice(["the", "a", "cat", "dog", f"rare{rng.randrange(300)}"]))
        out.append((i, "\t".join(w), "en", "s"))
    return out + [(240, None, None, None), (250, "", None, None), (241, " \n", None, None), (242, "the cat " * 30_000, None, None), (3, out[3][1], "en", None)]


def tokens(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in "".join(" " if c in "\t\n\r\x0b\x0c" else c for c in t).split(" ") if w] + [None]


def test_base_equals_brute_force_and_tree_beats_it(spark):
    data = rows()
    got = suffix_tree.score(frame(spark, data, CLASHING), F.col("doc_id") % 10 == 0, least_word=1e-4).collect()
    c = Counter()
    for i, t, *_ in data:
        if i % 10:
            c.update(tokens(t))
    total = sum(c.values())
    mass = total + 0.1 * (len(c) + 1)
    text = {i: t for i, t, *_ in data}
    assert len(got) == len(data)
    for r in got:
        w = tokens(text[r.doc_id])
        assert abs(r.base_score - sum(math.log10((c[x] + 0.1) / mass) for x in w)) < 1e-6 * len(w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), total)
        assert r.held_out == (r.doc_id % 10 == 0)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 50


def brute_scores(data, least_context=10, divergence=0.01):
    """The tree in plain dictionaries, with contexts of any length."""
    texts = [tokens(t) for _, t, *_ in data]
    train = [w for (i, *_), w in zip(data, texts) if i % 10]
    uni = Counter(x for w in train for x in w)
    mass = sum(uni.values()) + 0.1 * (len(uni) + 1)
    p = [[(uni[x] + 0.1) / mass for x in w] for w in texts]
    best, on, depth = [list(x) for x in p], [[True] * len(w) for w in texts], 0
    while True:
        depth += 1
        after = defaultdict(Counter)
        for w in train:
            for j in range(depth, len(w)):
                after[tuple(w[j - depth:j])][w[j]] += 1
        after = {k: n for k, n in after.items() if sum(n.values()) >= least_context}
        rest, gain = {}, Counter()
        for k, n in after.items():
            kept = [x for x in n.values() if x > 1]
            rest[k] = (sum(n.values()) - sum(kept) + 0.75 * len(kept)) / sum(n.values())
        new = {}
        for d, w in enumerate(texts):
            for j in range(depth, len(w)):
                k = tuple(w[j - depth:j])
                on[d][j] = on[d][j] and k in after
                if on[d][j]:
                    n, total = after[k][w[j]], sum(after[k].values())
                    new[d, j] = ((n - 0.75) / total if n > 1 else 0) + rest[k] * p[d][j]
                    if data[d][0] % 10:
                        gain[k] += math.log(new[d, j] / p[d][j]) / total
        stays = {k for k in after if gain[k] >= divergence}
        for (d, j), x in new.items():
            k = tuple(texts[d][j - depth:j])
            best[d][j] = x if k in stays else best[d][j]
            p[d][j] = x
            on[d][j] = k in stays or depth == 1
        for d, w in enumerate(texts):
            on[d][:depth + 1] = [False] * min(depth + 1, len(w))
        if not stays:
            return [sum(map(math.log10, b)) for b in best], depth


def test_rare_and_long_contexts_equal_brute_force(spark, monkeypatch):
    """Contexts of a few occurrences, and of more than two words, in many chunks."""
    rng = random.Random(14)
    phrases = [[f"a{rng.randrange(6)}" for _ in range(7)] for _ in range(12)]
    data = []
    for i in range(300):
        w = []
        for _ in range(rng.randrange(0, 12)):
            w += rng.choice(phrases) if rng.random() < .4 else [f"r{rng.randrange(2000)}" for _ in range(5)]
        data.append((i, " ".join(w), None, None))
    data += [(1000 + i, f"lead pair {rng.choice(['follow', 'trail'])}", None, None) for i in range(1, 30)]
    want, depth = brute_scores(data)
    assert depth > 4
    df = frame(spark, data, CLASHING)
    monkeypatch.setattr(suffix_tree, "_BUCKET", 3000)
    got = {r.doc_id: r for r in suffix_tree.score(df, F.col("doc_id") % 10 == 0).collect()}
    assert len(got) == len(data)
    for (i, *_), x in zip(data, want):
        assert abs(got[i].score - x) < 1e-4, (i, got[i], x)


def test_a_context_counts_alike_at_every_size(spark):
    """Twenty occurrences are a context also beside a million other tokens."""
    rng = random.Random(15)
    data = [(10 * i + 1, "lead pair follow", None, None) for i in range(20)] + [(0, "lead pair follow", None, None)]
    filler = [f"f{rng.randrange(3000)}" for _ in range(2_500_000)]
    data += [(10 * i + 2, " ".join(filler[i * 50_000:(i + 1) * 50_000]), None, None) for i in range(50)]
    r = next(r for r in suffix_tree.score(frame(spark, data), F.col("doc_id") % 10 == 0).collect() if r.doc_id == 0)
    assert r.score > r.base_score + 8


def test_without_training_rows_and_empty(spark):
    big = 2**53 + 1
    df = frame(spark, [(big, "a b", None, None), (None, None, None, None)])
    assert {r.doc_id for r in suffix_tree.score(df, F.lit(False)).collect()} == {big, None}
    got = suffix_tree.score(df, F.lit(True)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert suffix_tree.score(frame(spark, []), F.lit(False)).count() == 0


def test_messages_tell_a_word_once():
    """Numbered chunks hold no hashes, and of the first depth no next word's probability is sent with every context."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    rng = random.Random(16)
    names = [f"w{i}" for i in range(20_000)]
    texts = [" ".join(names[min(int(rng.paretovariate(0.6)), 20_000) - 1] for _ in range(1000)) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([False] * 200), pa.array(texts)], names=["doc_id", "held_out", "text"])
    (chunk,) = suffix_tree._chunks(iter([batch]))
    c = {"buckets": 1, "least_word": 2, "least_context": 10, "least_next": 2, "divergence": 0.01, "depth": 1, "mass": 2e5}
    text = chunk["blob"][0].as_py()
    rows = pd.DataFrame({"chunk": [0], "text": [text]})
    words = suffix_tree._total_words(c)(suffix_tree._send_words(c)(rows))
    state = suffix_tree._take_words(c)(rows, words)
    assert len(state.text[0]) < 0.85 * len(text) and len(state.state[0]) < 0.05 * len(text)
    sent = suffix_tree._send(c)(state)
    m = suffix_tree._unpack(sent.blob[0])
    assert len(m["n"]) > 10_000 and len(sent.blob[0]) < 2 * len(m["n"])
    back = suffix_tree._total(c)(sent)
    taken = suffix_tree._unpack(suffix_tree._take(c)(state, back).state[0])
    assert "best" not in taken and "number" not in taken and np.isfinite(taken["last"]).all()


def test_messages_stay_small_in_many_ranges():
    """A context costs no hash and a decision no float, also if a chunk's contexts go to many ranges; rounds split the same messages."""
    import pandas as pd
    import pyarrow as pa
    rng = random.Random(17)
    names = [f"w{i}" for i in range(20_000)]
    texts = [" ".join(names[min(int(rng.paretovariate(0.5)), 20_000) - 1] for _ in range(1000)) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([False] * 300), pa.array(texts)], names=["doc_id", "held_out", "text"])
    (chunk,) = suffix_tree._chunks(iter([batch]))
    c = {"buckets": 16, "least_word": 2, "least_context": 2, "least_next": 2, "divergence": 0.01, "depth": 1, "mass": 3e5}
    rows = pd.DataFrame({"chunk": [0], "text": [chunk["blob"][0].as_py()]})
    ask = lambda run, sent: pd.concat([run(sent[sent.bucket == b]) for b in sorted(set(sent.bucket))])
    state = suffix_tree._take_words(c)(rows, ask(suffix_tree._total_words(c), suffix_tree._send_words(c)(rows)))
    for depth in (1, 2):
        c["depth"] = depth
        sent = suffix_tree._send(c)(state)
        parts = [suffix_tree._unpack(b) for b in sent.blob]
        contexts, pairs = sum(len(p["tot"]) for p in parts), sum(len(p["n"]) for p in parts)
        assert contexts > 2_000 and len(parts) == 16
        assert sent.blob.map(len).sum() < (2 if depth == 1 else 6) * pairs
        back = ask(suffix_tree._total(c), sent)
        assert back.blob.map(len).sum() < 2 * contexts + 0.4 * pairs
        rounds = pd.concat([suffix_tree._send(c, range(i, i + 8))(state) for i in (0, 8)])
        assert rounds.bucket.tolist() == sent.bucket.tolist() and rounds.blob.tolist() == sent.blob.tolist()
        state = state[["chunk", "text"]].merge(suffix_tree._take(c)(state, back), on="chunk")
