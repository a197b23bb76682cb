import random

import numpy as np
import pytest
from parkops.llm import embedding_dedup, multi_index

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, dim string, vec string, cid string"


def rows(n=700, dim=12):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    for i in range(0, n, 3):      # groups around the threshold
        x[i] = x[(i // 30) * 30] + rng.normal(size=dim) * 0.2
    x[100:160] = x[100]           # equal vectors
    x[160] = x[100] * 7
    out = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    out += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * dim, 1), (2003, [None, *[1.0] * (dim - 1)], 1), (2004, [float("nan")] * dim, 1),
            (2005, [float("inf"), *[0.0] * (dim - 1)], 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, [3.0], 1), (7, out[7][1], 2), (None, out[8][1], 1)]
    random.Random(1).shuffle(out)
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in data], SCHEMA).repartition(3)


def good(v):
    return bool(v) and None not in v and np.isfinite(v).all() and any(v)


@pytest.mark.parametrize(("cell_size", "block"), [(4096, 2048), (60, 16), (200, 64)])
def test_links_equal_brute_force(spark, cell_size, block):
    data = rows()
    got = embedding_dedup.links(frame(spark, data), cell_size=cell_size, block=block).collect()
    assert len(got) == len(data)
    n, root = [0] * len(data), list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    vecs = [np.array(v, float) if good(v) else None for _, v, _ in data]
    for i, a in enumerate(vecs):
        for j in range(i):
            b = vecs[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(data)):
        groups.setdefault(find(i), []).append(data[i][0])
    low = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    want = sorted((str(data[i][0]), n[i], low[find(i)], data[i][0] == low[find(i)]) for i in range(len(data)))
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got) == want


def test_links_of_empty_and_bad_tables(spark):
    assert embedding_dedup.links(frame(spark, [])).count() == 0
    bad = embedding_dedup.links(frame(spark, [(1, None, 1), (2, [], 1)])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in bad) == [(1, 0, 1, True), (2, 0, 2, True)]


def brute_search(data, k=20):
    live = [(i, np.array(v, float), j) for j, (i, v, _) in enumerate(data) if i is not None and good(v)]
    want = {}
    for i, v, j in live:
        if i % 20 == 0:
            near = [(-float((v * w).sum()), o) for o, w, p in live if p != j and len(w) == len(v)]
            want[i] = sorted(near)[:k]
    return want


@pytest.mark.parametrize("settings", [{}, {"block": 50, "query_block": 7}])
def test_search_that_visits_all_equals_brute_force(spark, settings):
    from pyspark.sql import functions as F
    data = rows()
    got = {}
    for r in multi_index.search(frame(spark, data), F.col("vec_id") % 20 == 0, share=1.0, **settings).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_search(data)
    assert got.keys() == {i for i, w in want.items() if w}
    for i, w in want.items():
        found = sorted(got.get(i, []))
        assert [r for r, *_ in found] == list(range(1, len(w) + 1))
        assert [v for _, v, _ in found] == [v for _, v in w]
        assert np.allclose([s for *_, s in found], [-s for s, _ in w], rtol=0, atol=1e-12)


def test_search_recall(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(14)
    data = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(6000, 16)).astype(np.float32))]
    got = {}
    for r in multi_index.search(frame(spark, data), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_search(data)
    assert np.mean([len(got[i] & {v for _, v in w}) / len(w) for i, w in want.items()]) >= 0.9


def test_queries_go_only_where_their_walk_went(spark):
    """On clustered vectors few entries are multiplied, and recall stays."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(16)
    centres = rng.normal(size=(40, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    data = [(i, (centres[i % 40] * 4 + 0.1 * rng.normal(size=16)).astype(np.float32).tolist(), 0) for i in range(4000)]
    df, is_query = frame(spark, data), F.col("vec_id") % 20 == 0
    settings = {"share": 0.05, "least": 100, "most_centroids": 40, "block": 100, "query_block": 50}
    _, _, dealt = multi_index._dealt(df, is_query, "vec_id", "embedding", **settings)
    each = dealt.groupBy("dim", "block", "part", "qb").agg((F.count_if("query") * F.count_if(~F.col("query"))).alias("n"))
    assert each.agg(F.sum("n")).first()[0] < 0.4 * 200 * 4000
    got = {}
    for r in multi_index.search(df, is_query, **settings).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_search(data)
    assert np.mean([len(got[i] & {v for _, v in w}) / len(w) for i, w in want.items()]) >= 0.9


def test_walk_visits_the_nearest_pairs():
    rng = np.random.default_rng(15)
    a, b, sizes = rng.normal(size=9), rng.normal(size=7), rng.integers(0, 5, (9, 7))
    for wanted in (1, 10, 40, sizes.sum()):
        last = multi_index.walk((a, b), sizes, wanted)
        sums = np.add.outer(a, b)
        assert sizes[sums >= last].sum() >= wanted > sizes[sums > last].sum()


def test_search_of_empty_tables(spark):
    from pyspark.sql import functions as F
    for data in ([], [(20, None, 1)], [(20, [1.0, 2.0], 1)]):
        assert multi_index.search(frame(spark, data), F.col("vec_id") % 20 == 0).count() == 0
