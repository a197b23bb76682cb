"""Approximate nearest neighbours with an inverted multi-index.

Each half of a vector is quantised by its own codebook; a cell is a pair of
centroids.  For a query, a heap walks the pairs from the nearest on (the sum of
the halves' inner products with their centroids) until the cells hold the
wanted share of all entries.  Entries of the visited cells are reranked by the
exact inner product.

The walk needs only the codebooks and the cells' sizes, both bounded by the
number of centroids.  Entries lie in blocks of neighbouring lists (first-half
centroids).  A query goes to the blocks that hold a cell that its walk visited, with
where the walk ended as a bound on the sum; a block reranks the entries
within the bound and returns its best.  Queries are grouped by the block that
they lie in themselves, so that those of a group visit much the same blocks
and an entry is copied only to groups that visit its block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import inner, matrix, usable

_SAMPLE = 16_384   # vectors that a codebook is fitted on, at most
_LENGTHS = 16      # vector lengths that get codebooks; the others have one cell each
_ROUNDS = 12


def _codebook(x: np.ndarray, size: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly picked rows; an empty one stays put."""
    centres = x[np.linspace(0, len(x) - 1, size).astype(int)].copy()
    for _ in range(_ROUNDS):
        near = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(axis=1)
        for k in np.unique(near):
            centres[k] = x[near == k].mean(axis=0)
    return centres


def _assign(books: object):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                cells = np.zeros((2, len(part)), np.int32)
                if dim in books.value:
                    x, half = matrix(part.vec), dim // 2
                    for h, (b, y) in enumerate(zip(books.value[dim], (x[:, :half], x[:, half:]))):
                        cells[h] = ((b * b).sum(1) - 2 * y @ b.T).argmin(axis=1)
                yield part.assign(c1=cells[0], c2=cells[1])[["uid", "dim", "c1", "c2"]]
    return run


def walk(near: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, wanted: int) -> float:
    """Walk pairs from the largest sum down until they hold ``wanted`` entries; the
    last sum.  Each pair is pushed once: from its left neighbour, or from above
    in the first column."""
    first, second = (np.argsort(-n, kind="stable") for n in near)
    a, b, counts = near[0][first].tolist(), near[1][second].tolist(), sizes[np.ix_(first, second)].tolist()
    heap, held, last = [(-(a[0] + b[0]), 0, 0)], 0, np.inf
    while heap and held < wanted:
        minus, i, j = heapq.heappop(heap)
        last = -minus
        held += counts[i][j]
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
    return last


def _bounds(books: object, sizes: object, places: object, share: float, least: int):
    """Per query the last sum of its walk, and the blocks of the cells it visited."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bound, visited = np.full(len(batch), -np.inf), [[0]] * len(batch)
            for i, (dim, vec) in enumerate(zip(batch.dim, batch.vec)):
                if dim in books.value:
                    b1, b2 = books.value[dim]
                    q = np.asarray(vec, dtype=np.float64)
                    cells = sizes.value[dim]
                    wanted = max(least, int(np.ceil(share * cells.sum())))
                    # a little below, so that rounding never leaves out the last cell
                    near = b1 @ q[:dim // 2], b2 @ q[dim // 2:]
                    last = walk(near, cells, wanted)
                    bound[i] = last - 1e-9 * max(1.0, abs(last))
                    best = near[0] + np.where(cells > 0, near[1][None, :], -np.inf).max(axis=1)
                    visited[i] = np.unique(places.value[dim][best >= bound[i]])
            yield batch.assign(bound=bound, visited=visited)[["uid", "bound", "visited"]]
    return run


def _rerank(books: object, k: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        asked = block["query"].to_numpy(bool)
        queries, entries = block[asked], block[~asked]
        out = []
        if len(queries) and len(entries):
            dim = int(block.dim.iloc[0])
            q, e = matrix(queries.vec), matrix(entries.vec)
            qu, eu, c1, c2 = queries.uid.to_numpy(), entries.uid.to_numpy(), entries.c1.to_numpy(), entries.c2.to_numpy()
            ids = entries.vec_id.to_numpy()
            for at in range(0, len(q), 128):
                part = q[at:at + 128]
                dot = part @ e.T
                if dim in books.value:
                    b1, b2 = books.value[dim]
                    near = (part[:, :dim // 2] @ b1.T)[:, c1] + (part[:, dim // 2:] @ b2.T)[:, c2]
                    dot[near < queries.bound.to_numpy()[at:at + 128, None]] = -np.inf
                dot[qu[at:at + 128, None] == eu[None, :]] = -np.inf
                for i, row in enumerate(dot):
                    best = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                    some = np.flatnonzero((row >= best - 1e-9 * max(1.0, abs(best))) & (row > -np.inf)) if best > -np.inf else np.flatnonzero(row > -np.inf)
                    exact = inner(part[i], e[some])
                    order = np.lexsort((ids[some], -exact))[:k]
                    out += [(qu[at + i], ids[some[o]], eu[some[o]], exact[o]) for o in order]
        return pd.DataFrame(out, columns=["quid", "vec_id", "uid", "score"])
    return run


def _dealt(df: DataFrame, is_query: Column, vec_id: str, vector: str, share: float, least: int, most_centroids: int, block: int,
           query_block: int) -> tuple[DataFrame, object, DataFrame]:
    """The usable rows, the broadcast codebooks, and queries and entries dealt to where they meet."""
    spark = df.sparkSession
    sc = spark.sparkContext
    vec = F.transform(vector, lambda x: x.cast("double"))
    rows = df.where(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("query"), vec.alias("vec"), F.size(vector).alias("dim"))
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    books = {}
    for dim, n in rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(_LENGTHS).collect():
        if dim > 1:
            some = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("uid"), "uid").limit(_SAMPLE).select("vec")
            x = matrix(r["vec"] for r in some.collect())
            size = min(most_centroids, isqrt(n), len(x))
            books[dim] = _codebook(x[:, :dim // 2], size), _codebook(x[:, dim // 2:], size)
    shared = sc.broadcast(books)
    cells = materialize(rows.select("uid", "dim", "vec").mapInPandas(_assign(shared), "uid long, dim int, c1 int, c2 int"), "cells")
    # at most centroids^2 rows a length with a codebook
    held = cells.groupBy("dim", "c1", "c2").agg(F.count(F.lit(1)).alias("n"))
    sizes = {dim: np.zeros((len(b[0]), len(b[1])), np.int64) for dim, b in books.items()}
    lists, places = [], {}   # blocks: neighbouring lists of the first half together, long ones in several
    for dim, b in books.items():
        for r in held.where(F.col("dim") == dim).collect():
            sizes[dim][r["c1"], r["c2"]] = r["n"]
        full = 0
        for c1, n in enumerate(sizes[dim].sum(axis=1).tolist()):
            lists.append((dim, c1, full // block, -(-n // block) if n > block else 1))
            full += n
        places[dim] = np.array([b for d, _, b, _ in lists if d == dim], np.int32)
    starts = {}
    for dim, c1, b, parts in lists:
        starts.setdefault((dim, b), 1)
        starts[dim, b] = max(starts[dim, b], parts)
    schema = "dim int, c1 int, block int, parts int"
    plan = spark.createDataFrame([(d, c, b, starts[d, b]) for d, c, b, _ in lists], schema)
    rest = F.lit(0)   # lengths without a codebook: one block, in parts by its count
    others = held.where(~F.col("dim").isin(*books)) if books else held
    others = others.select("dim", "c1", rest.alias("block"), F.ceil(F.col("n") / block).cast("int").alias("parts"))
    plan = plan.unionByName(others)
    entries = rows.join(cells.drop("dim"), "uid").join(plan, ["dim", "c1"])
    entries = entries.withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    asked = rows.where("query").join(cells.select("uid", "c1"), "uid").join(plan.select("dim", "c1", F.col("block").alias("home")), ["dim", "c1"])
    asked = materialize(asked.drop("c1"), "queries")
    groups = asked.groupBy("dim", "home").agg(F.ceil(F.count(F.lit(1)) / query_block).alias("qn"))   # one row a block
    bounds = asked.select("uid", "dim", "vec").mapInPandas(_bounds(shared, sc.broadcast(sizes), sc.broadcast(places), share, least),
                                                           "uid long, bound double, visited array<int>")
    asked = asked.join(bounds, "uid").join(groups, ["dim", "home"]).withColumn(
        "qb", F.concat_ws("/", "home", F.pmod(F.xxhash64("uid"), F.col("qn"))))
    asked = materialize(asked.withColumn("block", F.explode("visited")).select("dim", "block", "qb", "uid", "bound"), "asked")
    meets = asked.select("dim", "block", "qb").distinct()
    blocks = plan.select("dim", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).distinct()
    none = F.lit(None)
    left = asked.join(blocks, ["dim", "block"]).join(rows.select("uid", "vec_id", "vec"), "uid").select("dim", "block", "part", "qb", F.lit(True).alias("query"), "uid", "vec_id", "vec", "bound",
                                                       F.lit(0).alias("c1"), F.lit(0).alias("c2"))
    right = entries.join(meets, ["dim", "block"]).select(
        "dim", "block", "part", "qb", F.lit(False).alias("query"), "uid", "vec_id", "vec", none.cast("double").alias("bound"), "c1", "c2")
    return rows, shared, left.unionByName(right)


def search(df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", share: float = 0.5,
           least: int = 2000, most_centroids: int = 128, block: int = 8192, query_block: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query`` the ``k`` entries
    with the largest inner product among those visited, ties to the smaller id.

    Candidates are all rows but the query's own (a repeated row is another
    row).  Vectors that are null, empty, zero or hold null or non-finite
    components, and rows with a null id, take no part; vectors of different
    lengths are not compared.  Empty table: no rows; other columns are ignored,
    whatever their names.  Every row is indexed; only codebooks are fitted on a
    sample.  ``share`` of the entries (``least`` at the least) is visited."""
    rows, shared, dealt = _dealt(df, is_query, vec_id, vector, share, least, most_centroids, block, query_block)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    best = dealt.groupBy("dim", "block", "part", "qb").applyInPandas(
        _rerank(shared, k), f"quid long, vec_id {id_type}, uid long, score double")
    rank = F.row_number().over(Window.partitionBy("quid").orderBy(F.col("score").desc(), "vec_id", "uid"))
    found = best.withColumn("rank", rank).where(F.col("rank") <= k)
    names = rows.where("query").select(F.col("uid").alias("quid"), F.col("vec_id").alias("query_id"))
    return found.join(names, "quid").select("query_id", "rank", "vec_id", "score")
