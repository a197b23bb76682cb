"""Embedding near-dedup: an exact metric range join.

On the unit sphere, cosine >= c is a distance of at most eps = sqrt(2 - 2c).
Pivots split the vectors into cells (nearest pivot).  If x and y are that close
and y's cell is p's, then by the triangle inequality x lies within eps of the
plane between p and x's own pivot; so x is copied to the cells whose plane it is
that near to, and each cell joins its own vectors with its copies, alone.  A pair
across two cells is joined in the one with the smaller number only.

A cell is dealt out in blocks of bounded size.  A block returns link counts of
its vectors and a spanning forest of its links, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components
from .vectors import inner, matrix, unit, usable

_SLACK = 1e-9   # products this close to the threshold are decided by the exact one


def _cells(pivots: object, eps: float):
    """Home cell (``home`` true) and boundary copies of each vector."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                centres = pivots.value.get(int(dim))
                x = unit(matrix(part.vec))
                if centres is None:
                    near, cells = np.ones((len(x), 1), bool), np.zeros(len(x), int)
                else:
                    dot = x @ centres.T
                    cells = dot.argmax(axis=1)
                    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
                    # distance to the plane between own pivot and p
                    lead = dot.max(axis=1, keepdims=True) - dot
                    near = lead <= eps * apart[cells] + _SLACK
                    near &= np.arange(len(centres))[None, :] <= cells[:, None]   # the smaller cell joins
                    near[np.arange(len(x)), cells] = True
                row, cell = np.nonzero(near)
                yield pd.DataFrame({"cid": part.cid.to_numpy()[row], "times": part.times.to_numpy()[row], "dim": int(dim),
                                    "cell": cell.astype(np.int32), "home": cells[row] == cell,
                                    "vec": list(x[row])})
    return run


def _join(cosine: float):
    """One block of home vectors against one block of the cell's vectors."""
    def run(block: pd.DataFrame) -> pd.DataFrame:
        out = {"cid": [], "other": [], "n": []}
        left, right = block[block.side != 1], block[block.side != 0]
        if left.empty or right.empty:
            return pd.DataFrame({k: np.array(v, np.int64) for k, v in out.items()})
        a, b = matrix(left.vec), matrix(right.vec)
        ca, cb = left.cid.to_numpy(), right.cid.to_numpy()
        ta, tb = left.times.to_numpy(), right.times.to_numpy()
        both_home = right.home.to_numpy()
        same = left.own.iloc[0] == right.own.iloc[0] and (block.side == 2).any()
        na, nb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        root = {int(c): int(c) for c in np.concatenate([ca, cb])}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for at in range(0, len(a), 512):
            dot = a[at:at + 512] @ b.T
            row, col = np.nonzero(dot >= cosine - _SLACK)
            # a pair of home vectors of one block stands there twice
            keep = ca[at + row] != cb[col]
            keep &= ~(same & both_home[col]) | (ca[at + row] < cb[col])
            row, col = row[keep] + at, col[keep]
            near = np.abs(dot[row - at, col] - cosine) <= _SLACK
            near[near] = inner(a[row[near]], b[col[near]]) < cosine
            row, col = row[~near], col[~near]
            np.add.at(na, row, tb[col])
            np.add.at(nb, col, ta[row])
            for x, y in zip(ca[row].tolist(), cb[col].tolist()):
                rx, ry = find(x), find(y)
                if rx != ry:
                    root[max(rx, ry)] = min(rx, ry)
                    out["cid"].append(x)
                    out["other"].append(y)
                    out["n"].append(0)
        for cids, counts in ((ca, na), (cb, nb)):
            some = counts > 0
            out["cid"] += cids[some].tolist()
            out["other"] += cids[some].tolist()
            out["n"] += counts[some].tolist()
        return pd.DataFrame({k: np.array(v, np.int64) for k, v in out.items()})
    return run


def links(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = 0.95,
          cell_size: int = 4096, most_pivots: int = 1024, block: int = 2048) -> DataFrame:
    """Per input row: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, empty, zero or hold null or non-finite components, or
    differ in length, link with nothing.  Equal vectors are one class from the
    start and link with one another; repeated rows are vectors of their own.
    ``component_id`` is the smallest id reachable (a null id is never smallest).
    Empty table: no rows; other columns are ignored, whatever their names.

    Pivots are vectors of the table, one for about ``cell_size`` vectors, at most
    ``most_pivots`` a vector length (a bound on what is broadcast; larger cells
    only mean more blocks)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    rows = materialize(df.select(F.monotonically_increasing_id().alias("uid"), F.col(vec_id).alias("vec_id"),
                                 F.when(usable(F.col(vector)), F.transform(vector, lambda x: x.cast("double"))).alias("vec")), "vectors")
    same = rows.where("vec IS NOT NULL").groupBy("vec").agg(F.min("uid").alias("cid"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("times"))
    same = materialize(same.withColumn("dim", F.size("vec")), "classes")
    pivots = {}
    for dim, n in same.groupBy("dim").count().orderBy(F.desc("count")).limit(64).collect():   # other lengths: one cell each
        count = min(most_pivots, -(-n // cell_size))
        if count > 1:
            some = same.where(F.col("dim") == dim).orderBy(F.xxhash64("vec")).limit(count).select("vec")
            pivots[dim] = unit(matrix(r["vec"] for r in some.collect()))
    eps = float(np.sqrt(2 - 2 * cosine))
    dims = sc.broadcast(pivots)
    placed = materialize(same.select("cid", "times", "dim", "vec").mapInPandas(
        _cells(dims, eps), "cid long, times long, dim int, cell int, home boolean, vec array<double>"), "cells")
    # blocks: home vectors are dealt to `blocks` parts, copies to further ones; every home
    # block meets every block once
    sizes = placed.groupBy("dim", "cell").agg(F.sum(F.col("home").cast("int")).alias("homes"), F.count(F.lit(1)).alias("all"))
    sizes = sizes.select("dim", "cell", F.greatest(F.lit(1), F.ceil(F.col("homes") / block)).cast("int").alias("nh"),
                         F.ceil((F.col("all") - F.col("homes")) / block).cast("int").alias("nc"))
    placed = placed.join(sizes, ["dim", "cell"])
    placed = placed.withColumn("own", F.when(F.col("home"), F.pmod(F.xxhash64("cid"), F.col("nh"))).otherwise(
        F.col("nh") + F.pmod(F.xxhash64("cid"), F.greatest("nc", F.lit(1)))).cast("int"))
    # a home block i meets home blocks j >= i and all blocks of copies
    meets = F.when(F.col("home"), F.sequence(F.lit(0), F.col("nh") + F.col("nc") - 1)).otherwise(F.sequence(F.lit(0), F.col("nh") - 1))
    dealt = placed.withColumn("met", F.explode(meets)).select(
        "cid", "times", "home", "vec", "own", "dim", "cell", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"),
        F.when(F.col("own") == F.col("met"), 2).when(F.col("own") < F.col("met"), 0).otherwise(1).alias("side"))
    found = dealt.groupBy("dim", "cell", "i", "j").applyInPandas(_join(cosine), "cid long, other long, n long")
    found = materialize(found, "links")
    counts = found.where("n > 0").groupBy("cid").agg(F.sum("n").alias("n"))
    roots = components(found.where("cid != other"), "cid", "other")
    named = (same.select("cid", "low", "times", "vec").join(counts, "cid", "left")
             .join(roots.withColumnRenamed("node", "cid"), "cid", "left")
             .select("cid", "vec", "low", F.coalesce("root", "cid").alias("root"),
                     (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links")))
    heads = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(heads, "root").select("vec", "n_links", "component_id")
    out = rows.where("vec IS NOT NULL").join(named, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where("vec IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id",
                                         F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
