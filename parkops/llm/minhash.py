"""MinHash near-dedup with ProbMinHash signatures.

Documents whose sets of word shingles have Jaccard 0.8 or more are linked;
linked documents form classes.

1. Equal texts are one class row from the start.
2. ProbMinHash signatures of the shingle sets (every shingle has weight 1, so they
   estimate the very Jaccard that is compared, however often a line is repeated)
   are cut into bands.
3. Every member of a bucket is compared with the bucket's smallest member
   (exact Jaccard): the large groups become connected with one pair a member.
4. Buckets that still hold several components are dealt out, in blocks if they
   are large.  Members outside the bucket's largest component are compared
   exactly with all of its members, inside the tasks, which return a spanning
   forest of the links: no pairs are emitted, and none is compared whose sizes
   alone rule out the similarity.

So a link is lost only if its two documents share no bucket: (1 - 0.8^5)^26, 3 in
100,000 at the threshold itself, and far less above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components
from .shingles import band_keys, prob_minhash, shingles


def _sketches(bands: int, rows: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for batch in batches:
                sizes, keys = [], []
                for text in batch:
                    s, _ = shingles(text)
                    sizes.append(len(s))
                    keys.append(band_keys(prob_minhash(s, np.ones(len(s)), bands * rows), bands, rows) if len(s) else [])
                yield pd.DataFrame({"n": np.array(sizes, np.int32), "bands": keys})
    return F.pandas_udf(run, "n int, bands array<long>")   # ids stay outside of pandas, which makes floats of them


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    with np.errstate(over="ignore"):
        for batch in batches:
            texts = batch.pop("text")
            yield batch.assign(items=[shingles(t)[0].view(np.int64) for t in texts])


def _compare(similarity: float):
    """Links of block pairs, many in a table: exact Jaccard of members of different components."""
    def run(table: pa.Table) -> pa.Table:
        cid, roots, side = (table.column(c).to_numpy() for c in ("cid", "root", "side"))
        items = table.column("items").combine_chunks()
        lens = np.diff(items.offsets.to_numpy())
        starts = np.cumsum(lens) - lens
        known, ids = np.unique(items.flatten().to_numpy(), return_inverse=True)
        flag = np.zeros(len(known), bool)
        root = dict(zip(roots.tolist(), roots.tolist()))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        links = []
        block = [table.column(c).to_numpy() for c in ("j", "i", "band")]
        order = np.lexsort((cid, *block))
        ends = np.flatnonzero(np.any([np.diff(b[order]) != 0 for b in block], axis=0)) + 1
        for rows in np.split(order, ends):
            # side 0 meets side 1; a block with itself is side 2
            left, right = rows[side[rows] != 1], rows[side[rows] != 0]
            if not (len(left) and len(right)):
                continue
            sizes, others = lens[right], roots[right]
            for x in left.tolist():
                n = int(lens[x])
                want = right[(others != roots[x]) & (np.minimum(sizes, n) >= similarity * np.maximum(sizes, n))]
                if not len(want):
                    continue
                own = ids[starts[x]:starts[x] + n]
                flag[own] = True
                far = lens[want]
                first = np.cumsum(far) - far
                theirs = ids[np.repeat(starts[want] - first, far) + np.arange(int(far.sum()))]
                shared = np.add.reduceat(flag[theirs].astype(np.int32), first)
                flag[own] = False
                for y in want[shared >= similarity * (far + n - shared)].tolist():
                    a, b = find(int(roots[x])), find(int(roots[y]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        links.append((int(cid[x]), int(cid[y])))
        return pa.table({c: pa.array([link[k] for link in links], pa.int64()) for k, c in enumerate("ab")})
    return run


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bands: int = 26, rows: int = 5,
            similarity: float = 0.8, block: int = 1024, group_rows: int = 4096) -> DataFrame:
    """Per input row: ``doc_id, class_id, kept, n_shingles`` (and ``tkey``, a digest of
    the text).  ``class_id`` is the smallest id of the class; one row of each
    class is kept, the one with that id.

    A null or wordless text is in no class: ``class_id`` is its own id, and it is
    kept.  A text of one to four words is one shingle.  Repeated rows are copies:
    one of them is kept.  Null ids sort last; a class of null ids only has a null
    ``class_id``.  Empty table: no rows; other columns are ignored, whatever their
    names.  A very long text is one row of one task, a few hundred bytes a word."""
    spark = df.sparkSession
    light = df.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"),
                      F.md5(F.coalesce(F.col(text), F.lit(""))).alias("tkey"), F.col(text).alias("text"))
    sketch = light.select("uid", "doc_id", "tkey", _sketches(bands, rows)("text").alias("s"))
    sketch = materialize(sketch.select("uid", "doc_id", "tkey", "s.n", "s.bands"), "sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("uid").alias("uid")))
    texts = sketch.where("n > 0").groupBy("tkey").agg(first.alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"),
                                                     F.count(F.lit(1)).alias("copies"))
    # a class row's uid is its number from here on
    texts = materialize(texts.select("tkey", "first", F.col("first.uid").alias("cid"), F.col("first.doc_id").alias("doc_id"), "n", "bands", "copies"), "texts")

    keyed = texts.select("cid", "n", F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("cid", "n")).alias("rep")).where("members > 1")
    shared = materialize(keyed.join(buckets, "band").select("band", "cid", "n", F.col("rep.cid").alias("rep"),
                                                            F.col("rep.n").alias("rep_n")), "buckets")
    wanted = texts.join(shared.select("cid").distinct(), "cid", "left_semi").select("cid", "doc_id", "tkey", "copies")
    bodies = df.select(F.md5(F.coalesce(F.col(text), F.lit(""))).alias("tkey"), F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    bodies = bodies.join(wanted, "tkey").where(F.col("_id").eqNullSafe(F.col("doc_id"))).select("cid", "text", "copies")
    # of rows repeated whole, one
    bodies = bodies.where("copies = 1").unionByName(bodies.where("copies > 1").dropDuplicates(["cid"])).select("cid", "text")
    sets = materialize(bodies.mapInPandas(_sets, "cid long, items array<long>"), "sets")

    fits = F.least("n", "rep_n") >= similarity * F.greatest("n", "rep_n")
    stars = shared.where((F.col("cid") != F.col("rep")) & fits).select("rep", "cid").distinct()
    pairs = (stars.join(sets.select("cid", F.col("items").alias("mine")), "cid")
             .join(sets.select(F.col("cid").alias("rep"), F.col("items").alias("theirs")), "rep"))
    common = F.size(F.array_intersect("mine", "theirs"))
    linked = common >= similarity * (F.size("mine") + F.size("theirs") - common)
    links = materialize(pairs.where(linked).select(F.col("rep").alias("a"), F.col("cid").alias("b")), "links")
    roots = components(links)

    placed = shared.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select(
        "band", "cid", F.coalesce("root", "cid").alias("root"))
    # a bucket's largest component is its bulk: a pair across components has a member outside of it
    parts = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("size"))
    mixed = parts.groupBy("band").agg(F.count(F.lit(1)).alias("roots"), F.sum("size").alias("members"),
                                      F.max(F.struct("size", "root")).alias("most")).where("roots > 1")
    mixed = mixed.select("band", F.col("most.root").alias("bulk"), F.ceil(F.col("most.size") / block).cast("int").alias("nb"),
                         F.ceil((F.col("members") - F.col("most.size")) / block).cast("int").alias("nl"))
    placed = placed.join(mixed, "band").withColumn("inside", F.col("root") == F.col("bulk"))
    # blocks 0..nb of the bulk meet only those of the others, which also meet one another, once
    own = F.when(F.col("inside"), F.pmod(F.xxhash64("cid"), F.col("nb"))).otherwise(F.col("nb") + F.pmod(F.xxhash64("cid"), F.col("nl")))
    last = F.col("nb") + F.col("nl") - 1
    placed = placed.withColumn("own", own.cast("int"))
    dealt = placed.withColumn("met", F.explode(F.when(F.col("inside"), F.sequence(F.col("nb"), last)).otherwise(F.sequence(F.lit(0), last)))).select(
        "cid", "root", "band", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"),
        F.when(F.col("own") == F.col("met"), 2).when(F.col("own") < F.col("met"), 0).otherwise(1).alias("side"))
    # whole block pairs, a few thousand rows of them to a group
    groups = max(1, -(-dealt.count() // group_rows))
    dealt = dealt.withColumn("grp", F.pmod(F.xxhash64("band", "i", "j"), F.lit(groups)))
    more = dealt.join(sets, "cid").groupBy("grp").applyInArrow(_compare(similarity), "a long, b long")
    more = materialize(more, "links")
    roots = components(links.unionByName(more))

    groups = texts.join(roots, texts["cid"] == roots["node"], "left").select(
        "tkey", "first", F.coalesce("root", "cid").alias("root"))
    heads = groups.groupBy("root").agg(F.min("first").alias("head"))
    named = groups.join(heads, "root").select("tkey", F.col("head.doc_id").alias("class_id"), F.col("head.uid").alias("_kept"))
    out = sketch.where("n > 0").drop("bands").join(named, "tkey")
    out = out.select("doc_id", "class_id", (F.col("uid") == F.col("_kept")).alias("kept"), F.col("n").alias("n_shingles"), "tkey")
    alone = sketch.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"),
                                         F.col("n").alias("n_shingles"), "tkey")
    return out.unionByName(alone)


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``df`` with one row of each class, all columns as they were."""
    found = materialize(classes(df, doc_id, text, **settings), "classes")
    stay = found.where(F.col("kept") & (F.col("n_shingles") > 0)).select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key"))
    packed = df.select(F.struct("*").alias("row"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    same = (F.col("_t") == F.col("_key")) & F.col(f"row.{doc_id}").eqNullSafe(F.col("_id"))
    whole = packed.join(stay, same, "left_semi").dropDuplicates(["_t"])   # of repeated rows, one
    bare = found.where("n_shingles = 0").select("tkey").distinct()
    whole = whole.unionByName(packed.join(bare, packed["_t"] == bare["tkey"], "left_semi"))
    return whole.select(*[F.col("row")[c].alias(c) for c in df.columns])
