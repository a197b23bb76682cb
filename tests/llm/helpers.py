"""Small tables for the operators' tests."""

import random
from itertools import pairwise

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


def words(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary):x}q" for _ in range(n)]


def frame(spark, rows, extra=()):
    """Documents, with more columns whose names operators also use inside."""
    names = [*extra]
    schema = T.StructType(DOCS.fields + [T.StructField(n, T.StringType()) for n in names])
    df = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], schema)
    return df.repartition(3)


CLASHING = ["size", "uid", "row", "_pid", "kind", "n", "shard", "position", "tkey", "cid", "_t", "_key", "vec", "_guess",
            "score", "held_out", "lang_pred", "_text", "msg", "dim"]


def gapless(offsets_and_lengths) -> bool:
    ends = [(o, o + n) for o, n in sorted(offsets_and_lengths)]
    return ends[0][0] == 0 and all(a[1] == b[0] for a, b in pairwise(ends))
