"""Balanced contiguous shards by global byte-size prefix sums.

Documents are put in one global order, sizes are summed along it from
per-partition totals, and the order is cut where the running size passes equal
shares of the total.  Every shard is one contiguous range, so a shard can be
written, read or resumed by its two bounds.  Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import prefix_sums


def order_columns(doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """The global order: hash of the text (equal texts are neighbours, and
    lengths and sources are spread), then the id, then a second hash."""
    body = F.coalesce(F.col(text), F.lit(""))
    return {"_h": F.xxhash64(body), "_id": F.col(doc_id), "_c": F.crc32(F.encode(body, "UTF-8"))}


def shard(df: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the UTF-8 bytes of the text (null: 0) plus 1, so every row
    counts.  A row goes to the shard in whose share of the total its first byte
    falls; shards differ by less than one document.  ``slot`` counts from 0
    in each shard.  Equal texts stay together but for those at a cut.

    Null texts and ids are ordinary values; empty table: no rows; repeated
    rows each get a slot; other columns are ignored, whatever their names."""
    keys = order_columns(doc_id, text)
    body = F.coalesce(F.col(text), F.lit(""))
    light = df.select(*[c.alias(k) for k, c in keys.items()],
                      (F.octet_length(body) + 1).cast("long").alias("size"))
    rows, totals = prefix_sums(light, [F.col(k).asc_nulls_first() for k in keys], ["size"], "shard")
    cut = F.least(F.lit(shards - 1), F.floor(F.col("size_before") * shards / F.col("size_total"))).cast("int")
    rows = rows.crossJoin(F.broadcast(totals.select("size_total"))).withColumn("shard", cut)   # one row
    first = rows.groupBy("shard").agg(F.min("position").alias("_first"))   # at most `shards` rows
    return (rows.join(F.broadcast(first), "shard")
            .select(F.col("_id").alias("doc_id"), "size", F.col("_c").alias("text_crc32"), "shard",
                    (F.col("position") - F.col("_first")).cast("long").alias("slot")))


def write_shards(df: DataFrame, path: str, shards: int = 8, doc_id: str = "doc_id", text: str = "text",
                 files_per_shard: int = 1) -> None:
    """Write whole rows to ``path/shard=N/``, with ``shard``'s cuts.

    The cuts are at most ``shards`` bounds of the global order, so rows are
    placed by comparing with them; nothing is joined."""
    keys = order_columns(doc_id, text)
    light = df.select(*[c.alias(k) for k, c in keys.items()],
                      (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long").alias("size"))
    rows, totals = prefix_sums(light, [F.col(k).asc_nulls_first() for k in keys], ["size"], "shard")
    total = totals.first()["size_total"]
    bounds = []
    if total:
        cut = F.least(F.lit(shards - 1), F.floor(F.col("size_before") * shards / F.lit(total))).cast("int")
        bounds = (rows.groupBy(cut.alias("shard")).agg(F.min(F.struct(*keys)).alias("low"))
                  .orderBy("shard").collect())   # at most `shards` rows
    place = F.lit(bounds[0]["shard"] if bounds else 0)
    here = F.struct(*[c.alias(k) for k, c in keys.items()])
    for b in bounds[1:]:
        low = F.struct(F.lit(b["low"]["_h"]).alias("_h"), F.lit(b["low"]["_id"]).alias("_id"),
                       F.lit(b["low"]["_c"]).alias("_c"))
        place = F.when(here >= low, F.lit(b["shard"])).otherwise(place)
    placed = df.select(F.struct("*").alias("row"), place.alias("shard"),
                       F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(files_per_shard)).alias("part"))
    (placed.repartition(F.col("shard"), F.col("part")).select("row", "shard")
     .write.mode("overwrite").partitionBy("shard").parquet(path))
