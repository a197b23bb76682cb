"""Mix sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, repeated for each
epoch.  A document's virtual finish time is the source's running token count up
to and with it, divided by the source's target.  All queues are merged by
finish time in one global range sort and cut at the total budget, so at any
point of the merged stream every source has had its share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count
from .prefix import prefix_sums

_BLOCK = 4096   # repeated rows numbered together


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, epochs: int) -> DataFrame:
    """Targets of sources: ``sizes`` (``source, total``, one row a source) plus
    ``start`` (sum of earlier sources), ``target``.

    Sources in code-point order (null last) take ``weights`` in turn and share
    ``share`` times all tokens; a target stops at ``epochs`` times its source's
    total, and the excess is shared by weight among the others.  Water-filling
    in closed form: along rising cap / weight a source is capped if the level
    without it lies above.  Its windows see one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumns({
        "start": F.coalesce(F.sum("total").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "budget": F.sum("total").over(Window.partitionBy()) * F.lit(float(share)),
        "cap": F.col("total") * epochs})
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "rank")
    levels = ranked.withColumns({
        "spent": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "left": F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    levels = levels.withColumn("level", (F.col("budget") - F.col("spent")) / F.col("left"))
    levels = levels.withColumn("capped", F.col("level") > F.col("ratio"))
    # the level of the first source that is not capped holds for all that follow
    level = F.min(F.when(~F.col("capped"), F.struct("ratio", "rank", "level"))).over(Window.partitionBy())["level"]
    return levels.withColumn("final", level).select(
        "source", "total", "start",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def queue(df: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: str = "mix",
          doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document and epoch: ``_uid, doc_id, source, size, source_size, target, epoch, _t``
    (digest of the text), ``place`` in the merged queue, ``taken``.

    ``taken`` is the size if the mix takes this copy, else 0.  Copies are taken
    whole, in order of finish time, as long as they fit the budget."""
    light = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                      F.md5(F.concat_ws(":", F.lit(seed), F.col(doc_id).cast("string"))).alias("_h"),
                      F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_t"), F.monotonically_increasing_id().alias("_uid"))
    order = [F.col("source").asc_nulls_last(), F.col("_h"), F.col("doc_id").asc_nulls_first(), F.col("_t")]
    rows, _ = prefix_sums(light, order, ["size"], "mix-queue")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("total"))
    targets = source_targets(sizes, weights, share, epochs).withColumnRenamed("source", "_source")
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    done = F.col("size_before") - F.col("start") + F.col("size")   # of the source, up to and with this document
    copies = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).select(
        "_uid", "doc_id", "source", "size", F.col("total").alias("source_size"), "target", "epoch", "_h", "_t",
        F.when(F.col("target") > 0, (F.col("epoch") * F.col("total") + done) / F.col("target")).alias("finish"))
    merged, _ = prefix_sums(copies, [F.col("finish").asc_nulls_last(), F.col("source").asc_nulls_last(), "epoch",
                                     F.col("_h"), F.col("doc_id").asc_nulls_first(), F.col("_t")], ["size"], "mix-merge")
    budget = targets.agg(F.sum("total").alias("all")).select((F.col("all") * F.lit(float(share))).alias("budget"))
    fits = F.col("finish").isNotNull() & (F.col("size_before") + F.col("size") <= F.col("budget"))
    return (merged.crossJoin(F.broadcast(budget))   # one row
            .withColumn("taken", F.when(fits, F.col("size")).otherwise(F.lit(0)).cast("long"))
            .select("_uid", "doc_id", "source", "size", "source_size", "target", "epoch",
                    "_t", F.col("position").alias("place"), "taken"))


def mix(df: DataFrame, **settings) -> DataFrame:
    """Per input row: ``doc_id, size, source_size, target, taken`` (words, repeats
    counted).

    Null or empty texts have size 0 and are taken as 0; null source is a source
    of its own (the last); a source without words has target 0; repeated rows
    are documents of their own; empty table: no rows; other columns are ignored,
    whatever their names.  The shuffle is a hash of the id: reruns agree."""
    return (queue(df, **settings).groupBy("_uid")
            .agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"),
                 F.first("source_size").alias("source_size"), F.first("target").alias("target"),
                 F.sum("taken").alias("taken"))
            .drop("_uid"))


def _numbered(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` plus ``_nth``, their number (from 1) among those of the same ``names``: the
    number in a block of rows, which are dealt out, and one narrow row a block for
    what lies before it."""
    rows = materialize(rows.withColumn("_place", F.monotonically_increasing_id()), "repeats")
    rows = rows.withColumn("_block", F.floor(F.col("_place") / _BLOCK))
    earlier = Window.partitionBy(*names).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*names, "_block").agg(F.count(F.lit(1)).alias("_in"))
    blocks = blocks.select(*[F.col(c).alias(f"_of{c}") for c in (*names, "_block")],
                           F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*names, "_block").orderBy("_place"))
    same = F.col("_block") == F.col("_of_block")
    for c in names:
        same &= F.col(c).eqNullSafe(F.col(f"_of{c}"))
    out = rows.withColumn("_inside", inside).join(blocks, same).withColumn("_nth", F.col("_before") + F.col("_inside"))
    return out.drop("_place", "_block", "_inside", "_before", *[f"_of{c}" for c in (*names, "_block")])


def mixed_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The mix itself: each row of ``df`` as often as the mix takes it, all columns
    as they were.  Rows without words are never taken.

    Rows are met again by id, source and digest of the text; of equal rows, the
    copies are dealt evenly."""
    taken = queue(df, doc_id=doc_id, text=text, source=source, **settings)
    key = [F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("_t").alias("_digest")]
    copies = taken.groupBy(*key).agg(F.sum(F.when(F.col("taken") > 0, 1).otherwise(0)).alias("_copies"),
                                     F.countDistinct("_uid").alias("_rows")).where("_copies > 0")
    packed = df.select(F.struct("*").alias("row"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    met = packed.join(copies, (F.col("_t") == F.col("_digest")) & F.col(f"row.{doc_id}").eqNullSafe(F.col("_id"))
                      & F.col(f"row.{source}").eqNullSafe(F.col("_source")))
    one = met.where("_rows = 1").withColumn("_times", F.col("_copies").cast("int"))
    many = _numbered(met.where("_rows > 1"), ["_id", "_source", "_digest"]).withColumn(
        "_times", (F.floor(F.col("_copies") / F.col("_rows")) + F.when(F.col("_nth") <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)).cast("int"))
    both = one.unionByName(many.drop("_nth")).where("_times > 0")
    return (both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
            .select(*[F.col("row")[c].alias(c) for c in df.columns]))
