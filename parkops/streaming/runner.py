"""Run a streaming query to completion over the data present now.

Production runs use ``trigger(processingTime='15 seconds')`` (the polling
period of the dashboards); checks and batch back-fills use
``availableNow``.  Results go through ``foreachBatch`` into Parquet under the
shared checkpoint folder, one folder per micro-batch, written by the
executors (never collected to the driver), and are read back as a batch
DataFrame:

* ``complete``: the last micro-batch holds the whole result table;
* ``update``: the latest row per key over all micro-batches;
* ``append``: the union of all micro-batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from .ordered import LATENESS_US


def _has_batches(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def _drain(stream: DataFrame, name: str, out: str, ckpt: str, output_mode: str, timeout_s: int | None = None,
           processing_time: str | None = None) -> None:
    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch_id:012d}")

    w = (stream.writeStream.outputMode(output_mode).foreachBatch(sink)
         .option("checkpointLocation", ckpt).queryName(f"{name}_{uuid.uuid4().hex[:8]}"))
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    q = w.start()
    try:
        finished = q.awaitTermination(timeout_s) if timeout_s else (q.awaitTermination() or True)
        if q.exception() is not None:
            raise RuntimeError(f"stream {name} failed: {q.exception()}")
        if not finished:
            # never hand back a partial result as if it were whole
            raise TimeoutError(f"stream {name} did not drain its input within {timeout_s} s")
    finally:
        if q.isActive:
            q.stop()


def _result(stream: DataFrame, out: str, output_mode: str, keys: Sequence[str] | None) -> DataFrame:
    spark = stream.sparkSession
    if not _has_batches(spark, out):   # no micro-batch ran: the input is empty
        return spark.createDataFrame([], stream.schema)
    res = spark.read.parquet(out)
    cols = [c for c in res.columns if c != "epoch"]
    if output_mode == "complete":
        last = res.agg(F.max("epoch").alias("_e"))
        return res.join(last, res["epoch"] == last["_e"], "left_semi").select(*cols)
    if output_mode == "update":
        assert keys, "update mode needs the key columns"
        others = [c for c in cols if c not in keys]
        g = res.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col("epoch")).alias("_v"))
        return g.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in others])
    return res.select(*cols)


def run_available_now(stream: DataFrame, name: str, output_mode: str = "append",
                      keys: Sequence[str] | None = None, timeout_s: int | None = None,
                      processing_time: str | None = None) -> DataFrame:
    spark: SparkSession = stream.sparkSession
    out, ckpt = scratch_dir(spark, f"stream-{name}-out"), scratch_dir(spark, f"stream-{name}-ckpt")
    _drain(stream, name, out, ckpt, output_mode, timeout_s, processing_time)
    return _result(stream, out, output_mode, keys)


def run_to_end(spark: SparkSession, build: Callable[[DataFrame], DataFrame], name: str, until: datetime,
               output_mode: str = "append", keys: Sequence[str] | None = None) -> DataFrame:
    """Run an event-time ordered stream over a log that ends at ``until``.

    ``build`` gives the stream for a stream of ticks.  The log is drained first; then one
    tick moves the horizon to ``until``, and the same query, restarted from its
    checkpoint, decides what its state still holds."""
    out, ckpt = scratch_dir(spark, f"stream-{name}-out"), scratch_dir(spark, f"stream-{name}-ckpt")
    folder = scratch_dir(spark, f"stream-{name}-ticks")
    schema = "ts timestamp_ntz"
    spark.createDataFrame([], schema).write.parquet(folder)
    stream = build(spark.readStream.schema(schema).parquet(folder))
    _drain(stream, name, out, ckpt, output_mode)
    tick = until + timedelta(microseconds=LATENESS_US)
    spark.createDataFrame([(tick,)], schema).coalesce(1).write.mode("append").parquet(folder)
    _drain(stream, name, out, ckpt, output_mode)
    return _result(stream, out, output_mode, keys)


def log_end(log: DataFrame) -> datetime:
    """The first full second after a log's last event: one row for the driver."""
    last = log.agg(F.max("ts")).first()[0]
    return (last or datetime(1970, 1, 1)).replace(microsecond=0) + timedelta(seconds=1)
