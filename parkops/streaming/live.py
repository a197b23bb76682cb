"""Production wiring of the live jobs: long-running streams on a trigger.

The reference's screens poll every 15 seconds; here each live figure is a
Structured Streaming query with ``processingTime='15 seconds'`` that keeps
its state in the shared checkpoint folder (so a restarted driver or a lost
executor resumes where it stopped) and publishes every micro-batch as
Parquet written by the executors.

A table (complete or update mode) is written to a folder of its own each time;
then a pointer file is switched to it by one rename, so a reader always finds
a whole table.  The folder before stays for those who are still reading it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.fixtures import model
from . import jobs as sj

POLL = "15 seconds"
POINTER = "_current"


def _files(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, at, at.getFileSystem(conf)


def current_folder(spark: SparkSession, table: str) -> str | None:
    """The folder that holds the published table, None before the first one."""
    jvm, _, at, fs = _files(spark, f"{table}/{POINTER}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return f"{table}/{jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
    finally:
        stream.close()


def switch_table(spark: SparkSession, table: str, df: DataFrame) -> None:
    """Publish ``df`` as the whole table, which readers see at once or not yet."""
    jvm, conf, at, fs = _files(spark, table)
    old = current_folder(spark, table)
    name = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{table}/{name}")
    path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{table}/{p}")
    fresh = path(f"{POINTER}-{name}")
    out = fs.create(fresh)
    out.write(bytearray(name, "utf-8"))
    out.close()
    overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(fresh, path(POINTER), options)
    keep = {name, old and old.rsplit("/", 1)[1]}
    for status in fs.listStatus(at):
        folder = status.getPath().getName()
        if folder.startswith("version-") and folder not in keep:
            fs.delete(status.getPath(), True)


def read_live(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """What a live job has published: the current table, or all rows so far."""
    folder = current_folder(spark, f"{out_dir}/{name}")
    return spark.read.parquet(folder) if folder else spark.read.parquet(f"{out_dir}/{name}").drop("epoch")


def clock_ticks(spark: SparkSession) -> DataFrame:
    """The wall clock as a stream of ticks, once a second: bookings then end on time also when no event comes."""
    return spark.readStream.format("rate").load().select(F.col("timestamp").cast("timestamp_ntz").alias("ts"))


def _publish(stream: DataFrame, name: str, out_dir: str, ckpt_dir: str, mode: str, trigger: str | None,
             shape: Callable[[DataFrame], DataFrame] = lambda df: df, keys: Sequence[str] = ()) -> StreamingQuery:
    table = f"{out_dir}/{name}"

    def sink(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        if mode == "append":   # each micro-batch adds its own folder
            batch.transform(shape).write.mode("overwrite").parquet(f"{table}/epoch={epoch_id:012d}")
            return
        new = shape(batch)
        if mode == "update" and (old := current_folder(spark, table)):   # rows of other keys stay
            new = new.unionByName(spark.read.parquet(old).join(new.select(*keys), [*keys], "left_anti"))
        switch_table(spark, table, new)

    w = (stream.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", f"{ckpt_dir}/{name}").queryName(f"live_{name}"))
    w = w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)
    return w.start()


def start_live_jobs(spark: SparkSession, events_dir: str, out_dir: str, ckpt_dir: str,
                    trigger: str | None = POLL, ticks: DataFrame | None = None) -> dict[str, StreamingQuery]:
    """Start the live dashboard streams over the event folder ``events_dir``.

    ``trigger=None`` runs each stream once over what is there (``availableNow``), as
    a back-fill.  ``ticks`` (:func:`clock_ticks`, or a folder of them) moves the
    horizon of spots, pairing and bookings when no event does."""
    m = model(spark, events_dir, streams=("events",))
    log = m.lot_events("vehicle")

    def start(name, stream, mode, shape=lambda df: df, keys=()):
        return _publish(stream, name, out_dir, ckpt_dir, mode, trigger, shape, keys)

    queries = [
        start("hourly_entries", sj.hourly_entries(m.sessions), "complete", sj.hourly_entries_out),
        start("daily_revenue", sj.daily_revenue(m.sessions), "complete", sj.daily_revenue_out),
        start("spot_state", sj.spot_state(log, m.spots, ticks), "update", lambda df: sj.spot_state_out(df, m.spots), ["spot_id"]),
        start("session_pairing", sj.session_pairing_stream(log, ticks), "append"),
        start("booking_expiry", sj.booking_expiry_stream(log, m.spots, ticks), "append"),
    ]
    return {q.name.removeprefix("live_"): q for q in queries}
