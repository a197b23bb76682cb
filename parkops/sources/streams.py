"""Streaming reads of the input tables (file source).

A file stream needs a folder and an explicit schema.  A table stored as a
folder of files (the usual layout) is streamed from that folder; a table
stored as a single file is picked out of its parent folder with
``pathGlobFilter``.  ``maxFilesPerTrigger`` bounds each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import RAW_SCHEMAS, table_path


def _is_dir(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def read_stream_table(spark: SparkSession, base_dir: str, name: str, max_files: int = 64) -> DataFrame:
    path = table_path(base_dir, name)
    schema = RAW_SCHEMAS.get(name) or spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if _is_dir(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(base_dir.rstrip("/"))
