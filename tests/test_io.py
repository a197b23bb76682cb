"""Sources and sinks: JSON documents round trip, sink formats, explicit schemas."""

import os
import tempfile

from pyspark.sql import functions as F

from settings import SF_SMALL
from parkops.schemas import SPOT_DOCUMENT
from parkops.sources import io
from parkops.sources.fixtures import model
from parkops.sources.tables import RAW_SCHEMAS, read_table


def test_spot_documents_round_trip(spark):
    docs = model(spark, SF_SMALL).spot_documents.filter("doc_id % 50 <> 49")   # the others are cut off: tests/test_lookups.py
    back = docs.select("doc_id", F.to_json(F.from_json("doc", SPOT_DOCUMENT)).alias("again"), "doc")
    assert back.filter(F.col("again") != F.col("doc")).count() == 0


def test_sink_formats_and_partition_pruning(spark):
    df = model(spark, SF_SMALL).sessions.select("id", F.to_date("entry_time").alias("d"))
    base = tempfile.mkdtemp(prefix="sink-", dir=os.environ.get("TMPDIR", "/tmp"))
    p = io.write_result(df, f"{base}/pq", partition_by=["d"])
    j = io.write_result(df, f"{base}/js", fmt="json")
    one = io.scan_table(spark, p, where=F.col("d") == F.lit("2024-01-05").cast("date"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(d" in plan
    assert one.count() == df.filter(F.col("d") == F.lit("2024-01-05").cast("date")).count()
    assert spark.read.json(j).count() == df.count()


def test_explicit_schemas_match_the_files(spark):
    for name, schema in RAW_SCHEMAS.items():
        inferred = spark.read.parquet(f"{SF_SMALL}/{name}.parquet").schema
        assert [(f.name, f.dataType) for f in inferred] == [(f.name, f.dataType) for f in schema], name
        assert read_table(spark, SF_SMALL, name).limit(1).count() == 1


def test_cleanup_removes_intermediate_folders(spark):
    import os

    from parkops.plans.materialize import materialize
    from parkops.session import _SCRATCH, cleanup_scratch
    df = materialize(spark.range(10), "cleanup-check")
    assert df.count() == 10
    path = _SCRATCH[-1]
    assert os.path.exists(path.replace("file:", ""))
    assert cleanup_scratch(spark) >= 1
    assert not os.path.exists(path.replace("file:", ""))
