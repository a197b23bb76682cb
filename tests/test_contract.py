"""The driver contract from a foreign working directory and a plain session."""

import os
import subprocess
import sys
import tempfile

from settings import ROOT, SF_SMALL

SCRIPT = """
import importlib.util, sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
spec = importlib.util.spec_from_file_location("entry", {entry!r})
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
assert E.entry(spark).count() > 0
q = E.queries()
# queries whose work runs Python on the executors (grouped pandas, stream state)
for name in ("spot_booking_admission", "stream_session_pairing"):
    assert q[name](spark, {sf!r}).count() > 0, name
print("CONTRACT-OK")
"""


def test_entry_and_python_steps_from_another_directory():
    cwd = tempfile.mkdtemp(prefix="driver-")
    code = SCRIPT.format(entry=os.path.join(ROOT, "__spark_entry__.py"), sf=SF_SMALL)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", code], cwd=cwd, env=env, capture_output=True, text=True,
                       timeout=600)
    assert "CONTRACT-OK" in r.stdout, r.stderr[-3000:]
