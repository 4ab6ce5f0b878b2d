"""What a session needs before executors can run this package's Python functions."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows and bytes of a batch between the JVM and Python, at most: a batch exists on both sides,
#: once per task, and grows by doubling, so large ones cost executors hundreds of megabytes.
ROWS, BYTES = 2000, 8 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors through Spark's file server, once per application, and
    keep the batches that they exchange with Python small."""
    for key, most in (("maxRecordsPerBatch", ROWS), ("maxBytesPerBatch", BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="netloom-ship-")) / "netloom.zip"
        with zipfile.ZipFile(target, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark
