"""Prepare a session for the package's Python code: importable in workers, wherever the driver was started, and in batches that suit long texts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch. Spark's default of 10,000 is meant for numbers; of texts of some kilobytes each it holds tens of megabytes several
#: times over, in the JVM and in Python. A session with a setting of its own keeps it.
BATCH, ROWS, DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000", "10000"


def shipped(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the workers of this application, once, and set the rows of a batch."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH) == DEFAULT:
        spark.conf.set(BATCH, ROWS)
    if sc.applicationId not in _shipped:
        folder = tempfile.mkdtemp(prefix="reportlake-sources-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = Path(__file__).resolve().parent
        target = Path(folder) / "reportlake.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    return spark
