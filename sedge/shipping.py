"""Ships this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Rows of an Arrow batch, where rows can hold whole documents.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Ship the package, and keep the session's Arrow batches at ``rows`` rows or
    fewer: a worker holds one batch as Python values."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(key))
    if held <= 0 or held > rows:
        spark.conf.set(key, str(rows))


def ship(spark: SparkSession) -> None:
    """Add this package to what Python workers can import, once an application:
    nodes of a cluster need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="sedge-")) / "sedge.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
