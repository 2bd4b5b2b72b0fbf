"""Making this package importable on the executors of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows of an Arrow batch on its way to Python: rows hold whole documents, which Spark's default of 10,000 would make too many.
BATCH_ROWS = 1000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once for each application, as spark-submit --py-files would, and bound Arrow batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="polis-")) / "polis.zip"
        with zipfile.ZipFile(path, "w") as out:
            for p in sorted(top.rglob("*.py")):
                out.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark
