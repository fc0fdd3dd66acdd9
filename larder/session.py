"""Session settings, and the package's own code for the workers."""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows in an Arrow batch.
BATCH_ROWS = 500
_HERE = Path(__file__).resolve().parent


def session(app: str = "larder", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; master, memory and partitions are the cluster's, or ``conf``."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Gives the workers this package, wherever the driver imported it from; once for each context."""
    sc = spark.sparkContext
    # texts come in batches of rows: few enough that a batch of long ones fits beside the others in a worker
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(sc, "_larder_shipped", False):
        return spark
    files = sorted(p for p in _HERE.rglob("*.py"))
    mark = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    folder = Path(tempfile.mkdtemp(prefix="larder-code-"))
    with zipfile.ZipFile(folder / f"larder-{mark}.zip", "w") as z:
        for p in files:
            z.write(p, p.relative_to(_HERE.parent))
    sc.addPyFile(str(folder / f"larder-{mark}.zip"))
    sc._larder_shipped = True
    return spark
