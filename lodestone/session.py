"""The package on the executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch that goes to a Python worker; rows of long texts would otherwise make batches of gigabytes.
BATCH_BYTES = 16 << 20
_BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that Python functions find it wherever the driver was
    started, and bounds the batches they are given."""
    sc = spark.sparkContext
    if int(spark.conf.get(_BYTES_PER_BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BYTES_PER_BATCH, str(BATCH_BYTES))
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent.parent
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='lodestone-')}/lodestone", "zip", root, "lodestone"))
        _shipped.add(sc.applicationId)
