"""A folder that all executors share, for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; below a temporary one only where the session has none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lodestone-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
