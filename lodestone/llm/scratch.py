"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers up to which a table is worked on in one task: shuffling so few costs more than it saves.
MOST_TOGETHER = 400_000
#: Bytes up to which a table is broadcast, by its counted rows and the width of its columns.
MOST_BROADCAST = 48 << 20
_WIDTH = {"boolean": 1, "int": 4, "float": 4, "long": 8, "bigint": 8, "double": 8}
_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder of spark.checkpoint.dir, or the one given to setCheckpointDir; a temporary one only for a local master."""
    sc = spark.sparkContext
    if sc.applicationId not in _roots:
        given = sc._jsc.sc().getCheckpointDir()
        base = spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None)
        if not base:
            if not (sc.master or "").startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="lodestone-")
        root = f"{base.rstrip('/')}/lodestone-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        _roots[sc.applicationId] = root
        atexit.register(_remove_quietly, spark, root)
    return _roots[sc.applicationId]


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders in whatever store they lie."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_quietly(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            remove(spark, root)
        except Exception:  # the session is going down; the folder is only scratch
            pass


def trim(spark: SparkSession) -> str | None:
    """Has the driver's JVM give free native memory back to the system, and returns what it says; None from a JVM that
    cannot. Planning many large queries leaves much of it in pieces, which collecting garbage does not return."""
    gateway = spark.sparkContext._gateway
    jvm, new = gateway.jvm, gateway.new_array
    try:
        # through the interface, since the server's own class is closed to reflection
        names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        kinds, given = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        for i, name in enumerate(names):
            kinds[i] = jvm.java.lang.Class.forName(name)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        given[2], given[3] = new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0)
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(server, given)
    except Py4JError:
        return None


class Scratch:
    """Parquet tables of one run. drop() deletes those that no result reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back: what follows depends on shared files, not on executors."""
        return self.cut_at(df, self.path(name))

    def cut_at(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            files = df.inputFiles()
            if files:
                remove(self.spark, files[0].rsplit("/", 1)[0])
        self.release()

    def release(self) -> None:
        """Shuffle files go when the driver forgets the plans that made them; this makes it forget now, and give back memory."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        trim(self.spark)


def row_bytes(table: DataFrame) -> int:
    """Bytes that a row takes in a broadcast relation; strings and nested values count as 160."""
    return 24 + sum(_WIDTH.get(f.dataType.simpleString(), 160) for f in table.schema.fields)


def small_side(table: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A written table, marked for broadcast only if its counted rows take at most `most` bytes."""
    return F.broadcast(table) if table.count() * row_bytes(table) <= most else table


def together(table: DataFrame, small: bool) -> DataFrame:
    """A table of a checked size in one partition, so that joins and sums over it need no exchange; others as they are."""
    return table.coalesce(1) if small else table


def semi_join(big: DataFrame, wanted: DataFrame, key: str, most: int = MOST_BROADCAST) -> DataFrame:
    """Rows of big whose key is in wanted, a written table of distinct keys."""
    return big.join(small_side(wanted, most), key, "left_semi")
