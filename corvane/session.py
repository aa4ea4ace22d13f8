"""Session services: shipping the package to executors, and cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_TEMPORARY: list[list[DataFrame]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once per application, and unless the session sets another
    size, lets an Arrow batch hold at most 1,000 rows, as rows are whole texts."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="corvane-"), "corvane.zip")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    with open(target, "wb") as f:
        f.write(buffer.getvalue())
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (tests, local mode), one made for this application."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = f"corvane-{spark.sparkContext.applicationId}"
    return "file://" + os.path.join(tempfile.gettempdir(), key)


@contextmanager
def temporary():
    """Removes at its end the tables that materialize writes within, but for those to keep."""
    outer, own = _TEMPORARY[:], []
    _TEMPORARY[:] = [own]
    try:
        yield
    finally:
        _TEMPORARY[:] = outer
        release(*own)


def materialize(df: DataFrame, name: str = "stage", keep: bool = False) -> DataFrame:
    """Writes df as a compressed table in the shared folder and reads it back, which cuts its lineage.

    The table outlives executors. It is removed by release or when the application ends. What was shuffled to write it
    is removed as soon as it is written, as nothing reads it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if _TEMPORARY and not keep:
        _TEMPORARY[0].append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables that materialize wrote and that no later action reads."""
    for t in tables:
        _remove(t.sparkSession, t._written)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the gateway may be gone already
        pass
