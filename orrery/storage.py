"""Where intermediate tables live.

Lineage is cut by writing a Parquet table below the folder the cluster names in
``spark.checkpoint.dir`` (shared by the driver and all executors).  A folder of
our own is made only where that setting is missing, as in local tests.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder as a URI without a trailing slash.

    Without ``spark.checkpoint.dir`` a folder of this machine is made only where
    driver and executors are one process; elsewhere executors couldn't see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="orrery-")
        root = _OWN[context.applicationId]
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/orrery/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    Unlike ``DataFrame.checkpoint`` the rows are computed once, not twice.  Tables
    that nothing reads any more can be given to ``discard``; what is left goes when
    the driver ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _sweep_at_exit(spark)
    out = spark.read.schema(df.schema).parquet(path)
    _LIVE[path] = spark.sparkContext.applicationId
    out._orrery_path = path
    return out


_LIVE: dict[str, str] = {}
_SWEPT: set[str] = set()


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` (the frames that it returned) that no plan reads any more."""
    for table in tables:
        path = getattr(table, "_orrery_path", None)
        if _LIVE.pop(path, None) is not None:
            _delete(table.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are gone: it does when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep_at_exit(spark: SparkSession) -> None:
    """Once an application: delete what it has stored when the driver ends."""
    app = spark.sparkContext.applicationId
    if app in _SWEPT:
        return
    _SWEPT.add(app)

    def sweep() -> None:
        context = spark.sparkContext
        if getattr(context, "_jsc", None) is None or context.applicationId != app:
            return
        with contextlib.suppress(Exception):  # the JVM may be gone already
            for path in [p for p, a in _LIVE.items() if a == app]:
                del _LIVE[path]
                _delete(spark, path)

    atexit.register(sweep)


BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="orrery-package-")  # executors may fetch it at any time
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "orrery_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, f"{root.name}/{source.relative_to(root)}")
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def _hand_back() -> None:
    """Give what this process has freed back to the system: Arrow's pool and, with glibc, the heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _tidy(function: Callable) -> Callable:
    """``function``, after which the worker holds no freed memory: workers outlive their tasks, beside the next stages' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            _hand_back()

    return run


def in_arrow(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the executors, whose workers hand back memory after each task.

    Rows may hold long texts, so a session that is at Spark's default of 10,000
    rows a batch is set to ``BATCH_ROWS``; any other setting stays.
    """
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING) == "10000":
        conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(_tidy(function), schema)
