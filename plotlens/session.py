"""Session helpers: a local session for tests and benches, and tables staged in the shared folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables staged inside the scope that is open, if one is.
_SCOPE: ContextVar[list[DataFrame] | None] = ContextVar("staged_tables", default=None)
_LOCK, _WRITES = threading.Lock(), {"now": 0, "before": "false"}


def local_session(cores: int | str = 8, app: str = "plotlens") -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEM", "8g"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="plotlens-warehouse-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine may have none; it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="plotlens-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over all cores: a table in few files or row groups leaves the work on its rows to as few tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage: a lost executor costs only the tasks that read it, and what stands
    above has plain exchanges on both sides of its joins, which AQE can split when skewed. The
    shuffle files of the write go as soon as it has ended. With ``keep`` the table outlives the
    ``staging_scope`` that it is written in.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/plotlens-{name}-{uuid.uuid4().hex}"
    with _LOCK:  # the setting is the session's: the first of several writes changes it, the last puts it back
        if not _WRITES["now"]:
            _WRITES["before"] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _WRITES["now"] += 1
    try:
        df.write.parquet(path)
    finally:
        with _LOCK:
            _WRITES["now"] -= 1
            if not _WRITES["now"]:
                spark.conf.set(CLEANUP, _WRITES["before"])
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    if not keep and (scope := _SCOPE.get()) is not None:
        scope.append(out)
    return out


@contextmanager
def staging_scope() -> Iterator[None]:
    """Whatever is staged inside is deleted at the end: for a job that has written its result by then."""
    tables: list[DataFrame] = []
    token = _SCOPE.set(tables)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        drop_staged(*tables)


def drop_staged(*tables: DataFrame) -> None:
    """Delete tables that ``staged`` returned and that no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
