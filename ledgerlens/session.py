"""Session set-up and the few run-time services the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side must stay far below executor memory: 200 000 narrow rows are roughly 20 MB.
MAX_BROADCAST_ROWS = 200_000
# Folder of the innermost open `scratch_scope`, below the run's.
_SCOPE = ""
# What is stored inside each open `parts_dropped`.
_STORED: list[list[DataFrame]] = []


def build_session(app: str = "ledgerlens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect (ANSI on, AQE on, UTC)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can reach: the one named by `spark.checkpoint.dir`.

    Only a session on one machine (`local[...]`) may go without; it then gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ledgerlens-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def run_folder(spark: SparkSession) -> str:
    """The one folder below the shared one that holds everything this application stores."""
    return f"{shared_dir(spark).rstrip('/')}/ledgerlens-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the run's folder; never reused between runs."""
    return f"{run_folder(spark)}/{_SCOPE}{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete what this application has stored; call it when its results have been written."""
    delete_folder(spark, run_folder(spark))


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """What `scratch_path` names inside lies in one folder, which is given to the caller to delete."""
    global _SCOPE
    outer, _SCOPE = _SCOPE, f"{_SCOPE}scope-{uuid.uuid4().hex}/"
    try:
        yield f"{run_folder(spark)}/{_SCOPE}".rstrip("/")
    finally:
        _SCOPE = outer


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files are deleted when it ends, not when the driver's memory happens to be collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives lost executors and is computed once; the shuffle files it came from are deleted."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    with shuffles_dropped(spark):
        stored = df.checkpoint(eager=True)
    if _STORED:
        _STORED[-1].append(stored)
    return stored


def drop_stored(stored: DataFrame) -> None:
    """Delete what `cut_lineage` has stored."""
    file = stored._jdf.logicalPlan().rdd().getCheckpointFile()
    if file.isDefined():
        delete_folder(stored.sparkSession, file.get())


@contextmanager
def parts_dropped() -> Iterator[None]:
    """Inside, one result is built and stored last by `cut_lineage`; what was stored on the way to it is deleted at the end.

    The result must not be read through what was stored before it, which is so if it is itself stored.
    """
    _STORED.append([])
    try:
        yield
    finally:
        for part in _STORED.pop()[:-1]:
            drop_stored(part)


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a size check; above the bound the join stays a shuffle join.

    `df` should be cheap to count (stored, or a small aggregate).
    """
    if df.count() <= max_rows:
        return F.broadcast(df)
    return df
