"""Session set-up and the shared working folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on.  All are runtime SQL
# settings, so they can be applied to a session somebody else built.
REQUIRED_SQL_SETTINGS = {
    # epoch milliseconds in storage paths and zone-free timestamps are UTC
    "spark.sql.session.timeZone": "UTC",
    # a repeated JSON key keeps its last value instead of failing the parse
    "spark.sql.variant.allowDuplicateKeys": "true",
    # hot keys of a join are split at run time
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # state of streams lies on disk, not in executors' heaps
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # conditions on names reach the listing of a store
    "spark.sql.python.filterPushdown.enabled": "true",
}
T = TypeVar("T")
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build_session(app_name: str = "stackroom", master: str | None = None, **settings: str) -> SparkSession:
    """Session for tests and benchmarks; a cluster passes its own settings in."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        # no stack trace for every column expression: plans are built several times faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in {**REQUIRED_SQL_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators need to an existing session.

    Python workers find this package where it is not installed but its folder is visible.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    for key, value in REQUIRED_SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession) -> str:
    """Folder for written tables and stream checkpoints.

    ``spark.checkpoint.dir`` names it, in every mode.  Where that is unset, the
    warehouse is used, which executors share as well.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return shared.rstrip("/") + "/stackroom"


_made: dict[str, list[str]] = {}


def new_run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below :func:`work_dir` for one run of a writing job."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a Parquet table in the shared folder: computed once, and kept when executors are lost."""
    path = new_run_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


_kept: dict[tuple[str, str], Any] = {}


def kept(spark: SparkSession, name: str, build: Callable[[], T]) -> T:
    """What ``build`` stores (a table, or its path), stored once in an application: for what is there before a query."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def run_dirs(spark: SparkSession) -> int:
    """How many folders this application's runs have made so far: a mark for :func:`remove_run_dirs`."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def remove_run_dirs(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Remove the folders of this application's runs, once nothing reads their results any more.

    Those made since a mark, all but the last ``but`` of them: a stage's own tables when its output is written.
    """
    application = spark.sparkContext.applicationId
    made = _made.get(application, [])
    gone = made[since : len(made) - but]
    made[since : len(made) - but] = []
    if since == 0:
        for key in [k for k in _kept if k[0] == application]:
            del _kept[key]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
