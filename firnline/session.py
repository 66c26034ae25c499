"""Session settings and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


#: By application id: scratch folders of local applications that name none, paths
#: handed out, and tables landed once.
_LOCAL_FOLDERS: dict[str, str] = {}
_SCRATCH: dict[str, list[str]] = {}
_LANDED: dict[str, dict[tuple, str]] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on.

    Days, months and winters are calendar facts in UTC, so the session time zone
    is pinned. AQE picks join strategies from real sizes and splits skewed joins.
    A window or aggregate over (station, slice) must not settle for rows that are
    already partitioned by station alone, or a hot station would stay in one task.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.requireAllClusterKeysForDistribution", "true")
    return spark


def build_session(app_name: str = "firnline", master: str | None = None, **conf) -> SparkSession:
    """Create (or fetch) a session; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in
    ``spark.checkpoint.dir``. Where it is unset, a fresh temporary folder is used
    in local mode only; a cluster without the setting is an error, because a
    machine-local folder is invisible to the other machines."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="firnline-")
    return _LOCAL_FOLDERS[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one written table under the shared folder; ``release``
    removes what is written there."""
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _hadoop(spark: SparkSession, path: str):
    """A path and its file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def modified(spark: SparkSession, path: str) -> int:
    """When a file or folder was last changed, in milliseconds."""
    found, files = _hadoop(spark, path)
    return files.getFileStatus(found).getModificationTime()


def landed(spark: SparkSession, name: str, source: tuple, write: Callable[[str], str]) -> str:
    """Path of a table that ``write`` stores at a scratch path, once per session and
    ``source``; name the time of the source's last change in it."""
    tables = _LANDED.setdefault(spark.sparkContext.applicationId, {})
    if (name, source) not in tables:
        tables[name, source] = write(scratch_path(spark, name))
    return tables[name, source]


def release(spark: SparkSession) -> None:
    """Remove every table this session wrote to a scratch path. DataFrames that still
    read them are void, so call it when all results are written or collected."""
    application = spark.sparkContext.applicationId
    _LANDED.pop(application, None)
    for path in _SCRATCH.pop(application, []):
        found, files = _hadoop(spark, path)
        files.delete(found, True)


def enable_checkpoints(spark: SparkSession) -> None:
    """Give iterative learners a checkpoint folder if the cluster set none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
