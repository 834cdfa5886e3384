"""Folders for what a job writes between its steps, where all executors see them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import EngineError

_created: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, one of our own, on a single machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise EngineError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        base = tempfile.mkdtemp(prefix="tarn-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, True)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it goes when it is deleted or the process ends."""
    path = f"{shared_dir(spark)}/tarn/{name}-{uuid.uuid4().hex}"
    _created.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder now."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if (spark, path) in _created:
        _created.remove((spark, path))


def mark() -> int:
    """A place in the list of paths made so far, for ``release``."""
    return len(_created)


def release(since: int, *keep: str) -> None:
    """Delete the paths made since a mark but for some: when a step's result is written, its intermediate tables are of no more use."""
    for spark, path in _created[since:]:
        if path not in keep:
            delete(spark, path)


def _at_exit() -> None:
    for spark, path in list(_created):
        try:
            delete(spark, path)
        except Exception:  # the session has ended already; a shared scratch folder is then the cluster's to clear
            return


atexit.register(_at_exit)
