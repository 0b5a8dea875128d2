"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import re
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# Settings that matter at any scale: adaptive execution re-plans joins and
# partition counts from real shuffle sizes (partitions sized to the advisory
# size, not to the number of cores) and splits skewed join partitions. On a
# cluster, start from a generous spark.sql.shuffle.partitions (or
# ...coalescePartitions.initialPartitionNum) of about input bytes / 128 MB and
# let adaptive execution merge the small ones.
CLUSTER_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "holdfast", conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    ``master`` is left to the launcher on a cluster; tests and the bench pass
    ``local[N]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CLUSTER_DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    Read from the session. Only with a ``local`` master (one machine, as in
    tests) is a fresh local folder created where none is named: on a cluster
    every executor would write to its own disk, so that is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a Spark Connect session has no SparkContext
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder") from None
        return root
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="holdfast-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared checkpoint root."""
    return os.path.join(checkpoint_root(spark), "holdfast-scratch", f"{name}-{uuid.uuid4().hex}")


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, whatever store it is in, and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files directly under ``path``, sorted; none if it does not exist."""
    files, where = _file_system(spark, path)
    if not files.exists(where):
        return []
    names = (status.getPath().getName() for status in files.listStatus(where) if status.isFile())
    return sorted(n for n in names if not n.startswith((".", "_")))


def folder_ages(spark: SparkSession, path: str) -> dict[str, float]:
    """Seconds since each folder directly under ``path`` was last changed, by name."""
    files, where = _file_system(spark, path)
    if not files.exists(where):
        return {}
    return {s.getPath().getName(): time.time() - s.getModificationTime() / 1000 for s in files.listStatus(where) if s.isDirectory()}


def read_small_file(spark: SparkSession, path: str) -> str:
    files, where = _file_system(spark, path)
    stream = files.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_file_if_absent(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file with all its content in one step; False if there is one already.

    The content is written beside it first. On a local disk a hard link makes it
    appear under its name, elsewhere a rename that does not replace: both fail if
    the name is taken, whoever took it. (A store whose rename replaces, such as
    plain S3, is no place for tables that several jobs write.)
    """
    files, where = _file_system(spark, path)
    hadoop, nio = spark._jvm.org.apache.hadoop.fs, spark._jvm.java.nio.file
    files.mkdirs(where.getParent())
    draft = hadoop.Path(where.getParent(), f".{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(content.encode())
    stream.close()
    try:
        if files.getScheme() == "file":
            local = lambda p: nio.Path.of(p.toUri())
            nio.Files.createLink(local(files.makeQualified(where)), local(files.makeQualified(draft)))
        else:
            context = hadoop.FileContext.getFileContext(where.toUri(), files.getConf())
            none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename").NONE
            context.rename(draft, where, none)
        return True
    except Py4JJavaError as taken:
        if "AlreadyExists" not in taken.java_exception.getClass().getName():
            raise
        return False
    finally:
        files.delete(draft, False)


def remove_folder(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)
