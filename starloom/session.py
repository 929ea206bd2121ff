"""Session helpers: runtime settings and the shared folder for barriers and scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators count on; all of them are safe to change on a live session.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split skewed join partitions even when that costs one more shuffle further down the plan.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply :data:`RUNTIME_SETTINGS` to a session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(name: str = "starloom", cpus: str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        # Do not walk the Python stack for every column expression while plans are built.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    A machine-local folder is made up only in local mode, where driver and executors are one process.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    active = context.getCheckpointDir()
    if configured is None and active is None:
        # local-cluster has executors of its own, so it needs a shared folder like any cluster.
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="starloom-")
    if active is None:
        context.setCheckpointDir(configured)
    return configured or active


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/starloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, among those of this application."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of a path, as the JVM has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def claim(spark: SparkSession, path: str) -> bool:
    """Make an empty file. Of several drivers that try, exactly one gets True, at once and without waiting."""
    fs, at = hadoop_path(spark, path)
    fs.mkdirs(at.getParent())
    try:
        if fs.getUri().getScheme() == "file":
            # Hadoop's local file system looks first and creates then; this is one step.
            local = spark._jvm.java.io.File(at.toUri().getPath()).toPath()
            spark._jvm.java.nio.file.Files.createFile(local, spark.sparkContext._gateway.new_array(spark._jvm.java.nio.file.attribute.FileAttribute, 0))
        else:
            fs.create(at, False).close()
    except Py4JJavaError as failed:
        if "AlreadyExists" not in failed.java_exception.getClass().getName() and not fs.exists(at):
            raise
        return False
    return True


def drop_scratch(spark: SparkSession) -> bool:
    """Delete this application's scratch tables, once every result that reads them is written."""
    root = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def barrier(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table below the shared folder and read it back.

    What comes after does not depend on the work before, which runs once: losing an executor means
    reading files again. As columns, so each later pass reads only what it needs.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
