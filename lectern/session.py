"""Sessions, table access and cutting of lineage."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8, **more: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lectern")
    for key, value in {**DEFAULTS, "spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(partitions), **more}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    return session


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started.

    Workers on this machine get its place in their path; a cluster gets the
    package as a zip file, once a session.  A task has one core, so matrix
    products of a worker run in one thread: idle ones would spin."""
    context = spark.sparkContext
    context.environment.setdefault("OPENBLAS_NUM_THREADS", "1")
    have = context.environment.get("PYTHONPATH", "")
    if ROOT in have.split(os.pathsep):
        return
    context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, have]))
    if not context.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(os.path.join(folder, "lectern"), "zip", ROOT, "lectern"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a table for work that is heavy per row.

    A table of fewer splits than the cluster has cores (one small file, say) is
    dealt out to all cores; larger tables are read as they lie, without a
    shuffle."""
    df = table(spark, folder, name)
    if columns:
        df = df.select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session (tests, one machine) may lack the setting: a temporary
    folder is then made, set for the session, and removed when the process ends.
    On a cluster a folder of one machine would lose data, so the lack is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark).rstrip("/"), f"{name}-{uuid.uuid4().hex[:12]}")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back.

    This ends the lineage: later stages read the files, which outlive any
    executor, and what is written is computed once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: str = "4m"):
    """Plans run inside hand Python tasks batches of ``most`` bytes, or of one
    larger row.  Spark's own bound of 64 MB is held several times over: in Arrow
    vectors that double, in the buffer they are sent from, and in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drop_cut(*tables: DataFrame) -> None:
    """Remove the files behind tables made by :func:`cut` once nobody needs them."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_cut_path", None)
        if path is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
