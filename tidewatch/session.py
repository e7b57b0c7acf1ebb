"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
METHOD_LIMIT, METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"


def build_session(app: str = "tidewatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library expects; the caller's settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        METHOD_LIMIT: METHOD_BYTES,
        "spark.python.unix.domain.socket.enabled": "true",
        STATE_STORE: ROCKSDB,
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, so that functions sent to them can be found wherever they run."""
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tidewatch-"), "tidewatch.zip")  # the driver serves it from here
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)


def use_utc(spark: SparkSession) -> SparkSession:
    """Hours, weekends and text timestamps are all defined in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def use_small_methods(spark: SparkSession) -> SparkSession:
    """Run wide projections by compiled code.

    The JVM interprets methods beyond 8000 bytes for good.  Generated code of
    a stage that would need one is left for operators with code in pieces.
    """
    spark.conf.set(METHOD_LIMIT, METHOD_BYTES)
    return spark


def use_rocksdb_state(spark: SparkSession) -> SparkSession:
    """Per-address state needs the RocksDB store."""
    spark.conf.set(STATE_STORE, ROCKSDB)
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder stands in for it in local mode only.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
        root = context.getCheckpointDir()
    return root


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where one expensive or filtered input feeds several branches.  A
    Parquet table is preferred to ``checkpoint()`` because each branch then
    reads only its own columns.  Shuffle files of the write go when it ends,
    not when the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, work_path(df.sparkSession, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # a frame takes the setting when it is made
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release_staged(spark: SparkSession) -> None:
    """Delete what this application staged below the shared folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(
        f"{shared_root(spark).rstrip('/')}/{spark.sparkContext.applicationId}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path, True)
