"""Spark session defaults for the engine.

All slot arithmetic is UTC, AQE re-plans joins and partition counts at
runtime, and streaming state lives in RocksDB.  ``get_session`` sets these
only where the submitted configuration doesn't.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "vigilspark") -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_utc(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    wanted = dict(_DEFAULTS)
    if master:
        wanted["spark.master"] = master
        wanted["spark.driver.memory"] = os.environ.get("VIGIL_DRIVER_MEM", "16g")
    if shuffle_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    submitted = SparkConf()  # spark-submit's own settings, which stay
    for key, value in wanted.items():
        if not submitted.contains(key):
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_utc(spark)
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """Slot keys and day boundaries are defined in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Driver and executors must all see it.  Only a ``local[...]`` session,
    where they are one process, gets a scratch folder when it is unset; any
    other master without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    found = tempfile.mkdtemp(prefix="vigil-ckpt-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def store(df, path: str | None = None):
    """Write ``df`` once as parquet under the shared folder and read it back.

    Consumers read only the columns they need, AQE sees real sizes, and an
    executor lost later never triggers a recomputation from the source,
    because the lineage starts at the stored table.
    """
    spark = df.sparkSession
    path = path or f"{checkpoint_dir(spark)}/vigil-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df):
    """``store`` under a fresh name."""
    return store(df)


def discard(df) -> None:
    """Delete a table written by ``store`` once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    base = checkpoint_dir(spark)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/vigil-" in folder and folder.split(":", 1)[-1].lstrip("/").startswith(base.split(":", 1)[-1].lstrip("/")):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
