"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where
    driver and executors are one process, gets a folder of its own when unset.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="strataweave-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables below the shared one; removed when the driver's interpreter ends, for results may be read until then."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    atexit.register(_remove, jvm, conf, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    _remove(spark._jvm, spark._jsc.hadoopConfiguration(), path)


def _remove(jvm, conf, path: str) -> None:
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # the JVM has gone: the folder stays
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Arrow batches of at most ``size`` bytes: by default thousands of whole texts would cross to Python at once. A smaller bound that is set stays.

    Batches are cut when a query runs, not when it is made, so the setting stays in the caller's session; it changes no result.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    text = spark._jsparkSession.sessionState().conf().getConfString(key, "64m")
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)
    if now <= 0 or now > size:
        spark.conf.set(key, str(size))


def workers_find_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if no search path says so; a cluster needs it at that path or installed."""
    import os

    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if home not in known:
        env["PYTHONPATH"] = os.pathsep.join([home, *filter(None, known)])
