"""Getting this package to the executors, and cutting lineage in the folder that all machines share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_shipped: set[str] = set()
_kept: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def ship(spark: SparkSession) -> None:
    """Sends the package's source to all Python workers, once an application; Arrow UDFs import it there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="gridloom-source-")
    path = os.path.join(folder, "gridloom-source.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.join("gridloom", os.path.relpath(full, top)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local session may go without: it gets a temporary one."""
    where = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
    where = tempfile.mkdtemp(prefix="gridloom-")
    spark.conf.set(SETTING, where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/gridloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that a lost executor costs no earlier stage.

    The files are removed by ``free``, else when the driver's Python ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _kept[out] = path
    return out


def free(*tables: DataFrame) -> None:
    """Removes the files of tables that ``cut`` returned, when nothing that is still to run reads them."""
    for table in tables:
        if path := _kept.pop(table, None):
            _remove(table.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone; its files then stay for the folder's owner
        pass
