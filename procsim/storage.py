"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This process's folder in the one that driver and executors share (``spark.checkpoint.dir``); it goes when the process ends, if a session still runs then.

    Only where the session names none, and only on a local master, a temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors")
    if (named or "") not in _folders:
        if named:
            _folders[named] = f"{named.rstrip('/')}/procsim-{uuid.uuid4().hex}"
            atexit.register(_clear_at_exit, named)
        else:
            made = tempfile.mkdtemp(prefix="procsim-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            _folders[""] = f"file://{made}"
    return _folders[named or ""]


def _clear_at_exit(named: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Py4JError):  # the JVM may be going as well
            clear(spark, named)


def clear(spark: SparkSession, named: str = "") -> None:
    """Remove what this process has staged, as far as the session still runs; DataFrames that read it can't be used any more."""
    folder = _folders.get(named or spark.conf.get("spark.checkpoint.dir", None) or "")
    if folder is None or spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: what is read later doesn't depend on executors that may be lost,
    and values that depend on the partitioning stay as they were written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)
