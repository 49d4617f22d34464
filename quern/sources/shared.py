"""The folder that driver and executors share, and cutting lineage in it."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session, as in tests, takes a temporary folder; on a cluster, whose
    executors would not see that, it is an error."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        sc.setCheckpointDir(f"{tempfile.gettempdir()}/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes with the session."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Written once, so that neither a lost executor nor a second reader repeats, or repeats differently, what is above."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut``, by columns: for a wide table whose readers each ask for few of its columns."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the workers this package once for each application: on their machines they may not find it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    top = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp()
    path = f"{folder}/{top.name}-package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    sc.addPyFile(path)
    atexit.register(shutil.rmtree, folder, True)
