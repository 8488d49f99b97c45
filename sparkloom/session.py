"""What a session needs besides its data: this package on the executors and a checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per application, so that they need no copy of their own."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).resolve().parent
        target = Path(os.path.realpath(tempfile.mkdtemp(prefix="sparkloom-"))) / "sparkloom_code.zip"
        with zipfile.ZipFile(target, "w") as out:
            for f in sorted(root.rglob("*.py")):
                out.write(f, f"{root.name}/{f.relative_to(root)}")
        spark.sparkContext.addPyFile(str(target))


def ready(spark: SparkSession) -> None:
    """Ship the package and set the checkpoint folder; where none is named, one is made on a single machine only."""
    ship(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkloom-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; deleted when the application ends."""
    ready(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(where)
    system.deleteOnExit(where)
    return path


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ready(spark)
        return f(spark, sf_dir)

    return run
