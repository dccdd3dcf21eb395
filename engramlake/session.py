"""Session helpers: defaults for local runs, and the shared folder for cut lineage."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str | int = "*", app: str = "engramlake", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own session."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**LOCAL_CONF, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests on one machine) a local folder is made and set.
    """
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"engramlake-{os.getpid()}")
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage; survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`cut` once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    for f in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
        if folder.getName().startswith("cut-"):
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def drop_all_cuts(spark: SparkSession) -> int:
    """Removes every table that :func:`cut` made in this application; returns their number.

    Lazy results may still read them, so this is for the end of a job.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    mine = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith(f"cut-{spark.sparkContext.applicationId}-")] if fs.exists(root) else []
    for p in mine:
        fs.delete(p, True)
    return len(mine)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A key of files' names, lengths and times of change."""
    parts = []
    for p in paths:
        root = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(root):
            parts += sorted(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}" for f in fs.listStatus(root))
    return hashlib.sha1("\n".join(parts).encode()).hexdigest()


def stored(spark: SparkSession, name: str, key: str, build: Callable[[str], None]) -> str:
    """The folder of an index or derived table in the shared folder, made by ``build(folder)`` at first use.

    ``key`` is the fingerprint of what it is made of: other data get another folder. A folder appears
    whole, by a rename, so a second driver at the same time loses nothing but its own work.
    """
    path = f"{shared_dir(spark)}/stored-{name}-{key[:24]}"
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(to):
        tmp = f"{path}-{uuid.uuid4().hex}"
        build(tmp)
        if fs.exists(to) or not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(tmp), to):
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(tmp), True)
    return path
