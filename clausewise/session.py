"""Sessions, and getting this package to Python workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

ROOT = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", memory: str = "4g", name: str = "clausewise") -> SparkSession:
    """A session for one machine, as tests and the bench use it."""
    partitions = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package, once per application.

    Workers that have its folder on PYTHONPATH need nothing; others get a zip of
    the sources through Spark's own file distribution.
    """
    context = spark.sparkContext
    if getattr(context, "_clausewise_shipped", False):
        return
    if str(ROOT.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        archive = Path(tempfile.mkdtemp(prefix="clausewise-"), "clausewise.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(ROOT.rglob("*.py")):
                z.write(p, p.relative_to(ROOT.parent))
        context.addPyFile(str(archive))
    context._clausewise_shipped = True


def map_batches(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


#: The folder of a local session that names none, made when it is first needed.
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset and all
    runs in one process (as in tests) a temporary folder takes its place; on a
    cluster an unset one is an error, since executors could not see such a folder.
    """
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="clausewise-")
    return _own_dir


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows, if it is there and the session still is."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone already; the folder is scratch
        pass


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted at exit."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def keep(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read back, so that it is computed once and survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
