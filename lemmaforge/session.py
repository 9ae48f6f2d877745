"""Session settings that the engine relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def local_session(cores: str = "8", name: str = "lemmaforge", **conf: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return workers_see_package(spark)


#: Python workers give freed memory back: large blocks are mapped one by one, and Arrow uses the system's allocator.
WORKER_ENV = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "8388608", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Rows that go to a Python worker at once, where the session doesn't say: texts may be long.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def workers_see_package(spark: SparkSession) -> SparkSession:
    """Python workers import this package from where the driver found it, and keep little memory."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    for key, value in WORKER_ENV.items():
        env.setdefault(key, value)
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is missing a folder of this machine is made, which only a local master may use.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = "file://" + own
        spark.conf.set("spark.checkpoint.dir", path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return str(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()).rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: later stages don't recompute it when an executor is lost."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def spread(table: DataFrame) -> DataFrame:
    """A stored table of fewer files than the session has cores, dealt evenly to all of them; a larger one as it is.

    One file is often one row group, which one task reads whole; work that follows without a shuffle would stay there.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if len(table.inputFiles()) < cores else table


def release(*tables: DataFrame) -> None:
    """Delete tables that `cut` wrote, where all that was computed from them is stored itself."""
    for table in tables:
        _delete(table.sparkSession, table.cut_path)
