"""Session construction, table loading and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: list[str] = []
_WRITTEN: list[str] = []
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "12g", **extra: str) -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ledgerloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in extra.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Only where that is unset on a single machine, as in
    tests, a temporary folder is made, and removed when Python ends; a cluster without the setting raises RuntimeError, as its
    executors couldn't read each other's files."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
    if not _OWN_DIRS or not os.path.isdir(_OWN_DIRS[0]):
        _OWN_DIRS[:] = [tempfile.mkdtemp(prefix="ledgerloom-")]
        atexit.register(shutil.rmtree, _OWN_DIRS[0], ignore_errors=True)
    return "file://" + _OWN_DIRS[0]


def cut(df: DataFrame, name: str = "step", free: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and losing an executor
    later costs a read of these files, not a recomputation. Column pruning still reaches the files. free: the shuffle files of this write go as
    soon as the table is there, not when the driver happens to collect its garbage."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE, None)
    if free:
        spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(_FREE, before) if before is not None else spark.conf.unset(_FREE)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that cut gave, which nothing reads any more; ValueError if one of them isn't such a table."""
    for df in tables:
        folders = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
        paths = [p for p in _WRITTEN if {p.rpartition("/")[2]} == folders]
        if not paths:
            raise ValueError(f"not a table that cut wrote: {sorted(folders)}")
        _delete(df.sparkSession, paths[0])
        _WRITTEN.remove(paths[0])


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> int:
    """Deletes the tables that cut has written in this Python process so far, once results that read them have been stored. Returns their number."""
    n = len(_WRITTEN)
    for path in _WRITTEN:
        _delete(spark, path)
    _WRITTEN.clear()
    return n
